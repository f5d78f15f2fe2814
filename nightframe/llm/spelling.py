r"""Spelling variants: words one edit apart, found through automata in both directions (operator 12).

Two words are near if one inserted, deleted or replaced code point makes one of the other. Of a
word's two halves, such an edit leaves one as it is: the near words of a word begin with its
first half, or end with its second. So a word asks for both, and each word of the vocabulary
answers to the halves that a word of its length, one less or one more may have.

Halves are dealt into shards of bounded size. A shard builds the minimal acyclic automaton of
the words that begin with its halves, and that of the reversed words that end with them, with
the number of words below each node, so that the letters on a path add up to the word's place
in the sorted list (a perfect hash). A word walks its half exactly and is completed with one
error. What the forward automaton finds, the backward one leaves out, so no pair counts twice.
Of each word a shard gives one row: how many are near and the best of them.

A half that more than HALF words answer to is dealt over several shards by the words, and who
asks for it asks all of them.

A word's form is the near word that occurs most often (ties: least), if at least FACTOR times as
often as the word; roots follow forms to the end, in rounds that double the way gone, which is at
most the logarithm of the greatest count.

Cases: null words take no part; the vocabulary has each word once, with its count (rows that
repeat a word are added up); words of fewer than two code points have an empty half and are
still right, but slow; an empty table gives an empty result; very long words are words.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed, ensure_checkpoint_dir, shuffle_partitions, small

#: Entries of a shard, on average, and the words of one half that a shard holds.
SHARD, HALF = 40_000, 20_000
#: How many times as often as a word its form occurs.
FACTOR = 2


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a word's number is its place."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.step: list[dict[str, tuple[int, int]]] = []  # letter: the node, and the words before those that pass it
        count: list[int] = []
        register: dict[tuple, int] = {}

        def node(final: bool, edges: list[tuple[str, int]]) -> int:
            key = (final, tuple(edges))
            if key not in register:
                before, step = int(final), {}
                for letter, to in edges:
                    step[letter] = (to, before)
                    before += count[to]
                register[key] = len(self.step)
                self.step.append(step)
                self.final.append(final)
                count.append(before)
            return register[key]

        edges: list[list[tuple[str, int]]] = [[]]  # of the nodes on the last word's path, which may grow
        final, last = [False], ""

        def close(depth: int) -> None:
            while len(edges) > depth + 1:
                i = node(final.pop(), edges.pop())
                edges[-1].append((last[len(edges) - 1], i))

        for word in words:
            depth = 0
            for x, y in zip(word, last, strict=False):
                if x != y:
                    break
                depth += 1
            close(depth)
            edges += [[] for _ in word[depth:]]
            final += [False] * (len(word) - depth)
            final[-1] = True
            last = word
        close(0)
        self.root = node(final[0], edges[0])

    def walk(self, word: str, node: int | None = None, number: int = 0) -> tuple[int, int] | None:
        node = self.root if node is None else node
        for letter in word:
            to = self.step[node].get(letter)
            if to is None:
                return None
            node, number = to[0], number + to[1]
        return node, number

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words one edit away that begin with word[:exact]."""
        at, out = self.walk(word[:exact]), set()

        def rest(node: int, number: int, j: int) -> None:
            end = self.walk(word[j:], node, number)
            if end is not None and self.final[end[0]]:
                out.add(end[1])

        for j in range(exact, len(word) + 1):
            if at is None:
                break
            node, number = at
            if j < len(word):
                rest(node, number, j + 1)
            for letter, (to, before) in self.step[node].items():
                rest(to, number + before, j)
                if j < len(word) and letter != word[j]:
                    rest(to, number + before, j + 1)
            at = self.walk(word[j : j + 1], node, number) if j < len(word) else None
        return out


def half(length: int) -> int:
    """Code points of a word's first half."""
    return length // 2


FOUND = "word string, n_near long, form_n long, form string"


def _search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of each word that asks: how many of the shard's words are near, and the most frequent."""
    out: dict[str, list] = {"word": [], "n_near": [], "form_n": [], "form": []}
    for forward in (True, False):
        rows = [r for r in table.to_pylist() if r["forward"] == forward]
        turn = (lambda w: w) if forward else (lambda w: w[::-1])
        answers = {turn(r["word"]): r["n"] for r in rows if not r["asks"]}
        if not answers:
            continue
        answered = {(r["word"], r["m"]) for r in rows if not r["asks"]}
        words = sorted(answers)
        automaton, counts = Automaton(words), [answers[w] for w in words]
        for word in {r["word"] for r in rows if r["asks"]}:
            first = half(len(word))
            m = first if forward else len(word) - first
            found = automaton.one_error(turn(word), m)
            near = [(-counts[i], turn(words[i])) for i in found]
            near = [x for x in near if (x[1], m) in answered]  # the others answer to this half in another shard
            if not forward:
                near = [x for x in near if x[1][:first] != word[:first]]
            if near:
                n, form = min(near)
                for k, v in zip(out, (word, len(near), -n, form), strict=True):
                    out[k].append(v)
    return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()), "form_n": pa.array(out["form_n"], pa.int64()), "form": pa.array(out["form"], pa.string())})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """vocabulary: word, n, each word once. Of each word that has near words: word, n_near, and
    the most frequent of them as form, form_n."""
    session = vocabulary.sparkSession
    length = F.length("word")
    halves = []
    for forward in (True, False):
        part = (lambda m: F.substring("word", F.lit(1), F.floor(m / 2).cast("int"))) if forward else (lambda m: F.substring("word", F.floor(m / 2).cast("int") + 1 - (m - length).cast("int"), F.length("word")))
        own = F.struct(F.lit(forward).alias("forward"), part(length).alias("half"), F.lit(True).alias("asks"))
        halves += [own, *[F.struct(F.lit(forward).alias("forward"), part(length + d).alias("half"), F.lit(False).alias("asks")) for d in (-1, 0, 1)]]
    entries = vocabulary.select("word", "n", F.explode(F.array_distinct(F.array(*halves))).alias("e")).select("word", "n", "e.*")
    crowded = entries.where("not asks").groupBy("forward", "half").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > HALF)
    entries = entries.join(small(crowded), ["forward", "half"], "left")
    deals = F.coalesce(F.ceil(F.col("words") / HALF), F.lit(1))
    deal = F.explode(F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), deals - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), deals))))
    shards = max(shuffle_partitions(session), -(-vocabulary.count() * 6 // SHARD))
    dealt = entries.select("word", "n", "forward", "asks", "half", deal.alias("deal"))
    dealt = dealt.select("word", "n", "forward", "asks", F.length("half").alias("m"), F.pmod(F.xxhash64("forward", "half", "deal"), F.lit(shards)).cast("int").alias("shard")).distinct()
    found = dealt.groupBy("shard").applyInArrow(_search, FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("k"), "form")).alias("best")  # strings compare by code points
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.k")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form. word, root: the end of the way from form to form, which has no circle
    as each form is more frequent than its word."""
    up = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = checkpointed(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = new.select("word", "root")
        if new.where("moved").isEmpty():
            return up


def variants(words: DataFrame, least: int = 3, factor: int = FACTOR, word: str = "word", n: Column | None = None) -> DataFrame:
    """words: a row for each occurrence, or, with n, for several. Of each word that occurs `least`
    times or more: word, n, n_near, form, form_n, root."""
    ensure_checkpoint_dir(words.sparkSession)
    total = F.count(F.lit(1)) if n is None else F.sum(n)
    vocabulary = checkpointed(words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(total.cast("long").alias("n")).where(F.col("n") >= least))
    near = vocabulary.join(near_words(vocabulary), "word", "left")
    formed = F.col("form_n") >= factor * F.col("n")
    found = checkpointed(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")))
    up = roots(found.where("form is not null"))
    return found.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))
