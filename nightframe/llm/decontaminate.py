r"""Benchmark decontamination by an FM-index of each training shard (operator 3).

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased. Test phrases are the windows
of WINDOW words of the benchmark items (a shorter item is one phrase). A shard is a batch of
documents as Spark hands them to a task. Words that no phrase has cannot be part of an
occurrence, so they divide the shard into runs, and only runs as long as the shortest phrase
are indexed. The index is a Burrows-Wheeler transform with wavelet-matrix ranks; all phrases
are searched backwards at once, and occurrences are located by walking to sampled positions.

The benchmark is a stated query set. It is collected in blocks of at most BLOCK_BYTES of text,
each searched against all documents; the spans of several blocks are merged by document.

Cases: a null or wordless text has no words and is clean; a null or wordless item, and one with
a null id, takes no part; items that repeat an id count once; equal phrases of several items
count for each; other columns are kept in `row` and never read; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 13
#: Bytes of benchmark text that are collected and sent to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Every so many positions of the text are kept to locate occurrences.
SAMPLE = 8

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(_TABLE).split()


class Phrases:
    """The distinct phrases of some benchmark items, as numbers of words from 1 on."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.number: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                of.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.phrases, self.items = list(of), [sorted(x) for x in of.values()]
        self.size = np.array([len(p) for p in self.phrases], np.int64)
        self.shortest = int(self.size.min(initial=1 << 30))
        longest = int(self.size.max(initial=0))
        self.backwards = np.zeros((len(self.phrases), longest), np.int64)  # last word first
        for i, p in enumerate(self.phrases):
            self.backwards[i, : len(p)] = p[::-1]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling. Zeros are separators, each different from every other."""
    n = len(text)
    zero = text == 0
    m = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, m + text).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        new = np.ones(n, bool)
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:]
        rank = rank * (n + 1) + ahead
        order = np.argsort(rank, kind="stable")
        step *= 2


class Ranks:
    """A wavelet matrix: how often a symbol occurs before a position, for many at once."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=1)).bit_length())
        self.ones, self.zeros = [], []
        s = symbols
        for b in reversed(range(self.bits)):
            bit = (s >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def __call__(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin = np.zeros_like(at)
        for level, b in enumerate(reversed(range(self.bits))):
            ones, one = self.ones[level], ((symbol >> b) & 1).astype(bool)
            x, y = ones[at], ones[begin]
            at = np.where(one, self.zeros[level] + x, at - x)
            begin = np.where(one, self.zeros[level] + y, begin - y)
        return at - begin


class FMIndex:
    """Of a text of numbers from 1 on, with a zero before each run and at the end."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        self.last = text[order - 1]  # the symbol before each suffix; text[-1] is a separator
        self.before = np.r_[0, np.cumsum(np.bincount(text))]  # symbols less than each
        self.rank = Ranks(self.last)
        starts = np.r_[True, text[:-1] == 0]
        kept = (order % SAMPLE == 0) | starts[order]  # first positions too: no walk leaves its run
        self.kept, self.sample = kept, np.where(kept, order, -1)

    def search(self, backwards: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each phrase, the range of suffixes that begin with it."""
        lo, hi = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        hi[:] = len(self.last)
        top = len(self.before) - 1
        live = np.arange(len(size))
        for i in range(backwards.shape[1]):
            live = live[(size[live] > i) & (hi[live] > lo[live])]
            c = backwards[live, i]
            known = c < top
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            lo[live], hi[live] = self.before[c] + self.rank(c, lo[live]), self.before[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, suffix: np.ndarray) -> np.ndarray:
        """Where suffixes begin in the text."""
        steps, at = np.zeros(len(suffix), np.int64), suffix.copy()
        while len(walk := np.flatnonzero(~self.kept[at])):
            c = self.last[at[walk]]
            at[walk] = self.before[c] + self.rank(c, at[walk])
            steps[walk] += 1
        return self.sample[at] + steps


def spans_of(texts: list[bytes | None], phrases: Phrases) -> tuple[list[int], dict[int, tuple[list[list[int]], list[str]]]]:
    """Of each text the number of words; of those with occurrences the merged spans and the items."""
    counts, runs, rows, begins = [], [], [], []
    for row, text in enumerate(texts):
        w = words(text)
        counts.append(len(w))
        if len(w) < phrases.shortest or not phrases.phrases:
            continue
        ids = np.fromiter(map(phrases.number.get, w, repeat(0)), np.int64, len(w))
        edge = np.flatnonzero(np.diff(np.r_[0, (ids > 0).astype(np.int8), 0]))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= phrases.shortest:
                runs.append(ids[a:b])
                rows.append(row)
                begins.append(a)
    found: dict[int, tuple[list[list[int]], set[str]]] = {}
    if runs:
        zero = np.zeros(1, np.int64)
        text = np.concatenate([x for r in runs for x in (zero, r)] + [zero])
        start = np.cumsum([1 + len(r) for r in runs]) - np.array([len(r) for r in runs])  # of each run in the text
        index = FMIndex(text)
        lo, hi = index.search(phrases.backwards, phrases.size)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        suffix = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        at = index.locate(suffix)
        run = np.searchsorted(start, at, side="right") - 1
        row, first = np.array(rows)[run], at - start[run] + np.array(begins)[run]
        for i in np.lexsort((first, row)).tolist():
            spans, items = found.setdefault(int(row[i]), ([], set()))
            a, b = int(first[i]), int(first[i] + phrases.size[which[i]])
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
            items.update(phrases.items[which[i]])
    return counts, {r: (s, sorted(i)) for r, (s, i) in found.items()}


_RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]


def _searcher(phrases):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = phrases.value
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else None for x in batch["text"]]
            counts, found = spans_of(texts, own)
            none: tuple = ([], [])
            each = [found.get(i, none) for i in range(len(texts))]
            columns = [counts, [[{"start": a, "end": b} for a, b in s] for s, _ in each], [i for _, i in each]]
            yield pa.RecordBatch.from_arrays([batch["row"], *(pa.array(c, t) for c, (_, t) in zip(columns, _ARROW, strict=True))], ["row", *(n for n, _ in _ARROW)])

    return search


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of each document: row (its columns), n_words, spans (runs of hit words) and items (ids)."""
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], *_RESULT])
    found = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        phrases = spark.sparkContext.broadcast(Phrases([(r.id, r.text) for r in own.toLocalIterator()], window))
        found.append(rows.mapInArrow(_searcher(phrases), schema))
    if blocks == 1:
        return found[0]
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    # rows that are equal in all columns fall together here, so they are counted and dealt out again
    same = every.groupBy("row", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count(F.lit(1)) / blocks).cast("int").alias("times"))
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast(_RESULT["spans"].dataType),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return same.withColumn("spans", merged).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row", "n_words", "spans", "items")


def hits(spans):
    """Words in all spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)
