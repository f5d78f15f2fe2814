"""Language identification by cross-parsing entropy (operator 10).

Labelled text of each language becomes a suffix automaton. A text is parsed against each
automaton into phrases, each the longest match that begins where the last phrase ended; the
fewer phrases, times the bits to name a place in the labelled text, for each symbol, the
nearer the language. The automaton is written as a table of steps over the symbols that its
language has, and a task walks all segments of its documents through it in lockstep.

Training: at most TRAIN_ROWS labelled rows a language, chosen by a hash of their id, whatever
their length; of a text of more than TRAIN_CHARS characters, a piece of so many, at a place that
the hash tells. Letters are lower-cased; runs of other characters
count as one space. A text is parsed from its first symbol to its last.

Cases: a null text and one without letters is `und` with score 0; ties go to the language that
sorts first; with no labelled rows every document is `und`; ids may be null or repeated; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import small

TRAIN_ROWS, TRAIN_CHARS = 16, 4_000
#: Bytes of all languages' step tables together; an automaton too large for its share is walked
#: by its sorted steps instead.
TABLE_BYTES = 256 << 20
#: Symbols that are parsed one after another; more pieces of a text go side by side.
SEGMENT = 256
#: Characters of texts that are parsed at once.
CHUNK = 1 << 20
UNDETERMINED = "und"


class Automaton:
    """A suffix automaton of a string of symbols: step[state] has each symbol's next state."""

    def __init__(self, symbols: list[int]):
        self.step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(self.step)
            self.step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(self.step)
                    self.step.append(dict(self.step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.step[p].get(c) == q:
                        self.step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def size(self, symbols: int) -> int:
        """Bytes of the table."""
        return len(self.step) * symbols * 4

    def begin(self, symbols: int) -> np.ndarray:
        """The state that each symbol leads to from the root, or -1."""
        begin = np.full(symbols, -1, np.int64)
        for c, s in self.step[0].items():
            begin[c] = s
        return begin

    def table(self, symbols: int) -> np.ndarray:
        """[state * symbols + c] = (place of the next state's row) * 4 + phrases that end here.
        A symbol with no step ends the phrase and begins the next one; unseen ones are phrases
        of their own."""
        n = len(self.step)
        begin = self.begin(symbols)
        fresh = np.where(begin >= 0, begin * symbols * 4, 1)  # from the root
        out = np.tile(fresh + 1, (n, 1))  # elsewhere the running phrase ends first
        out[0] = fresh
        for s, row in enumerate(self.step):
            for c, t in row.items():
                out[s, c] = t * symbols * 4
        return out.astype(np.int32).ravel()


class Table:
    """Steps of an automaton by its table: (states, symbols) to (states, phrases that end)."""

    def __init__(self, automaton: Automaton, symbols: int):
        self.steps = automaton.table(symbols)

    def __call__(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = self.steps[state + c]
        return step >> 2, step & 3


class Sparse:
    """The same by binary search among its steps, for large alphabets."""

    def __init__(self, automaton: Automaton, symbols: int):
        self.begin = automaton.begin(symbols) * symbols
        steps = sorted((s * symbols + c, t * symbols) for s, row in enumerate(automaton.step) for c, t in row.items())
        self.key, self.to = np.array([*steps, (-1, 0)][: max(1, len(steps))], np.int64).T.copy()

    def __call__(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state + c
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        begin = self.begin[c]
        ends = np.where(hit, 0, (state != 0).astype(np.int64) + (begin < 0))
        return np.where(hit, self.to[at], np.maximum(begin, 0)), ends


class Model:
    """Symbols: 0 is a space, 1 any letter outside the alphabet, then the alphabet: all letters
    of all languages. Each language numbers those that it has itself in the same way."""

    def __init__(self, texts: dict[str, str], table_bytes: int = TABLE_BYTES):
        self.languages = sorted(texts)
        joined = np.concatenate([_codes(t) for t in texts.values()]) if texts else np.zeros(0, np.uint32)
        self.alphabet = np.unique(joined[_is_letter(joined)])
        self.tables, self.bits, self.own = [], [], []
        for language in self.languages:
            s, _ = self.encode([texts[language]])
            own = np.ones(len(self.alphabet) + 2, np.int32)
            own[0] = 0
            has = np.unique(s[s > 1])
            own[has] = np.arange(len(has)) + 2
            self.own.append(own)
            automaton = Automaton(own[s].tolist())
            small = automaton.size(len(has) + 2) * len(self.languages) <= table_bytes
            self.tables.append((Table if small else Sparse)(automaton, len(has) + 2))
            self.bits.append(log2(len(s) + 2))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts in a row, and how many each has; runs of spaces are one."""
        codes = _codes("\n".join(texts))
        s = np.zeros(len(codes), np.int32)
        other = np.flatnonzero(codes >= 65)
        at = np.searchsorted(self.alphabet, codes[other])
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes[other] if len(self.alphabet) else np.zeros(len(other), bool)
        s[other[known]] = at[known] + 2
        other = other[~known]
        s[other[_is_letter(codes[other])]] = 1
        line = codes == 10
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size + 1) - 1
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        stop = np.zeros(len(s) + 1, bool)
        stop[ends] = True
        del line
        keep &= ~stop[: len(s)]
        total = np.r_[0, np.cumsum(keep)]
        begin = np.r_[0, ends[:-1] + 1]
        return s[keep], total[np.minimum(ends, len(s))] - total[np.minimum(begin, len(s))]

    def phrases(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each text (row) against each language (column).

        All segments are parsed together, each as if a phrase began there. Then the phrase that
        was running at the end of the segment before goes on into it, until both parses are in
        one state, as they mostly are after a few phrases: from there on they agree. A text with
        a segment where they never meet is parsed again from its beginning."""
        n = -(-size // SEGMENT)
        of = np.repeat(np.arange(len(size)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(np.cumsum(size) - size, n) + nth * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(size, n) - nth * SEGMENT)
        last = nth == np.repeat(n, n) - 1
        order = np.argsort(-length, kind="stable")
        wide = np.r_[symbols, np.zeros(SEGMENT, symbols.dtype)]
        columns = np.ascontiguousarray(wide[begin[order][:, None] + np.arange(SEGMENT)[None, :]].T)
        length, first, last, before = length[order], nth[order] == 0, last[order], order - 1
        live = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), side="right")
        out = np.zeros((len(size), len(self.languages)))
        for k, (table, own) in enumerate(zip(self.tables, self.own, strict=True)):
            states, counts = np.full(columns.shape, -1, np.int32), np.zeros(columns.shape, np.int32)
            state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            for i, a in enumerate(live.tolist()):
                state[:a], ends = table(state[:a], own[columns[i, :a]])
                count[:a] += ends
                states[i, :a], counts[i, :a] = state[:a], count[:a]
            at_end = np.empty(len(order), np.int64)
            at_end[order] = state
            rows = np.flatnonzero(~first)
            run, more = at_end[before[rows]], np.zeros(len(rows), np.int64)
            lost: set[int] = set()
            for i in range(SEGMENT):
                rows, run, more = (x[run != -1] for x in (rows, run, more))
                if not len(rows):
                    break
                run, ends = table(run, own[columns[i, rows]])
                more = more + ends
                met = run == states[i, rows]
                count[rows[met]] += more[met] - counts[i, rows[met]]
                over = ~met & (length[rows] == i + 1)
                tail = over & last[rows]  # the text ends before they meet
                count[rows[tail]], state[rows[tail]] = more[tail], run[tail]
                lost.update(of[order[rows[over & ~tail]]].tolist())
                run = np.where(met | over, -1, run)
            total = np.bincount(of[order], count + (last & (state != 0)), len(size))
            for t in lost:
                total[t] = self._walk(table, own[symbols[size[:t].sum() : size[: t + 1].sum()]])
            out[:, k] = total
        return out

    @staticmethod
    def _walk(table, text: np.ndarray) -> int:
        state, count = np.zeros(1, np.int64), 0
        for i in range(len(text)):
            state, ends = table(state, text[i : i + 1])
            count += int(ends[0])
        return count + int(state[0] != 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores; texts are taken CHUNK characters at a time, at least one."""
        lang: list[str] = []
        score: list[float] = []
        begin = size = 0
        for i, t in enumerate([*texts, None]):
            if i == len(texts) or (size and size + len(t or "") > CHUNK):
                a, b = self._predict(texts[begin:i])
                lang, score, begin, size = lang + a, score + b, i, 0
            size += len(t or "")
        return lang, score

    def _predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return out, scores
        full = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not full:
            return out, scores
        symbols, size = self.encode([texts[i].lower().replace("\n", " ") for i in full])
        bits = self.phrases(symbols, size) * np.array(self.bits) / np.maximum(size, 1)[:, None]
        best = bits.argmin(axis=1)
        first = bits[np.arange(len(full)), best]
        second = np.partition(bits, 1, axis=1)[:, 1] if bits.shape[1] > 1 else np.full(len(full), np.inf)
        score = np.where(second > 0, 1 - first / np.maximum(second, 1e-12), 0.0)
        for i, k, s in zip(full, best.tolist(), score.tolist(), strict=True):
            out[i], scores[i] = self.languages[k], s
        return out, scores


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    distinct, inverse = np.unique(codes, return_inverse=True)
    return np.array([chr(c).isalpha() for c in distinct.tolist()], bool)[inverse] if len(distinct) else np.zeros(0, bool)


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, most: int = TRAIN_CHARS) -> Model:
    """From rows with a text and a language: bounded, and the same rows every time. Of a text of
    more than `most` characters a piece counts."""
    ok = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.col(text).alias("text"))
    # the choice is made without the texts; then only those of the chosen rows are fetched
    chosen = ok.select("lang", "h", F.xxhash64("text").alias("t")).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("n") <= rows).select("lang", "h", "t").distinct()
    begin = F.pmod("h", F.greatest(F.length("text") - most + 1, F.lit(1)).cast("long")).cast("int") + 1
    got = ok.withColumn("t", F.xxhash64("text")).join(small(chosen), ["lang", "h", "t"], "left_semi").select("lang", "h", "t", F.substring("text", begin, F.lit(most)).alias("text")).distinct()
    texts: dict[str, list] = {}
    for r in got.toLocalIterator():
        texts.setdefault(r.lang, []).append((r.h, r.t, r.text))
    return Model({k: "\n".join(dict.fromkeys(t for _, _, t in sorted(v))).lower().replace("\n", " ") for k, v in texts.items()})


def _predictor(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = model.value.predict(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (how much fewer bits than the next language, of 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_predictor(sent), "doc_id long, lang_pred string, score double")
