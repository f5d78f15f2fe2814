"""Quality classifier: a sparse rule ensemble (operator 2).

Each whole text gets statistics of its characters, words and lines. Shallow trees, each fitted
to what the ones before leave over, are cut into rules: the conditions on the way to each node.
A logistic model with a lasso penalty weighs the rules; most weights become zero. The rules
that stay are compiled to a Spark column expression over the statistics.

Training: at most TRAIN_ROWS labelled rows, those with the least hash of their id; only their
statistics reach the driver. The label's row, language, source and id are no inputs.

Cases: a null text is empty and empty texts are scored like others; rows without a label or
with a null label are not learned from; labels of one class only, or none, give every text the
share of label 1 (0.5 without labels); ids may repeat or be null; extra columns are carried in
`row` and never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, LEAST = 40, 3, 32, 10
RATE = 0.3
PENALTY = 0.003
THRESHOLD = 0.3

_CLASSES = {
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": [*range(65, 91)],
    "digits": [*range(48, 58)],
    "spaces": [9, 10, 11, 12, 13, 32],
    "stops": [*b".,;:?"],
    "marks": [*b"!#$%&*+/<=>@[\\]^_`{|}~"],
}
STATISTICS = ["log_bytes", *(f"share_{c}" for c in _CLASSES), "log_words", "mean_word", "distinct_words", "top_word", "top_pair", "single_marks", "capital_words", "mean_line", "distinct_lines", "short_lines"]
_TABLES = {c: np.isin(np.arange(256), codes).astype(np.uint8) for c, codes in _CLASSES.items()}


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, text in enumerate(texts):
        if not text:
            continue
        codes = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        n, w, m = len(text), max(1, len(words)), max(1, len(lines))
        count = Counter(words)
        pairs = Counter(zip(words[::2], words[1::2], strict=False))
        out[i] = [
            np.log1p(n),
            *(int(codes @ t) / n for t in _TABLES.values()),
            np.log1p(len(words)),
            sum(map(len, words)) / w,
            len(count) / w,
            max(count.values(), default=0) / w,
            max(pairs.values(), default=0) * 2 / w,
            sum(c for x, c in count.items() if len(x) == 1 and not x.isalnum()) / w,
            sum(c for x, c in count.items() if x.isupper() and len(x) > 1) / w,
            np.log1p(n / m),
            len(set(lines)) / m,
            sum(len(x) < 30 for x in lines) / m,
        ]
    return out


@dataclass(frozen=True)
class Rule:
    """conditions: (statistic, threshold, whether it must be above). All must hold."""

    conditions: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, t, above in self.conditions:
            out &= (x[:, f] > t) == above
        return out

    def column(self, statistic) -> Column:
        out = F.lit(True)
        for f, t, above in self.conditions:
            out &= (statistic(STATISTICS[f]) > t) if above else (statistic(STATISTICS[f]) <= t)
        return out


@dataclass
class Ensemble:
    """rules with their weights, and the score of a text for which none holds, as log odds."""

    base: float
    rules: list[tuple[Rule, float]]

    def column(self, statistic=F.col) -> Column:
        odds = F.lit(float(self.base))
        for rule, weight in self.rules:
            odds += F.when(rule.column(statistic), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def _tree(bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rows: np.ndarray, path: tuple, out: list, step: np.ndarray) -> None:
    """Least squares; adds each node's rule to out and its mean to step."""
    if path:
        out.append(Rule(tuple(sorted(path))))
    y = target[rows]
    best = (1e-9, -1, -1)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST:
        whole = y.sum() ** 2 / len(y)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            n = np.cumsum(np.bincount(bins[rows, f], minlength=len(c) + 1))[:-1]
            s = np.cumsum(np.bincount(bins[rows, f], y, minlength=len(c) + 1))[:-1]
            ok = (n >= LEAST) & (len(y) - n >= LEAST)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(len(y) - n, 1) - whole, 0)
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    if best[1] < 0:
        step[rows] = y.mean()
        return
    _, f, b = best
    above = bins[rows, f] > b
    for side in (False, True):
        _tree(bins, cuts, target, rows[above == side], (*path, (f, float(cuts[f][b]), side)), out, step)


def rules_of(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted trees; each tree sees a different half of the rows."""
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rng = np.random.default_rng(1)
    odds, found = np.zeros(len(y)), []
    for _ in range(TREES):
        rest = y - 1 / (1 + np.exp(-odds))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        step = np.zeros(len(y))
        own: list[Rule] = []
        _tree(bins, cuts, rest, rows, (), own, step)
        found += own
        odds += RATE * 4 * step
    return list(dict.fromkeys(found))


def lasso_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient steps; the intercept bears no penalty."""
    w, n = weight / weight.sum(), z.shape[1]
    a = np.column_stack([z, np.ones(len(z))]).astype(np.float64)
    rate = 4 / max(1e-9, float(np.linalg.norm((a * w[:, None]).T @ a, 2)))
    beta, ahead, t = np.zeros(n + 1), np.zeros(n + 1), 1.0
    for _ in range(rounds):
        new = ahead - rate * (a.T @ (w * (1 / (1 + np.exp(-a @ ahead)) - y)))
        new[:n] = np.sign(new[:n]) * np.maximum(0, np.abs(new[:n]) - rate * penalty)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, beta, t = new + (t - 1) / u * (new - beta), new, u
    return float(beta[n]), beta[:n]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Ensemble:
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1 or len(y) < 4 * LEAST:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Ensemble(float(np.log(share / (1 - share))), [])
    rules = rules_of(x, y)
    z = np.stack([r.holds(x) for r in rules], axis=1) if rules else np.zeros((len(y), 0))
    base, beta = lasso_logistic(z, y, np.ones(len(y)), penalty)
    return Ensemble(base, [(r, float(b)) for r, b in zip(rules, beta, strict=True) if abs(b) > 1e-6])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch["text"]])
        stats = pa.StructArray.from_arrays([pa.array(x[:, j]) for j in range(x.shape[1])], STATISTICS)
        yield pa.RecordBatch.from_arrays([batch["row"], stats], ["row", "statistics"])


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (the columns of docs, or those named) and statistics of each text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("statistics", T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))])
    return rows.mapInArrow(_measure, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Ensemble:
    """labels: doc_id and a label, only of rows that may be learned from."""
    sample = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("of"), F.col(label).cast("double").alias("y")).distinct()
    sample = sample.orderBy(F.xxhash64(F.col("of")), "y").limit(rows)  # bounded, so it may be broadcast
    chosen = docs.select(F.col(doc_id).alias("of"), F.col(text).alias("text")).join(F.broadcast(sample), "of")
    got = measured(chosen, keep=["of", "y"]).select("row.of", "row.y", "statistics.*").toArrow()
    order = np.lexsort([got[s].to_numpy() for s in STATISTICS] + [got["y"].to_numpy(), got["of"].to_numpy()])
    x = np.stack([got[s].to_numpy() for s in STATISTICS], axis=1)[order] if got.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, got["y"].to_numpy()[order] if got.num_rows else np.zeros(0))


def scored(docs: DataFrame, ensemble: Ensemble, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row, score, predicted."""
    score = ensemble.column(lambda s: F.col(f"statistics.{s}"))
    return measured(docs, text, keep).select("row", score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
