r"""Near duplicates by SetSketch registers (operator 11).

A document's set is that of its distinct shingles of SHINGLE words [^\x20\x09-\x0D]+, A-Z
lower-cased. A register holds the least of the set's exponentially distributed values under one
hash function, on a scale of powers of BASE and cut off at both ends: 1 - log_BASE(value), in 0
to LAST. The registers of a union are the greater ones of its parts (`merged`), and two sets have
the same register about as often as they share elements.

Bands of ROWS registers are the keys of candidates. Sets with a similarity of 0.8 share none of
the BANDS keys in one of some 2e7 cases. Of a pair of candidates, the registers that are greater,
less and equal, with both set sizes, give the likelihood of each similarity; a pair whose
likelihood at the threshold is less than the greatest one by a factor of e^18 is dropped (one
pair of 5e8 at the threshold), any other is verified on the full sets.

1. Buckets of documents send their distinct keys, and learn which of them two sets have.
2. Sets without such a key are done; the others are read again. Pairs inside a bucket are
   decided there, along each key's chain of sizes.
3. Between buckets, as in the Jaccard join: each key's sets are linked like a chain, pairs of
   one component are needless, and a key of many sets is divided by what they differ in, so that
   no key's pairs are all made.

Cases: a null text, or one without words, has no shingles and is linked with nothing; a text of
fewer words than a shingle is one; a null id takes no part in links and keeps its row; rows that
repeat an id are linked as one node, with the shingle count of their own text; equal sets are
one set; extra columns are ignored; an empty table gives an empty result; very long texts are
whole, as a set's registers do not grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as an
from .blocks import LOWER, NULL_ID, Bucket, bucket_count, bucketed, checkpointed, ensure_checkpoint_dir, pack, part_count, space_words, unpack
from .components import Union
from .jaccard import BUCKET_BYTES, THIRD, _counted, _frequencies, _packed, grouped_rows, tokens

SHINGLE, PART, WHOLE = 2, 80, 100
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
#: The scale: rate of the exponentials, base of the powers, greatest register.
RATE, BASE, LAST = 20.0, 1.001, 65535
#: Natural logarithm of the likelihood ratio beyond which a pair is dropped.
MARGIN = 18.0
U64 = np.uint64
_RNG = np.random.default_rng(1105)
_FLIP = _RNG.integers(0, 1 << 63, REGISTERS, U64)
_TIMES = _RNG.integers(0, 1 << 63, REGISTERS, U64) | U64(1)
#: Tokens that are hashed at once.
SLICE = 1 << 15


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set of hashes; sets are not empty."""
    out = np.full((len(sets), REGISTERS), np.iinfo(np.uint64).max, U64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= SLICE):
            size += len(sets[end])
            end += 1
        for piece in range(0, size, SLICE) if end == at + 1 else [None]:
            flat = sets[at][piece : piece + SLICE] if piece is not None else np.concatenate(sets[at:end])
            begin = np.zeros(1, np.int64) if piece is not None else np.cumsum([0, *map(len, sets[at : end - 1])])
            flat = flat * U64(0x9E3779B97F4A7C15)
            flat ^= flat >> U64(29)
            for j in range(REGISTERS):
                least = np.minimum.reduceat((flat ^ _FLIP[j]) * _TIMES[j], begin)
                np.minimum(out[at:end, j], least, out=out[at:end, j])
        at = end
    value = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-15)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LAST).astype(np.uint16)


def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(x, y)


def band_keys(reg: np.ndarray) -> np.ndarray:
    """Of each row of registers its keys, of 48 bits; a key depends on its band."""
    h = np.zeros((len(reg), BANDS), U64) + np.arange(1, BANDS + 1, dtype=U64)
    for r in range(ROWS):
        h = (h ^ reg[:, r::ROWS].astype(U64)) * U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(32)
    return h & an.LOW48


def _p(x: np.ndarray) -> np.ndarray:
    return np.maximum(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-300)


def log_likelihood(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each pair of register rows (k, REGISTERS), for its similarities j (k, any): how likely
    the numbers of greater, less and equal registers are."""
    above, below = (np.count_nonzero(a > b, axis=1)[:, None] for a, b in ((x, y), (y, x)))
    u = (nx / (nx + ny))[:, None]
    greater, less = _p(np.maximum(u - (1 - u) * j, 0)), _p(np.maximum(1 - u - u * j, 0))
    equal = np.maximum(1 - greater - less, 1e-300)
    return above * np.log(greater) + below * np.log(less) + (REGISTERS - above - below) * np.log(equal)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, steps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The most likely similarity of each pair, on a grid, and its log-likelihood."""
    most = np.minimum(nx, ny) / np.maximum(nx, ny)
    grid = most[:, None] * np.linspace(0, 1, steps + 1)
    found = log_likelihood(x, y, nx, ny, grid)
    best = found.argmax(axis=1)
    row = np.arange(len(best))
    return grid[row, best], found[row, best]


def likely(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Which pairs may have a similarity of part / whole or more."""
    if not len(x):
        return np.zeros(0, bool)
    at = np.full((len(x), 1), part / whole)
    most, top = estimate(x, y, nx, ny)
    fits = np.minimum(nx, ny) * whole >= part * np.maximum(nx, ny)
    return fits & ((most >= part / whole) | (top - log_likelihood(x, y, nx, ny, at)[:, 0] <= MARGIN))


def verified(x: np.ndarray, y: np.ndarray, part: int, whole: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * whole >= part * (len(x) + len(y) - shared)


#: Of each document its id, number of shingles and, where it has some, its set's fingerprint
#: (kind 0); the registers of each distinct set, as print (kind 1); for each part the bucket's
#: keys (kind 2: the part as n).
FIRST = "kind int, bucket int, doc long, n int, print binary, data binary"


def _first(parts: int, shingle: int):
    def send(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        bucket, number = Bucket(docs), key[0].as_py()
        size, prints, seen, sets = [], [], {}, []
        for doc, text in zip(bucket.ids.tolist(), bucket.texts, strict=True):
            t = tokens(text.as_buffer().to_pybytes(), shingle)
            size.append(len(t))
            prints.append(xxhash.xxh3_128_digest(t.tobytes()) if len(t) and doc != NULL_ID else None)
            if prints[-1] is not None and prints[-1] not in seen:
                seen[prints[-1]] = len(sets)
                sets.append(t)
        reg = registers(sets)
        sent = _counted(number, np.concatenate([*map(np.unique, band_keys(reg)), np.zeros(0, U64)]), parts)
        n, k, m = len(bucket), len(sets), sent.num_rows
        ids = bucket.doc_id.combine_chunks() if isinstance(bucket.doc_id, pa.ChunkedArray) else bucket.doc_id
        columns = [
            pa.array(np.repeat(np.array([0, 1, 2], np.int32), [n, k, m])),
            pa.array(np.full(n + k + m, number, np.int32)),
            pa.chunked_array([ids, pa.nulls(k + m, pa.int64())]),
            pa.array([*size, *map(len, sets), *sent["part"].to_pylist()], pa.int32()),
            pa.array([*prints, *seen, *[None] * m], pa.binary()),
            pa.array([*[None] * n, *[r.tobytes() for r in reg], *sent["data"].to_pylist()], pa.binary()),
        ]
        return pa.table(columns, ["kind", "bucket", "doc", "n", "print", "data"])

    return send


def _second(parts: int, shingle: int, part: int, whole: int):
    """As THIRD of the Jaccard join says; and, as kind 5, the sets that have keys with others:
    the least id of the bucket as a, the bucket as b."""

    def send(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        bucket = Bucket(docs)
        number = (docs if docs.num_rows else told)["bucket"][0].as_py()
        rows: dict[str, list] = {c: [] for c in ("kind", "a", "b", "n", "data")}

        def add(kind: int, a=None, b=None, n=None, data=None) -> None:
            for c, v in zip(rows, (kind, a, b, n, data), strict=True):
                rows[c].append(v)

        shared = [an.join48(unpack(x)) for p, x in zip(told["print"].to_pylist(), told["data"].to_pylist(), strict=True) if p is None]
        shared = np.unique(np.concatenate(shared)) if shared else np.zeros(0, U64)
        kept = {p: np.frombuffer(x, np.uint16) for p, x in zip(told["print"].to_pylist(), told["data"].to_pylist(), strict=True) if p is not None}
        prints = list(kept)
        keys = band_keys(np.array(list(kept.values()), np.uint16).reshape(-1, REGISTERS))
        found = np.isin(keys, shared)
        number_of = {prints[i]: i for i in np.flatnonzero(found.any(axis=1)).tolist()}
        have: dict[int, tuple[int, np.ndarray]] = {}
        for doc, text in zip(bucket.ids.tolist(), bucket.texts, strict=True):  # least ids first
            if doc == NULL_ID or not number_of:
                continue
            t = tokens(text.as_buffer().to_pybytes(), shingle)
            i = number_of.get(xxhash.xxh3_128_digest(t.tobytes())) if len(t) else None
            if i is not None and i not in have:
                have[i] = (doc, t)
        # as in the join, the nodes are ids; their sets in the order of the ids
        order = sorted(have, key=lambda i: have[i][0])
        docs_of, sets = [have[i][0] for i in order], [have[i][1] for i in order]
        if sets:
            reg, keys, found = np.array([kept[prints[i]] for i in order]), keys[order], found[order]
            size = np.fromiter(map(len, sets), np.int32, len(sets))
            i, band = np.nonzero(found)
            t = keys[i, band]
            one = np.unique(np.stack([t, i.astype(U64)], axis=1), axis=0)  # two bands may have one key
            t, i = one[:, 0], one[:, 1].astype(np.int64)
            by = np.lexsort((i, size[i], t))
            t, i = t[by], i[by]
            near = t[1:] == t[:-1]
            pairs = np.unique(np.stack([i[:-1][near], i[1:][near]], axis=1), axis=0)
            union = Union()
            for lo in range(0, len(pairs), 4096):
                x, y = pairs[lo : lo + 4096].T
                for a, b in pairs[lo : lo + 4096][likely(reg[x], reg[y], size[x], size[y], part, whole)].tolist():
                    if union.root(a) != union.root(b) and verified(sets[a], sets[b], part, whole):
                        union.join(a, b)
                        add(2, docs_of[a], docs_of[b])
            for x, s, r in zip(docs_of, sets, reg, strict=True):
                add(5, x, number, data=pack(**an.split48(s), reg=r))
            entry = {"t": t, "i": i, "place": np.zeros(len(t), np.int64)}
            add(3, data=_packed(entry, docs_of, size))
            root = np.fromiter(map(union.root, i.tolist()), np.int64, len(i))
            by = np.lexsort((root, t))
            one = by[np.r_[True, (t[by][1:] != t[by][:-1]) | (root[by][1:] != root[by][:-1])]]
            for to, r in an.by_part(0, an.part_of(t[one], parts)):
                add(4, n=to, data=_packed({c: v[one[r]] for c, v in entry.items()}, docs_of, size))
        return pa.table([pa.array(rows["kind"], pa.int32()), pa.array(rows["a"], pa.int64()), pa.array(rows["b"], pa.int64()), pa.array(rows["n"], pa.int32()), pa.array(rows["data"], pa.binary())], list(rows))

    return send


def _decide(part: int, whole: int):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 2048):
                batch = whole_batch.slice(lo, 2048)
                x, y = ([unpack(d) for d in batch[c].to_pylist()] for c in ("x", "y"))
                size = [np.array([len(d["lo"]) for d in side]) for side in (x, y)]
                same = likely(np.array([d["reg"] for d in x]), np.array([d["reg"] for d in y]), *size, part, whole)
                for i in np.flatnonzero(same).tolist():
                    same[i] = verified(an.join48(x[i]), an.join48(y[i]), part, whole)
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    return decide


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, part: int = PART, whole: int = WHOLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the least id that links lead to."""
    ensure_checkpoint_dir(docs.sparkSession)
    n = bucket_count(docs, text, BUCKET_BYTES)
    parts = part_count(n)
    groups = bucketed(docs, n, doc_id, text).groupBy("bucket")
    first = checkpointed(groups.applyInArrow(_first(parts, shingle), FIRST))
    told = first.where("kind = 2").select(F.col("n").alias("part"), "bucket", "data").groupBy("part").applyInArrow(_frequencies, "bucket int, data binary")
    told = first.where("kind = 1").select("bucket", "print", "data").union(told.select("bucket", F.lit(None).cast("binary").alias("print"), "data"))
    second = checkpointed(groups.cogroup(told.groupBy("bucket")).applyInArrow(_second(parts, shingle, part, whole), THIRD))
    rows = first.where("kind = 0").select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "print")
    sets = second.where("kind = 5").select(F.col("b").cast("int").alias("bucket"), F.col("a").alias("doc"), "data")
    return grouped_rows(rows, sets, second, part, whole, _decide(part, whole))
