"""Windows that occur in more than one document, by anchors: shared by the two substring operators.

Every window of `length` tokens is represented by the k-gram in it that has the least hash,
its anchor. Equal windows have equal anchors, so a window can occur in two documents only if
its anchor does. The steps:

1. `anchor_messages`: each bucket sends each of its distinct anchor hashes once.
2. `shared_anchors`: of each hash, whether two documents have it, goes back to the buckets.
3. the operator sends the text around shared anchors, once for each distinct text in a
   bucket, to the part that owns the anchor's hash; a part sorts them and finds equal windows.
   Anchors that very many documents have ("crowded") are divided further, by whole windows.
4. `covered_spans`: spans to remove come back to the buckets of their documents.

Nothing is capped: crowded anchors take another way, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Bucket, grouped, pack, ranges, unpack

U64 = np.uint64
#: Tokens that are hashed at once; longer documents go in pieces that overlap by a window less a token.
SLICE = 1 << 17
#: An anchor in more documents (counted per bucket) is divided by whole windows.
CROWDED = 400
_R = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


#: What a byte counts as in a hash.
BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, U64)


#: Hashes that are sent have 48 bits. Sorted, their upper 16 compress to almost nothing, and
#: chance meetings, which cost time but change no result, stay rare up to 1e14 hashes.
LOW48 = U64((1 << 48) - 1)


def split48(h: np.ndarray) -> dict[str, np.ndarray]:
    return {"hi": (h >> U64(32)).astype(np.uint16), "lo": (h & U64(0xFFFFFFFF)).astype(np.uint32)}


def join48(x: dict) -> np.ndarray:
    return (x["hi"].astype(U64) << U64(32)) | x["lo"].astype(U64)


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("r", ())) < n:
        size = max(n, SLICE + 4096)
        for name, base in (("r", _R), ("inv", pow(_R, -1, 1 << 64))):
            a = np.full(size, base, U64)
            a[0] = 1
            _POW[name] = np.cumprod(a, dtype=U64)
    return _POW["r"][:n], _POW["inv"][:n]


def kgrams(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash, never 0, of every k consecutive values; it depends on nothing else."""
    n = len(values)
    r, inv = _powers(n)
    c = np.zeros(n + 1, U64)
    np.cumsum(values * r, out=c[1:])
    h = (c[k:] - c[: n - k + 1]) * inv[: n - k + 1]
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h |= U64(1)
    return h


def sliding(f, a: np.ndarray, w: int) -> np.ndarray:
    """f over every w consecutive elements."""
    span = 1
    while 2 * span <= w:
        a = f(a[:-span], a[span:])
        span *= 2
    return f(a[: len(a) - (w - span)], a[w - span :]) if span < w else a


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a bucket's tokens, as (row, start, end) of pieces in token numbers. Every
    window of every row is in exactly one piece; rows shorter than a window have none."""
    rows = np.flatnonzero(np.diff(offsets) >= length)
    if not len(rows):
        return
    start, end = offsets[rows], offsets[rows + 1]
    step = SLICE - length + 1
    n = np.maximum(1, -(-(end - start - length + 1) // step))
    row = np.repeat(rows, n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    lo = np.repeat(start, n) + nth * step
    hi = np.minimum(lo + SLICE, np.repeat(end, n))
    run = np.cumsum(hi - lo)
    cut = run // SLICE
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(cut)) + 1):
        yield row[part], lo[part], hi[part]


class Anchors:
    """The anchors of one slice. p: place in the slice's own tokens; piece: which piece."""

    def __init__(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, length: int):
        size = hi - lo
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        if len(lo) == 1 or (lo[1:] == hi[:-1]).all():
            v = values[lo[0] : hi[-1]]
        else:
            v = np.concatenate([values[a:b] for a, b in zip(lo, hi, strict=True)])
        if v.dtype == np.uint8:
            v = BYTES[v]
        w = length - k + 1
        h = kgrams(v, k) & LOW48
        low = sliding(np.minimum, h, w)
        last = (self.ends[:-1, None] - np.arange(1, length)[None, :]).ravel()
        low[last] = 0  # windows that begin there would reach into the next piece
        wide = np.zeros(len(low) + 2 * (w - 1), U64)
        wide[w - 1 : w - 1 + len(low)] = low
        self.p = np.flatnonzero(h == sliding(np.maximum, wide, w))
        self.h, self.low = h[self.p], low
        self.piece = np.searchsorted(self.ends, self.p, side="right")


def anchor_messages(values_of: Callable[[Bucket], tuple[np.ndarray, np.ndarray]], k: int, length: int, parts: int):
    """For groupBy(bucket).applyInArrow: part, bucket, data."""

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        values, offsets = values_of(bucket)
        hs, ds = [], []
        for row, lo, hi in pieces(offsets, length):
            a = Anchors(values, lo, hi, k, length)
            doc = bucket.ids[row[a.piece]]
            order = np.lexsort((doc, a.h))
            h, doc = a.h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            hs.append(h[new])
            ds.append(doc[new])
        if not hs:
            return pa.table({"part": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        h, doc = np.concatenate(hs), np.concatenate(ds)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        begin, run = grouped(h)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        n = narrow(np.add.reduceat(new.astype(np.int64), begin))
        return _dealt(key[0].as_py(), h[begin], parts, n=n)

    return send


def _dealt(bucket: int, h: np.ndarray, parts: int, **more: np.ndarray) -> pa.Table:
    part = part_of(h, parts)
    order = np.argsort(part, kind="stable")
    rows = [order[a:b] for a, b in ranges(part[order])]
    return pa.table(
        {
            "part": pa.array([part[r[0]] for r in rows], pa.int32()),
            "bucket": pa.array([bucket] * len(rows), pa.int32()),
            "data": pa.array([pack(**split48(h[r]), **{k: v[r] for k, v in more.items()}) for r in rows], pa.binary()),
        }
    )


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h * U64(0xD6E8FEB86659FD93)) >> U64(33)) % U64(parts)).astype(np.int32)


def shared_anchors(most: int):
    """For groupBy(part).applyInArrow: to each bucket, those of its hashes that two documents
    have, and for each whether it is crowded: whether `most` documents or more have it."""

    def share(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        buckets = table["bucket"].to_numpy()
        sent = [unpack(x) for x in table["data"].to_pylist()]
        h = np.concatenate(list(map(join48, sent)))
        n = np.concatenate([x["n"] for x in sent]).astype(np.int64)
        of = np.repeat(np.arange(len(sent)), [len(x["lo"]) for x in sent])
        order = np.argsort(h, kind="stable")
        begin, run = grouped(h[order])
        total = np.add.reduceat(n[order], begin)[run]
        keep = total >= 2
        h, of, crowded = h[order][keep], of[order][keep], total[keep] >= most
        order = np.argsort(of, kind="stable")
        h, of, crowded = h[order], of[order], crowded[order]
        each = ranges(of)
        return pa.table(
            {
                "bucket": pa.array([buckets[of[a]] for a, _ in each], pa.int32()),
                "data": pa.array([pack(**split48(h[a:b]), crowded=np.packbits(crowded[a:b])) for a, b in each], pa.binary()),
            }
        )

    return share


class Shared:
    """Looks anchors up among those that shared_anchors sent to a bucket."""

    def __init__(self, table: pa.Table):
        got = list(map(unpack, table["data"].to_pylist()))
        h = np.concatenate([*map(join48, got), np.zeros(0, U64)])
        crowded = np.concatenate([*[np.unpackbits(x["crowded"], count=len(x["lo"])) for x in got], np.zeros(0, np.uint8)])
        order = np.argsort(h)
        self.h, self.crowded = h[order], crowded[order].astype(bool)

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are shared, and which of all are crowded."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        found = self.h[at] == h
        return found, found & self.crowded[at]


def window_minima(lcp: np.ndarray, lcs: np.ndarray, left_rank: np.ndarray, right_n: np.ndarray, left_n: np.ndarray, doc: np.ndarray, k: int, length: int) -> np.ndarray:
    """Rows are texts around anchors, sorted by what follows the anchor's start.

    lcp[i]: tokens that rows i - 1 and i share from the anchor on. left_rank: each row's place
    when sorted by what precedes the anchor, backwards; lcs: tokens shared with the one before
    in that order. right_n, left_n: tokens that each row has there. Returns a row of booleans
    for each row: [j] tells that the window beginning j tokens before the anchor also begins
    in a document with a smaller id. A window is a node of the suffix tree of the right sides
    (rows that share length - j tokens) together with a class of left sides (that share j).
    """
    n, w = len(doc), length - k + 1
    out = np.zeros((n, w), bool)
    group = np.cumsum(lcp < k)
    for j in range(w):
        ok = np.flatnonzero((left_n >= j) & (right_n >= length - j))
        if not len(ok):
            continue
        right = np.cumsum(lcp < length - j)
        left = np.cumsum(lcs < j)[left_rank] if j else group
        key = right[ok].astype(np.int64) * (n + 1) + left[ok]
        order = np.argsort(key, kind="stable")
        begin, run = grouped(key[order])
        least = np.minimum.reduceat(doc[ok][order], begin)
        out[ok[order], j] = least[run] < doc[ok][order]
    return out


def spans_of_windows(hit: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hit as window_minima gives it: (index of the row, first, end) of covered runs of tokens."""
    wide = np.zeros((hit.shape[0], hit.shape[1] + 2), np.int8)
    wide[:, 1:-1] = hit
    step = np.diff(wide, axis=1)
    i, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)  # j runs from first to last - 1: the window of last - 1 begins leftmost
    return i, p[i] - (last - 1), p[i] - first + length


_MULT = np.random.default_rng(20240607).integers(0, 1 << 63, (2, 64), np.uint64) * U64(2) + U64(1)


def fingerprints(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row of tokens."""
    v = windows.astype(U64) + U64(1)
    return tuple((v * m[: v.shape[1]]).sum(axis=1, dtype=U64) for m in _MULT)


def crowded_windows(a: Anchors, crowded: np.ndarray, values: np.ndarray, lo: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows whose anchor is crowded: place in the slice, piece, and two fingerprints."""
    w = length - k + 1
    start = (a.p[crowded][:, None] - np.arange(w)[None, :]).ravel()
    h, piece = np.repeat(a.h[crowded], w), np.repeat(a.piece[crowded], w)
    ok = (start >= a.starts[piece]) & (start + length <= a.ends[piece])
    start, h, piece = start[ok], h[ok], piece[ok]
    ok = a.low[start] == h
    start, first = np.unique(start[ok], return_index=True)
    piece = piece[ok][first]
    at = lo[piece] + start - a.starts[piece]
    return start, piece, *fingerprints(values[at[:, None] + np.arange(length)[None, :]])


def least_documents(f1: np.ndarray, f2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by fingerprint and id; the order, and in that order the least id that has the fingerprint."""
    order = np.lexsort((doc, f2, f1))
    a, b = f1[order], f2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    return order, doc[order][begin][np.cumsum(new) - 1] if len(begin) else doc


SPANS = "part int, bucket int, data binary"


def spans_table(part: list[int], bucket: list[int], data: list[bytes]) -> pa.Table:
    return pa.table({"part": pa.array(part, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary())})


def covered(spans: pa.Table, offsets: np.ndarray) -> np.ndarray:
    """Which tokens of a bucket the spans that were sent to it cover."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int32)
    for x in map(unpack, spans["data"].to_pylist()):
        base = offsets[x["row"]]
        np.add.at(edge, base + x["lo"], 1)
        np.add.at(edge, base + x["hi"], -1)
    return np.cumsum(edge[:-1]) > 0


def anchored(docs: DataFrame, parts: int, values_of, send_texts, find_windows, finish, schema: str, k: int, length: int, crowded: int = CROWDED) -> DataFrame:
    """The four steps over bucketed documents. send_texts(key, docs, shared) and
    find_windows(key, texts) give SPANS rows; finish(key, docs, spans) the result."""
    groups = docs.groupBy("bucket")
    anchors = groups.applyInArrow(anchor_messages(values_of, k, length, parts), "part int, bucket int, data binary")
    shared = anchors.groupBy("part").applyInArrow(shared_anchors(crowded), "bucket int, data binary")
    texts = groups.cogroup(shared.groupBy("bucket")).applyInArrow(send_texts, SPANS)
    spans = texts.groupBy("part").applyInArrow(find_windows, SPANS).select("bucket", "data")
    return groups.cogroup(spans.groupBy("bucket")).applyInArrow(finish, schema)


def resolve(text: np.ndarray, lcp: np.ndarray, right_n: np.ndarray, left_n: np.ndarray, doc: np.ndarray, k: int, length: int) -> np.ndarray:
    """window_minima for sorted rows of which many are the same text in several documents.

    text: length tokens from the anchor on, then the tokens before it, backwards; lcp: as
    window_minima takes it, over all of text. Equal rows are made one, and only anchors with
    more than one text need window_minima."""
    n, w = len(doc), length - k + 1
    j = np.arange(w)
    valid = (j[None, :] <= left_n[:, None]) & (length - j[None, :] <= right_n[:, None])
    new = lcp < text.shape[1]
    new[1:] |= (right_n[1:] != right_n[:-1]) | (left_n[1:] != left_n[:-1])
    new[:1] = True
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc, first)
    # lcp between representatives: the least lcp on the way from one to the next
    near = np.minimum.reduceat(lcp, first)
    near[0] = 0
    group = np.cumsum(near < k)
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    hit = np.zeros((len(first), w), bool)
    if len(many):
        t = text[first[many]]
        left = t[:, length:]
        order = np.lexsort(left.T[::-1]) if left.shape[1] else np.arange(len(many))
        rank = np.empty(len(many), np.int64)
        rank[order] = np.arange(len(many))
        hit[many] = window_minima(near[many], common(left[order]), rank, right_n[first[many]], left_n[first[many]], least[many], k, length)
    return valid & (hit[of] | (doc > least[of])[:, None])


def common(rows: np.ndarray) -> np.ndarray:
    """How many leading tokens each row shares with the one before it."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1 and rows.shape[1]:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def by_part(bucket: int, part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The rows for each part, in their order."""
    order = np.argsort(part, kind="stable")
    return [(int(part[order[a]]), order[a:b]) for a, b in ranges(part[order])]


class Outbox:
    """What a bucket sends: texts and windows to parts, and its own spans, by way of a part
    below zero, to itself."""

    def __init__(self, bucket: int):
        self.bucket, self.part, self.data = bucket, [], []

    def add(self, part: int, **arrays) -> None:
        self.part.append(part)
        self.data.append(pack(**arrays))

    def spans(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        if len(row):
            self.add(-1 - self.bucket, row=row.astype(np.int32), lo=lo.astype(np.int64), hi=hi.astype(np.int64))

    def windows(self, f1, f2, doc, row, at, length: int, parts: int) -> None:
        """Crowded windows: each once for the bucket, with the least id that has it."""
        order, least = least_documents(f1, f2, doc)
        late = doc[order] > least
        self.spans(row[order][late], at[order][late], at[order][late] + length)
        order = order[~late]
        for part, i in by_part(self.bucket, part_of(f1[order], parts)):
            r = order[i]
            self.add(part, kind=1, f1=f1[r], f2=f2[r], doc=doc[r], row=row[r].astype(np.int32), at=at[r])

    def table(self) -> pa.Table:
        return spans_table(self.part, [self.bucket] * len(self.part), self.data)


class Inbox:
    """What a part got. passed: spans that buckets sent to themselves."""

    def __init__(self, table: pa.Table):
        buckets = table["bucket"].to_pylist()
        sent = list(map(unpack, table["data"].to_pylist()))
        self.passed = sent and "kind" not in sent[0]
        both = list(zip(buckets, sent, strict=True))
        self.texts = [] if self.passed else sorted((x for x in both if x[1]["kind"] == 0), key=lambda x: x[0])
        self.crowded = [] if self.passed else [x for x in both if x[1]["kind"] == 1]
        self.out: list[tuple[int, bytes]] = []

    def spans(self, bucket: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        for b, r in by_part(0, bucket.astype(np.int64)):
            self.out.append((b, pack(row=row[r].astype(np.int32), lo=lo[r].astype(np.int64), hi=hi[r].astype(np.int64))))

    def windows(self, length: int) -> None:
        if not self.crowded:
            return
        f1, f2, doc, row, at = (np.concatenate([x[k] for _, x in self.crowded]) for k in ("f1", "f2", "doc", "row", "at"))
        bucket = np.repeat([b for b, _ in self.crowded], [len(x["f1"]) for _, x in self.crowded])
        order, least = least_documents(f1, f2, doc)
        late = order[doc[order] > least]
        self.spans(bucket[late], row[late], at[late], at[late] + length)

    def table(self) -> pa.Table:
        return spans_table([0] * len(self.out), [b for b, _ in self.out], [x for _, x in self.out])
