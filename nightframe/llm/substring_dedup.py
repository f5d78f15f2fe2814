r"""Removal of repeated word windows by prefix-partitioned suffix trees (operator 5).

Tokens are words [^\x20\x09-\x0D]+. Suffixes begin at anchors (see anchors.py): prefixes of GRAM
words, and only those that two documents have. All suffixes with one prefix go to one part;
the number of parts follows the size of the input, so a part fits in memory. A prefix that
very many documents have is made longer, up to a whole window, so its suffixes spread over
many parts. A part builds the subtree of each of its prefixes: suffixes in order with the
depths at which neighbours branch, whose intervals are the inner nodes. Nodes as deep as a
window, less the words taken to the left of the anchor, hold the repeats.

Cases: a null text has no words; a document with fewer words than a window loses nothing; rows
with a null id come after all others and keep a null id; rows that repeat an id are not
"smaller" than each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors as an
from .blocks import Bucket, bucket_count, bucketed, hashes_of, part_count, space_words

LENGTH, GRAM = 13, 7
#: Words are Python objects here, so buckets are smaller than elsewhere.
BUCKET_BYTES = 8 << 20
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _words(bucket: Bucket) -> tuple[list[bytes], np.ndarray]:
    each = [space_words(t.as_buffer().to_pybytes()) for t in bucket.texts]
    offsets = np.zeros(len(each) + 1, np.int64)
    np.cumsum([len(x) for x in each], out=offsets[1:])
    return [w for x in each for w in x], offsets


def _values(bucket: Bucket) -> tuple[np.ndarray, np.ndarray]:
    words, offsets = _words(bucket)
    return hashes_of(words), offsets


def _sender(parts: int, k: int, length: int):
    w = length - k + 1

    def send(key: tuple[pa.Scalar, ...], docs: pa.Table, shared: pa.Table) -> pa.Table:
        number = (docs if docs.num_rows else shared)["bucket"][0].as_py()
        out = an.Outbox(number)
        look = an.Shared(shared)
        if not len(look.h):
            return out.table()
        bucket = Bucket(docs)
        words, offsets = _words(bucket)
        values = hashes_of(words)
        crowd, late = [], []
        texts: dict[tuple[int, bytes], tuple] = {}  # (words left of the anchor, text): anchor hash, places in the least document
        for row, lo, hi in an.pieces(offsets, length):
            a = an.Anchors(values, lo, hi, k, length)
            found, crowded = look(a.h)
            if crowded.any():
                start, piece, f1, f2 = an.crowded_windows(a, crowded, values, lo, k, length)
                r = row[piece]
                crowd.append((f1, f2, bucket.ids[r], r, lo[piece] + start - a.starts[piece] - offsets[r]))
            i = np.flatnonzero(found & ~crowded)
            p, piece = a.p[i], a.piece[i]
            at = lo[piece] + p - a.starts[piece]
            left, right = np.minimum(p - a.starts[piece], w - 1), np.minimum(a.ends[piece] - p, length)
            for h, x, r, ln, rn in zip(a.h[i].tolist(), at.tolist(), row[piece].tolist(), left.tolist(), right.tolist(), strict=True):
                if ln + rn < length:
                    continue
                doc = int(bucket.ids[r])  # rows are in the order of their ids
                first = texts.setdefault((ln, b" ".join(words[x - ln : x + rn])), (h, rn, doc, []))
                if first[2] == doc:
                    first[3].append((r, x - int(offsets[r])))
                else:
                    at_ = x - int(offsets[r])
                    late.append((r, at_ - ln, at_ - max(0, length - rn) + length))
        if crowd:
            out.windows(*map(np.concatenate, zip(*crowd, strict=True)), length, parts)
        if late:
            out.spans(*np.array(late, np.int64).T)
        if texts:
            keys = list(texts)
            part = an.part_of(np.fromiter((x[0] for x in texts.values()), np.uint64, len(texts)), parts)
            for to, i in an.by_part(number, part):
                mine = [keys[j] for j in i.tolist()]
                own = [texts[x] for x in mine]
                n = [len(x[3]) for x in own]
                places = np.array([y for x in own for y in x[3]], np.int64)
                out.add(to, kind=0, text=b"\n".join(x[1] for x in mine), left_n=np.array([x[0] for x in mine], np.uint8), right_n=np.array([x[1] for x in own], np.uint8), doc=np.array([x[2] for x in own], np.int64), n=np.array(n, np.int32), row=places[:, 0].astype(np.int32), at=places[:, 1])
        return out.table()

    return send


def subtree(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes as rows of word numbers: their order, and the depth at which each branches off
    from the one before. The intervals of equal depth are the inner nodes of the suffix tree."""
    order = np.lexsort(text.T[::-1])
    return order, an.common(text[order])


def _finder(k: int, length: int):
    w = length - k + 1

    def find(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        inbox = an.Inbox(table)
        if inbox.passed:
            return table
        inbox.windows(length)
        if inbox.texts:
            number: dict[bytes, int] = {}
            rows = [t.split(b" ") for _, x in inbox.texts for t in x["text"].split(b"\n")]
            left_n, right_n, doc, n = (np.concatenate([x[c] for _, x in inbox.texts]).astype(np.int64) for c in ("left_n", "right_n", "doc", "n"))
            text = np.zeros((len(rows), length + w - 1), np.int32)
            for i, (words, ln) in enumerate(zip(rows, left_n.tolist(), strict=True)):
                ids = [number.setdefault(x, len(number) + 1) for x in words]
                text[i, : len(ids) - ln] = ids[ln:]
                text[i, length : length + ln] = ids[:ln][::-1]
            del rows
            order, depth = subtree(text)
            hit = np.empty((len(order), w), bool)
            hit[order] = an.resolve(text[order], depth, right_n[order], left_n[order], doc[order], k, length)
            row, at = (np.concatenate([x[c] for _, x in inbox.texts]).astype(np.int64) for c in ("row", "at"))
            bucket = np.repeat([b for b, _ in inbox.texts], [len(x["row"]) for _, x in inbox.texts])
            i, lo, hi = an.spans_of_windows(np.repeat(hit, n, axis=0), at, length)
            inbox.spans(bucket[i], row[i], lo, hi)
        return inbox.table()

    return find


def _finish(key: tuple[pa.Scalar, ...], docs: pa.Table, spans: pa.Table) -> pa.Table:
    bucket, each = _kept(docs, spans)
    return pa.table(
        {
            "doc_id": bucket.doc_id,
            "n_words": pa.array([n for n, _, _ in each], pa.int64()),
            "n_removed": pa.array([n - len(kept) for n, kept, _ in each], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(b" ".join(kept)).hexdigest() for _, kept, _ in each], pa.string()),
        }
    )


def _keep_text(key: tuple[pa.Scalar, ...], docs: pa.Table, spans: pa.Table) -> pa.Table:
    bucket, each = _kept(docs, spans)
    runs = [np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist() for _, _, mask in each]
    return pa.table(
        {
            "doc_id": bucket.doc_id,
            "kept": pa.array([b" ".join(kept).decode() for _, kept, _ in each], pa.string()),
            "removed": pa.array([[{"start": a, "end": b} for a, b in zip(r[::2], r[1::2], strict=True)] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }
    )


def _kept(docs: pa.Table, spans: pa.Table) -> tuple[Bucket, list[tuple[int, list[bytes], np.ndarray]]]:
    bucket = Bucket(docs)
    words, offsets = _words(bucket)
    gone = an.covered(spans, offsets)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        mask = gone[a:b]
        out.append((b - a, [w for w, g in zip(words[a:b], mask.tolist(), strict=True) if not g] if mask.any() else words[a:b], mask))
    return bucket, out


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", digests: bool = False, crowded: int = an.CROWDED) -> DataFrame:
    """Removes every word that a window of `length` words covers which also starts in a document
    with a smaller id. Returns doc_id, kept (words joined by a space) and removed (runs of
    word numbers); with digests, their counts and hash instead."""
    n = bucket_count(docs, text, BUCKET_BYTES)
    rows = bucketed(docs, n, doc_id, text)
    finish, schema = (_finish, SCHEMA) if digests else (_keep_text, "doc_id long, kept string, removed array<struct<start:long,end:long>>")
    parts = part_count(n)
    return an.anchored(rows, parts, _values, _sender(parts, gram, length), _finder(gram, length), finish, schema, gram, length, crowded)
