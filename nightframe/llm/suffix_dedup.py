"""Substring removal by a distributed merge sort of suffixes (operator 7).

Texts are UTF-8 bytes. Suffixes are sampled at anchors (see anchors.py), and only those whose
first bytes occur in two documents are sorted. Each bucket sorts its own suffixes and sends
them as front-coded runs: of each suffix, the number of bytes shared with the one before it
and the bytes after those. The part that owns the first bytes combines the runs of all buckets
with a loser tree that compares two suffixes only beyond the bytes both are known to share
with the last one put out. The shared lengths that fall out of the merge give the repeats.

Cases: a run of one byte of any length is cut into few different rows; a null text is empty; a text shorter than the window loses nothing; rows with a null id
come after all others, in id order, and keep a null id; rows that repeat an id are not "smaller"
than each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors as an
from .blocks import Bucket, bucket_count, bucketed, part_count

LENGTH, GRAM = 50, 22
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted rows of bytes: shared with the row before, and all other bytes one after another."""
    lcp = an.common(rows)
    return lcp.astype(np.uint8), rows[np.arange(rows.shape[1])[None, :] >= lcp[:, None]].tobytes()


def decode(lcp: np.ndarray, tails: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    row, at = b"", 0
    for n in lcp.tolist():
        row = row[:n] + tails[at : at + width - n]
        at += width - n
        yield n, row


def merge(runs: list[Iterator[tuple[int, bytes]]], width: int) -> Iterator[tuple[int, int, bytes]]:
    """Merges sorted runs of (bytes shared with the one before in its run, row): (bytes shared
    with the one before in the result, run, row). Of each run's head, `known` holds the bytes
    that it shares with the last row put out. The head that shares more is the smaller; only
    heads that share equally many are compared, from there on."""
    count = len(runs)
    head: list[bytes | None] = [None] * count
    known = [0] * count
    for i, run in enumerate(runs):
        head[i] = next(run, (0, None))[1]
    loser = [-1] * count

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's `known` becomes what it shares with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if (p := known[a]) != (q := known[b]):
            return (a, b) if p > q else (b, a)
        if p < width and (rest := int.from_bytes(x[p:]) ^ int.from_bytes(y[p:])):
            same = width - (rest.bit_length() + 7) // 8
            if x[same] < y[same]:
                known[b] = same
                return a, b
            known[a] = same
            return b, a
        first, second = (a, b) if a < b else (b, a)
        known[second] = width
        return first, second

    best = -1
    for i in range(count):  # each leaf climbs until it finds a free place; the last one through has won
        winner, node = i, (i + count) // 2
        while node > 0:
            if loser[node] < 0:
                loser[node] = winner
                winner = -1
                break
            winner, loser[node] = play(winner, loser[node])
            node //= 2
        if winner >= 0:
            best = winner
    while count and head[best] is not None:
        yield known[best], best, head[best]
        known[best], head[best] = next(runs[best], (0, None))
        winner, node = best, (best + count) // 2
        while node > 0:
            winner, loser[node] = play(winner, loser[node])
            node //= 2
        best = winner


def _contexts(raw: np.ndarray, ids: np.ndarray, h: np.ndarray, at: np.ndarray, row: np.ndarray, left_n: np.ndarray, right_n: np.ndarray, length: int, w: int) -> tuple[np.ndarray, ...]:
    """The texts about some anchors as sorted rows of bytes, each once for a document: what
    follows the anchor's start, what precedes it backwards, how many bytes those are, and the
    id. With the rows' anchor hashes; and of each anchor its row's number, place and document.
    A long run of one byte has an anchor everywhere and few rows."""
    ahead, back = np.arange(length)[None, :], np.arange(w - 1)[None, :]
    m = np.zeros((len(at), length + w + 9), np.uint8)
    m[:, :length] = np.where(ahead < right_n[:, None], raw[np.minimum(at[:, None] + ahead, len(raw) - 1)], 0)
    m[:, length : length + w - 1] = np.where(back < left_n[:, None], raw[np.maximum(at[:, None] - 1 - back, 0)], 0)
    m[:, length + w - 1], m[:, length + w] = right_n, left_n
    m[:, length + w + 1 :] = (ids[row].astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return *_merged(m, h, np.arange(len(at))), at, row


def _merged(m: np.ndarray, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted rows, each once, with their hashes; of: row numbers, as they are then."""
    order = np.argsort(m.view(f"S{m.shape[1]}").ravel(), kind="stable")
    m = m[order]
    new = an.common(m) < m.shape[1]
    new[:1] = True
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return m[new], h[order][new], number[of]


def _sender(parts: int, k: int, length: int):
    w = length - k + 1

    def send(key: tuple[pa.Scalar, ...], docs: pa.Table, shared: pa.Table) -> pa.Table:
        number = (docs if docs.num_rows else shared)["bucket"][0].as_py()
        out = an.Outbox(number)
        look = an.Shared(shared)
        bucket = Bucket(docs)
        raw, offsets = bucket.bytes_and_offsets()
        if not len(look.h):
            return out.table()
        got, crowd = [], []
        for row, lo, hi in an.pieces(offsets, length):
            a = an.Anchors(raw, lo, hi, k, length)
            found, crowded = look(a.h)
            if crowded.any():
                start, piece, f1, f2 = an.crowded_windows(a, crowded, raw, lo, k, length)
                r = row[piece]
                crowd.append((f1, f2, bucket.ids[r], r, lo[piece] + start - a.starts[piece] - offsets[r]))
            i = np.flatnonzero(found & ~crowded)
            if len(i):
                p, piece = a.p[i], a.piece[i]
                at = lo[piece] + p - a.starts[piece]
                got.append(_contexts(raw, bucket.ids, a.h[i], at, row[piece], np.minimum(p - a.starts[piece], w - 1), np.minimum(a.ends[piece] - p, length), length, w))
        if crowd:
            out.windows(*map(np.concatenate, zip(*crowd, strict=True)), length, parts)
        if got:
            before = np.cumsum([0, *[len(x[0]) for x in got[:-1]]])
            of = np.concatenate([x[2] + n for x, n in zip(got, before.tolist(), strict=True)])
            at, row = (np.concatenate([x[j] for x in got]) for j in (3, 4))
            m, h, of = _merged(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), of)
            del got
            order = np.argsort(of, kind="stable")
            of, at, row = of[order], (at - offsets[row])[order], row[order]
            begin, count = np.searchsorted(of, np.arange(len(m))), np.bincount(of, minlength=len(m))
            right_n, left_n = m[:, length + w - 1].astype(np.int64), m[:, length + w].astype(np.int64)
            doc = bucket.ids[row[begin]]
            new = an.common(m[:, : length + w + 1]) < length + w + 1
            new[:1] = True
            late = doc > doc[new][np.cumsum(new) - 1]  # the same text is in a smaller document of this bucket
            fits = (late & (left_n + right_n >= length))[of]
            out.spans(row[fits], (at - left_n[of])[fits], (at - np.maximum(0, length - right_n[of]) + length)[fits])
            own = np.flatnonzero(~late)
            for part, i in an.by_part(number, an.part_of(h[own], parts)):
                i = own[i]
                lcp, tails = front_code(m[i, : length + w - 1])
                each = np.repeat(begin[i] - np.cumsum(count[i]) + count[i], count[i]) + np.arange(int(count[i].sum()))
                rows, of_row = np.unique(row[each], return_inverse=True)
                out.add(part, kind=0, lcp=lcp, tails=tails, right_n=right_n[i].astype(np.uint8), left_n=left_n[i].astype(np.uint8), n=an.narrow(count[i]), rows=rows.astype(np.int32), docs=bucket.ids[rows], of=an.narrow(of_row), at=an.narrow(at[each]))
        return out.table()

    return send


def _finder(k: int, length: int):
    w = length - k + 1
    width = length + w - 1

    def find(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        inbox = an.Inbox(table)
        if inbox.passed:
            return table
        inbox.windows(length)
        runs = [x for _, x in inbox.texts]
        if runs:
            lcp, run, rows = array("q"), array("q"), bytearray()
            for shared, i, x in merge([decode(x["lcp"], x["tails"], width) for x in runs], width):
                lcp.append(shared)
                run.append(i)
                rows += x
            text = np.frombuffer(rows, np.uint8).reshape(-1, width)
            run = np.frombuffer(run, np.int64)
            take = np.empty(len(run), np.int64)
            take[np.argsort(run, kind="stable")] = np.arange(len(run))  # a run's rows come out in its own order
            right_n, left_n, n = (np.concatenate([x[c].astype(np.int64) for x in runs]) for c in ("right_n", "left_n", "n"))
            doc = np.concatenate([x["docs"][x["of"][np.cumsum(x["n"], dtype=np.int64) - x["n"]]] for x in runs])
            hit = np.empty((len(take), w), bool)
            hit[take] = an.resolve(text, np.frombuffer(lcp, np.int64), right_n[take], left_n[take], doc[take], k, length)
            of = np.repeat(np.arange(len(n)), n)  # each text stands for all its places
            at = np.concatenate([x["at"].astype(np.int64) for x in runs])
            row = np.concatenate([x["rows"][x["of"]] for x in runs]).astype(np.int64)
            bucket = np.repeat([b for b, _ in inbox.texts], [len(x["at"]) for x in runs])
            some = np.flatnonzero(hit.any(axis=1)[of])
            i, lo, hi = an.spans_of_windows(hit[of[some]], at[some], length)
            inbox.spans(bucket[some][i], row[some][i], lo, hi)
        return inbox.table()

    return find


def _finish(key: tuple[pa.Scalar, ...], docs: pa.Table, spans: pa.Table) -> pa.Table:
    bucket = Bucket(docs)
    raw, offsets = bucket.bytes_and_offsets()
    gone = an.covered(spans, offsets)
    removed, runs, digest = [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        mask = gone[a:b]
        n = int(np.count_nonzero(mask))
        removed.append(n)
        runs.append(int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if n else 0)
        digest.append(hashlib.sha256(raw[a:b][~mask] if n else raw[a:b]).hexdigest())
    return pa.table({"doc_id": bucket.doc_id, "n_bytes": np.diff(offsets), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": digest})


def _keep_text(key: tuple[pa.Scalar, ...], docs: pa.Table, spans: pa.Table) -> pa.Table:
    bucket = Bucket(docs)
    raw, offsets = bucket.bytes_and_offsets()
    gone = an.covered(spans, offsets)
    kept, removed = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        kept.append(raw[a:b][~gone[a:b]].tobytes())
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
        removed.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
    return pa.table({"doc_id": bucket.doc_id, "kept": pa.array(kept, pa.binary()), "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", digests: bool = False, crowded: int = an.CROWDED) -> DataFrame:
    """Removes every byte that a string of `length` bytes covers which also starts in a document
    with a smaller id. Returns doc_id, kept (bytes; a cut may fall inside a character) and
    removed (runs of bytes); with digests, their counts and hash instead of the texts."""
    n = bucket_count(docs, text)
    rows = bucketed(docs, n, doc_id, text)
    finish, schema = (_finish, SCHEMA) if digests else (_keep_text, "doc_id long, kept binary, removed array<struct<start:long,end:long>>")
    parts = part_count(n)
    return an.anchored(rows, parts, lambda b: b.bytes_and_offsets(), _sender(parts, gram, length), _finder(gram, length), finish, schema, gram, length, crowded)
