"""Exact top-k search by tiled matrix products (operator 1).

Queries and candidates are each dealt into groups by a hash of their id. A cell is one group
of queries against one group of candidates; every candidate meets every query in exactly one
cell. A cell multiplies tile by tile, keeps each query's best of a tile, and merges the tiles.
The lists of the cells are merged as a tree of window limits, which Spark also applies before
each shuffle. Queries are a stated set; nothing is broadcast or collected.

Cases: a vector that is null, or holds a null, NaN or infinity, takes no part, nor does a null
id; vectors meet only those of as many components, and empty ones score 0. Ties go to the smaller id. Candidates that
repeat an id count as often as they occur; of queries that repeat an id the least vector asks,
and no row with its id is a candidate of it. Scores beyond a long are held at its limits.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import shuffle_partitions

#: Rows of a tile; a cell holds up to WIDE tiles of each side.
QUERY_ROWS, CANDIDATE_ROWS, WIDE = 1024, 4096, 4
#: Lists merged at once in the tree.
FAN_IN = 64


def scaled(x: Column) -> Column:
    """floor(64 * x) of each component, as whole doubles."""
    return F.transform(x.cast("array<double>"), lambda v: F.when(F.abs(v) < 2.0**46, F.floor(v * 64.0).cast("double")).otherwise(v * 64.0))


def usable(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    v = F.col(vector)
    return rows.where(F.col(row_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select(F.col(row_id).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def _select(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the k greatest and of equal ones the leftmost: row and column numbers."""
    if score.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(score.shape))
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
    above, equal = score > least, score == least
    need = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= need)))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    ids = table["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    values = table["v"].combine_chunks()
    flat = values.flatten() if not isinstance(values, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in values.chunks])
    return ids[order], flat.to_numpy().reshape(len(ids), -1)[order]


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles hold whole numbers below 2**53; beyond, Python's integers do."""
    top = (float(np.abs(q).max(initial=0)) + 1) * (float(np.abs(c).max(initial=0)) + 1) * max(1, q.shape[1])
    if top < 2.0**53:
        return q @ c.T
    return np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in c], object).T


def _cell(k: int):
    def cell(key: tuple[pa.Scalar, ...], queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and candidates.num_rows:
            q_id, q = _matrix(queries)
            c_id, c = _matrix(candidates)
            for i in range(0, len(q_id), QUERY_ROWS):
                qi = q_id[i : i + QUERY_ROWS]
                parts = []
                for j in range(0, len(c_id), CANDIDATE_ROWS):
                    ci = c_id[j : j + CANDIDATE_ROWS]
                    score = _product(q[i : i + QUERY_ROWS], c[j : j + CANDIDATE_ROWS])
                    own = qi[:, None] == ci[None, :]
                    if own.any():
                        score = score.astype(object) if score.dtype == object else score
                        score[own] = -np.inf
                    r, s = _select(score, k)
                    ok = ~own[r, s]
                    parts.append((r[ok], ci[s[ok]], score[r[ok], s[ok]]))
                r, ids, s = (np.concatenate(x) for x in zip(*parts, strict=True))
                if s.dtype == object:
                    s = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in s], np.int64)
                s = s.astype(np.int64)
                order = np.lexsort((ids, ~s, r))  # ~s falls as s rises, without overflow
                r = r[order]
                begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
                nth = np.arange(len(r)) - np.repeat(begin, np.diff(np.r_[begin, len(r)]))
                best = nth < k
                out.append((qi[r[best]], ids[order][best], s[order][best]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        part = key[1].as_py() if key[1].is_valid else 0
        return pa.table({"part": pa.array(np.full(len(a), part, np.int32)), "query_id": a, "vec_id": b, "score": c})

    return cell


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """queries, candidates: id long, v array<double> of whole numbers, as usable() gives them.
    Returns query_id, rank, vec_id, score."""
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    tiles = lambda df, rows: max(1, -(-df.count() // rows))
    n_q, n_c = tiles(queries, QUERY_ROWS), tiles(candidates, CANDIDATE_ROWS)
    wide = min(WIDE, max(1, isqrt(n_q * n_c // (4 * shuffle_partitions(queries.sparkSession)))))
    n_q, n_c = -(-n_q // wide), -(-n_c // wide)
    side = lambda df, n, own, other, m: df.select(F.col("id").alias("id"), F.col("v").alias("v"), F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q = side(queries, n_q, "of_q", "of_c", n_c).groupBy("dim", "of_c", "of_q")
    c = side(candidates, n_c, "of_c", "of_q", n_q).groupBy("dim", "of_c", "of_q")
    best = q.cogroup(c).applyInArrow(_cell(k), "part int, query_id long, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]
    while n_c > FAN_IN:
        n_c = -(-n_c // FAN_IN)
        best = best.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
