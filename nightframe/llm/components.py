"""Connected components by alternating large and small stars.

The edges never leave the executors. Each round takes two aggregations and two joins; a
partition first contracts its own edges, which makes long chains short. Rounds are cut by
checkpoint() in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed, ensure_checkpoint_dir

EDGES = "a long, b long"
#: Edges whose union-find one task holds in some tens of megabytes.
FEW_EDGES = 300_000


class Union:
    """Union-find whose roots are the least of their sets."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (y := up.get(r, r)) != r:
            r = y
        while (y := up.get(x, x)) != r:
            up[x], x = r, y
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    union = Union()
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            union.join(a, b)
    nodes = list(union.up)
    if nodes:
        roots = [union.root(x) for x in nodes]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Large: a node's greater neighbours are tied to the least of all; small:
    its smaller ones and itself are."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = both.join(least, "a")
    if large:
        out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """edges: a, b long, either way round. Returns node, component (its least node) of every
    node that is greater than its component's least. Once partitions have contracted their own
    edges, `few` edges or fewer are finished by one task; more take rounds over the cluster."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    edges = checkpointed(edges.repartition("b").mapInArrow(_contract, EDGES).distinct())
    if edges.count() <= few:
        return edges.repartition(1).mapInArrow(_contract, EDGES).select(F.col("a").alias("node"), F.col("b").alias("component")).where("node <> component")
    state = None
    while True:
        edges = checkpointed(_star(_star(edges, True), False))
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
