"""Mixing sources to target weights by hierarchical budgeting (operator 4, native).

Leaves are the distinct values of the path columns, such as domain, language, source. A budget
of tokens flows down the tree. Among siblings it is divided by weight; what a child cannot use
(its leaves' tokens times the epochs allowed) goes to its siblings by their weights, and only
what a whole family cannot use was never given to it, so it stays with the ancestors' other
children. Each leaf then reads its documents in epochs, each epoch in an order drawn from the
seed and the epoch's number, and takes exactly its budget from the front: whole epochs first,
then a prefix, whose last document may be taken in part (`taken`; no text is cut).

The prefix is found without sorting a leaf: token sums over 4096 ranges of the order's hash say
in which range it ends, and only that range is put in order.

Cases: a null path value is the value "(none)"; documents without tokens, or with a null text,
are never taken; rows that share an id, or have none, are
ordered by their text as well, so that only rows equal in both may stand for each other; siblings tie by name; extra columns are
carried in `row`, whatever their names; an empty table gives an empty result. Weights are whole and positive; nodes
without a weight have 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import checkpointed, small, written

NONE = "(none)"


def word_count(text: Column) -> Column:
    r"""Words [^\x20\x09-\x0D]+."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))).cast("long")


def weights_table(docs: DataFrame, path: list[str], weights: dict[tuple[str, ...], int]) -> DataFrame:
    """One row for each node that has a weight: depth, node, weight."""
    if any(w < 1 or int(w) != w for w in weights.values()):
        raise ValueError("weights are whole and positive")
    rows = [(len(k), list(k), int(w)) for k, w in weights.items()]
    return docs.sparkSession.createDataFrame(rows, "depth int, node array<string>, weight long")


def divide(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes: parent columns, name, weight, capacity, budget (of the parent). Adds share.

    A child is full if its capacity is at most its part of what is left when all children
    that fill up at a lower level, capacity / weight, have had theirs."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    level = family.orderBy(F.col("capacity") / F.col("weight"), "name")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("below", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    out = out.withColumn("above", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("full", F.expr("cast(capacity as decimal(19,0)) * cast(above as decimal(18,0)) <= cast(budget - below as decimal(19,0)) * cast(weight as decimal(18,0))"))
    out = out.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(family), F.lit(0)))
    out = out.withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(family))
    part = F.expr("case when full then capacity else cast((cast(rest as decimal(19,0)) * cast(weight as decimal(18,0))) div open as long) end")
    out = out.withColumn("part", part)
    out = out.withColumn("odd", F.col("budget") - F.sum("part").over(family))
    out = out.withColumn("nth", F.row_number().over(family.orderBy("full", "name")))
    return out.withColumn("share", F.col("part") + F.when(~F.col("full") & (F.col("nth") <= F.col("odd")), 1).otherwise(0))


def budgets(leaves: DataFrame, path: list[str], weights: dict[tuple[str, ...], int], total: Column, epochs: int) -> DataFrame:
    """leaves: path columns and supply (tokens). Adds share (tokens to take). total: a column
    over supply, the sum of all leaves'. Each level is written before the next one divides it."""
    table = weights_table(leaves, path, weights)
    given = leaves.groupBy().agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("supply")).select(F.least(total.cast("long"), F.col("supply") * epochs).alias("budget"))
    for depth in range(1, len(path) + 1):
        own, parent = path[:depth], path[: depth - 1]
        nodes = leaves.groupBy(*own).agg((F.sum("supply") * epochs).alias("capacity"))
        nodes = nodes.join(given, parent) if parent else nodes.crossJoin(F.broadcast(given))  # one row
        weight = table.where(F.col("depth") == depth).select("node", F.col("weight").alias("own_weight"))
        nodes = nodes.withColumn("node", F.array(*own)).join(F.broadcast(weight), "node", "left").withColumn("weight", F.coalesce("own_weight", F.lit(1).cast("long")))  # weights are a parameter
        given = checkpointed(divide(nodes.withColumn("name", F.col(own[-1])), parent).select(*own, F.col("share").alias("budget")))
    return leaves.join(given, path).withColumnRenamed("budget", "share")


def mix(docs: DataFrame, path: dict[str, Column], weights: dict[tuple[str, ...], int], total: Column, tokens: Column, doc_id: str = "doc_id", seed: int = 0, epochs: int = 3, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """row (the columns of docs, or those named), the path columns, n_tokens, epoch and taken: a
    row for each time that a document is read. path: the tree's levels, from the top. Tokens are
    counted once, and the rows written with their counts."""
    own = [f"path_{i}" for i in range(len(path))]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), *[F.coalesce(x.cast("string"), F.lit(NONE)).alias(n) for n, x in zip(own, path.values(), strict=True)], tokens.alias("n_tokens"), F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("id"))
    base = written(base.where(F.col("n_tokens") > 0))
    leaves = checkpointed(base.groupBy(*own).agg(F.sum("n_tokens").alias("supply")))
    plan = small(budgets(leaves, own, weights, total, epochs).select(*own, F.expr("cast(share div supply as int)").alias("whole"), F.expr("share % supply").alias("rest")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.col("id")))
    keyed = base.join(plan, own).withColumn("key", key)
    # token sums over ranges of the hash; of each leaf, the range in which its prefix ends
    ranges = keyed.where(F.col("rest") > 0).groupBy(*own, F.substring("key", 1, 3).alias("range")).agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    ends = ranges.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("range", "n"))).alias("sums"), F.max("rest").alias("rest"))
    state = F.aggregate(
        "sums",
        F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("string").alias("cut")),
        lambda s, x: F.when(s["cut"].isNotNull(), s).when(s["before"] + x["n"] >= F.col("rest"), F.struct(s["before"].alias("before"), x["range"].alias("cut"))).otherwise(F.struct((s["before"] + x["n"]).alias("before"), s["cut"].alias("cut"))),
    )
    ends = small(ends.withColumn("end", state).select(*own, F.col("end.before").alias("before"), F.col("end.cut").alias("cut")))
    placed = keyed.join(ends, own, "left")
    last = F.col("whole") + 1
    whole = placed.withColumn("epoch", F.explode(F.expr("case when cut is not null and substring(key, 1, 3) < cut then sequence(1, whole + 1) when whole > 0 then sequence(1, whole) else cast(array() as array<int>) end"))).withColumn("taken", F.col("n_tokens"))
    order = Window.partitionBy(*own).orderBy("key", "n_tokens")
    edge = placed.where((F.col("rest") > 0) & (F.substring("key", 1, 3) == F.col("cut"))).withColumn("epoch", last)
    edge = edge.withColumn("start", F.col("before") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    edge = edge.where(F.col("start") < F.col("rest")).withColumn("taken", F.least("n_tokens", F.col("rest") - F.col("start")))
    columns = ["row", *[F.col(a).alias(b) for a, b in zip(own, path, strict=True)], "n_tokens", "epoch", "taken"]
    return whole.select(*columns).unionByName(edge.select(*columns))
