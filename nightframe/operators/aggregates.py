"""Aggregates: every definition of a percentile by its own name, summaries, track statistics.

Order statistics count each distinct value first and gather no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(x: Column) -> Column:
    """Even counts average the middle two; null for none."""
    return F.percentile(x, F.lit(0.5))


def linear_percentile(x: Column, p: float) -> Column:
    return F.percentile(x, F.lit(min(max(p, 0.0), 100.0) / 100.0))


#: 0-based places in a group of n sorted values, by the name of the definition.
PLACES = {
    "nearest": lambda n, p: F.round((n - 1) * F.lit(p)),  # half away from zero
    "half_even": lambda n, p: F.bround((n - 1) * F.lit(p)),
    "floor": lambda n, p: F.floor((n - 1) * F.lit(p)),
    "count": lambda n, p: F.least(F.floor(n * F.lit(p)), n - 1),  # n * p, at most the last
}


def ranked_values(df: DataFrame, keys: list[str], x: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Order statistics without interpolation: of each group one column for each of wanted, name:
    (definition, p). Values are counted first, so a group of any size becomes its distinct
    values; groups without values have no row."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    counts = counts.withColumn("upto", F.sum("c").over(group.orderBy(x))).withColumn("n", F.sum("c").over(group))
    at = lambda place: F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col(x))
    return counts.groupBy(*keys).agg(*[F.max(at(PLACES[kind](F.col("n"), p))).alias(name) for name, (kind, p) in wanted.items()])


def stat_block(x: Column, prefix: str = "") -> list[Column]:
    """median, p95 and max; 0 for none, and the maximum is at least 0."""
    zero = F.lit(0.0)
    return [
        F.coalesce(median(x), zero).alias(f"{prefix}median"),
        F.coalesce(linear_percentile(x, 95.0), zero).alias(f"{prefix}p95"),
        F.greatest(F.coalesce(F.max(x).cast("double"), zero), zero).alias(f"{prefix}max"),
    ]


def mad_sigma(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, median, mad and sigma = 1.4826 * mad."""
    mid = df.groupBy(*keys).agg(median(F.col(x)).alias("median"))
    off = df.join(mid, keys).withColumn("off", F.abs(F.col(x) - F.col("median")))
    return off.groupBy(*keys).agg(F.first("median").alias("median"), median(F.col("off")).alias("mad")).withColumn("sigma", F.col("mad") * 1.4826)


def clipped_median(df: DataFrame, keys: list[str], x: str, rounds: int = 3, width: float = 3.0) -> DataFrame:
    """Median after dropping, so many times, what is more than width sigmas off; a round that
    would drop all keeps all."""
    kept = df.select(*keys, x)
    for _ in range(rounds):
        s = mad_sigma(kept, keys, x)
        near = kept.join(s, keys).withColumn("near", F.abs(F.col(x) - F.col("median")) <= width * F.col("sigma"))
        near = near.withColumn("some", F.max("near").over(Window.partitionBy(*keys)))
        kept = near.where("near or not some").select(*keys, x)
    return kept.groupBy(*keys).agg(median(F.col(x)).alias("median"))


def circular_mean(deg: Column) -> Column:
    return F.degrees(F.atan2(F.sum(F.sin(F.radians(deg))), F.sum(F.cos(F.radians(deg)))))


def rms(d2: Column) -> Column:
    return F.sqrt(F.avg(d2))


def attempted(status: Column) -> Column:
    return ~status.isin("missing_image", "load_error")


def track_stats(runs: DataFrame, *keys: str) -> DataFrame:
    """n, attempted, solved, solve_rate (of the attempted; null without), missing."""
    s = F.col("status")
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(attempted(s)).alias("attempted"),
        F.count_if(s == "solved").alias("solved"),
        F.try_divide(F.count_if(s == "solved"), F.count_if(attempted(s))).alias("solve_rate"),
        F.count_if(s == "missing_image").alias("missing"),
        F.count_if(s == "load_error").alias("load_errors"),
    )


def counts_by_code(runs: DataFrame, code: str = "code") -> DataFrame:
    return runs.where("status = 'failed'").groupBy(code).agg(F.count(F.lit(1)).alias("n"))


def counts_map(counts: DataFrame, code: str = "code", n: str = "n") -> DataFrame:
    """One row: a map in the order of its keys."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, n)))).alias("counts"))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(a) + F.sum(b)), F.lit(0.0))
    return [ratio(tp, fp).alias("precision"), ratio(tp, fn).alias("recall")]


def gate(current: DataFrame, baseline: DataFrame, percent: float = 10.0) -> DataFrame:
    """Violations of one summary row (solve_rate, p95) against another; missing values pass."""
    base = baseline.select(F.col("solve_rate").alias("base_rate"), F.col("p95").alias("base_p95"))
    both = current.select("solve_rate", "p95").crossJoin(F.broadcast(base))  # two single rows
    limit = F.col("base_p95") * (1.0 + percent / 100.0)
    return both.select(
        F.coalesce(F.col("solve_rate") < F.col("base_rate"), F.lit(False)).alias("rate_regressed"),
        F.coalesce((F.col("base_p95") > 2.220446049250313e-16) & (F.col("p95") > limit), F.lit(False)).alias("axis_regressed"),
    )


def drift(current: DataFrame, repeated: DataFrame, metrics: list[str]) -> DataFrame:
    """The largest relative difference of single rows' metrics."""
    other = repeated.select(*[F.col(m).alias(f"{m}_2") for m in metrics])
    both = current.crossJoin(F.broadcast(other))  # two single rows
    parts = [F.abs(F.col(m) - F.col(f"{m}_2")) / F.greatest(F.abs(F.col(m)), F.lit(1e-6)) for m in metrics]
    return both.select(F.greatest(F.lit(0.0), *parts).alias("drift"))


def most_common(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Values with their counts `n` and `first`, where each was seen first: reports order them by
    falling count, then first sight."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
