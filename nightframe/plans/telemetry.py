"""Queries over the solve log: roll-ups, latencies, hints carried in time, and the log as a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import aggregates as A
from ..operators import carry, joins
from .bindings import R, r6
from .evaluation import _ranked_sql
from .registry import query


@query("z02_rollup_outcomes", "SELECT outcome, count(*) AS n, min(id) AS first FROM solve_log GROUP BY outcome")
def _(t):
    return A.most_common(t.solve_log, "outcome", "id")


@query("a31_most_common", "SELECT outcome, k, count(*) AS n, min(id) AS first FROM solve_log WHERE outcome <> 'solved' AND k IS NOT NULL GROUP BY ALL")
def _(t):
    """Codes of rejections and failures."""
    other = t.solve_log.where("outcome <> 'solved' and k is not null")
    return other.groupBy("outcome", "k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query("a32_solve_rate", f"SELECT cam, {r6("count_if(outcome = 'solved') / nullif(count_if(outcome <> 'rejected'), 0)")} AS solve_rate FROM solve_log GROUP BY cam")
def _(t):
    """Of those that were completed."""
    solved, done = F.count_if(F.col("outcome") == "solved"), F.count_if(F.col("outcome") != "rejected")
    return t.solve_log.groupBy("cam").agg(R(F.try_divide(solved, done)).alias("solve_rate"))


@query("a33_latency", _ranked_sql("SELECT * FROM solve_log WHERE outcome <> 'rejected'", "outcome", "wall_ms", {"p50": "round_even((n - 1) * 0.5::DOUBLE, 0)", "p95": "round_even((n - 1) * 0.95::DOUBLE, 0)", "top": "n - 1"}))
def _(t):
    done = t.solve_log.where("outcome <> 'rejected'")
    return A.ranked_values(done, ["outcome"], "wall_ms", {"p50": ("half_even", 0.5), "p95": ("half_even", 0.95), "top": ("floor", 1.0)})


#: The upper ends of the histogram's buckets, in degrees, and their labels.
FOV_BUCKETS = ((5, "<5°"), (15, "5–15°"), (30, "15–30°"), (50, "30–50°"), (80, "50–80°"))
FOV_REST, FOV_UNKNOWN = "≥80°", "unknown"


@query("a34_fov_hist", f"""
SELECT CASE WHEN fov IS NULL THEN '{FOV_UNKNOWN}' {" ".join(f"WHEN fov < {hi} THEN '{label}'" for hi, label in FOV_BUCKETS)} ELSE '{FOV_REST}' END AS bucket, count(*) AS n
FROM (SELECT outcome, CASE WHEN k % 7 <> 0 THEN fov END AS fov FROM solve_log) WHERE outcome = 'solved' GROUP BY ALL""")
def _(t):
    """A seventh of the records has no field of view."""
    fov = F.when(F.col("k") % 7 != 0, F.col("fov"))
    bucket = F.when(fov.isNull(), FOV_UNKNOWN)
    for hi, label in FOV_BUCKETS:
        bucket = bucket.when(fov < hi, label)
    return t.solve_log.where("outcome = 'solved'").groupBy(bucket.otherwise(FOV_REST).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("a35_span", "SELECT arg_min(ts, id) AS first_ts, arg_max(ts, id) AS last_ts, count(*) AS n, count_if(k % 3 = 0)::BIGINT AS exif FROM solve_log")
def _(t):
    """The first and the last record of the file, not the earliest and latest."""
    return t.solve_log.agg(F.min_by("ts", "id").alias("first_ts"), F.max_by("ts", "id").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") % 3 == 0).alias("exif"))


@query("p15_split", "SELECT id, outcome = 'rejected' AS rejected, CASE WHEN outcome <> 'rejected' THEN wall_ms END AS wall_ms FROM solve_log")
def _(t):
    rejected = F.col("outcome") == "rejected"
    return t.solve_log.select("id", rejected.alias("rejected"), F.when(~rejected, F.col("wall_ms")).alias("wall_ms"))


@query("f52_nested_default", "SELECT id, coalesce(k, -1) AS k FROM solve_log")
def _(t):
    props = F.from_json("props", "k int, exif struct<present boolean>")
    return t.read("events").select(F.col("event_id").alias("id"), F.coalesce(props["k"], F.lit(-1)).alias("k"))


@query("j14_asof_nearest", """
SELECT l.id, coalesce((SELECT r.fov FROM solve_log r WHERE r.cam = l.cam AND r.outcome = 'solved' ORDER BY abs(epoch_us(r.ts) - epoch_us(l.ts)), r.id LIMIT 1), NULL) AS hint FROM solve_log l WHERE l.outcome <> 'solved'""")
def _(t):
    """To what failed, the field of view solved nearest in time by the same camera."""
    open_ = t.solve_log.where("outcome <> 'solved'").select("id", "cam", "ts")
    return joins.nearest_in_time(open_, t.solve_log.where("outcome = 'solved'").select("id", "cam", "ts", "fov"), ["cam"], "ts", "id", "fov", "hint").select("id", "hint")


@query("w14_upsert", """
SELECT l.id, CASE WHEN l.outcome = 'failed' AND abs(l.fov - r.hint) <= 300 THEN 'solved' ELSE l.outcome END AS outcome, CASE WHEN l.outcome = 'failed' AND abs(l.fov - r.hint) <= 300 THEN r.hint ELSE l.fov END AS fov
FROM solve_log l LEFT JOIN (SELECT cam, max(fov) AS hint FROM solve_log WHERE outcome = 'solved' GROUP BY cam) r USING (cam)""")
def _(t):
    """A second pass takes a row's place only if it solved: here, if the camera's widest field of
    view, as its hint, is not too far from the frame's own."""
    hints = t.solve_log.where("outcome = 'solved'").groupBy("cam").agg(F.max("fov").alias("hint"))
    again = t.solve_log.where("outcome = 'failed'").join(hints, "cam").where("abs(fov - hint) <= 300").select("id", F.lit("solved").alias("again"), F.col("hint"))
    return t.solve_log.join(again, "id", "left").select("id", F.coalesce("again", "outcome").alias("outcome"), F.coalesce("hint", "fov").alias("fov"))


@query("z03_last_fov_carry", """
SELECT id, last_value(CASE WHEN outcome = 'solved' THEN fov END IGNORE NULLS) OVER (PARTITION BY cam ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hint FROM solve_log""")
def _(t):
    """The last solved field of view of a camera goes with its next solve."""
    before = Window.partitionBy("cam").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    return t.solve_log.select("id", F.last(F.when(F.col("outcome") == "solved", F.col("fov")), ignorenulls=True).over(before).alias("hint"))


@query("a15_upper_median", _ranked_sql("SELECT * FROM solve_log WHERE outcome = 'solved'", "cam", "fov", {"median": "least(floor(n * 0.5::DOUBLE), n - 1)"}))
def _(t):
    return A.ranked_values(t.solve_log.where("outcome = 'solved'"), ["cam"], "fov", {"median": ("count", 0.5)})


@query("a41_batch", f"SELECT cam, count_if(outcome = 'solved')::BIGINT AS solved, count(*) AS total, {r6("quantile_cont(CASE WHEN outcome = 'solved' THEN fov END, 0.5)")} AS median FROM solve_log GROUP BY cam")
def _(t):
    solved = F.col("outcome") == "solved"
    return t.solve_log.groupBy("cam").agg(F.count_if(solved).alias("solved"), F.count(F.lit(1)).alias("total"), R(A.median(F.when(solved, F.col("fov")))).alias("median"))


@query("f24_rfc3339", "SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts FROM solve_log")
def _(t):
    return t.solve_log.select("id", C.rfc3339(F.col("ts")).alias("ts"))


_SOURCES = "list_filter(known, lambda s: s.ts IS NOT NULL)"


@query("w13_two_pass_carry", f"""
WITH RECURSIVE frames_of AS (SELECT cam, id, epoch_us(ts) AS ts, outcome = 'solved' AS ok, fov FROM solve_log WHERE outcome <> 'rejected'
), solved_first AS (SELECT cam, list({{'id': id, 'ts': ts, 'fov': fov}} ORDER BY id) AS known, list_sort(list(fov))[count(*) // 2 + 1] AS median FROM frames_of WHERE ok GROUP BY cam
), again AS (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY id) AS i FROM frames_of WHERE NOT ok
), steps AS (
  SELECT cam, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS source, NULL::BOOLEAN AS ok, coalesce(known, []) AS known, median FROM (SELECT DISTINCT cam FROM again) LEFT JOIN solved_first USING (cam)
  UNION ALL
  SELECT cam, i, id, s.id, good, CASE WHEN good THEN list_append(known, {{'id': id, 'ts': ts, 'fov': fov}}) ELSE known END, median FROM (
    SELECT *, coalesce(abs(fov - coalesce(s.fov, median, 0)) <= 12, false) AS good FROM (
      SELECT a.cam, a.i, a.id, a.ts, a.fov, p.known, p.median,
        list_sort(list_transform(p.known, lambda s: {{'d': abs(s.ts - a.ts), 'id': s.id, 'fov': s.fov}}))[1] AS s
      FROM steps p JOIN again a ON a.cam = p.cam AND a.i = p.i + 1))
)
SELECT cam, id, 2 AS pass, ok AS solved, source FROM steps WHERE i > 0 UNION ALL SELECT cam, id, 1, true, NULL FROM frames_of WHERE ok""")
def _(t):
    """A camera's failed frames again, in order (Z07): one is solved if its field of view is near
    that of the frame that helps it, which an earlier one of them may be."""
    log = t.solve_log.where("outcome <> 'rejected'").select(F.col("cam").alias("batch"), F.col("id").alias("pos"), "ts", (F.col("outcome") == "solved").alias("solved"), "fov", F.col("fov").alias("seen"))

    def resolve(rows):
        near = F.abs(F.col("fov") - F.coalesce("hint_seen", "hint_fov", F.lit(0.0))) <= 12
        return rows.select("batch", "pos", F.coalesce(near, F.lit(False)).alias("solved"), "fov", "seen")

    return carry.two_passes(log, resolve, ["seen"]).select(F.col("batch").alias("cam"), F.col("pos").alias("id"), "pass", "solved", "source")
