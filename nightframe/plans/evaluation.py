"""Queries over evaluation runs: tracks, failures, errors, timings, gates and worst cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import aggregates as A
from ..operators import joins
from .bindings import R, r6
from .registry import query

_DONE = "status NOT IN ('missing_image', 'load_error')"


@query("a01_track_stats", f"""
SELECT track, count(*) AS n, count_if({_DONE})::BIGINT AS attempted, count_if(status = 'solved')::BIGINT AS solved,
  count_if(status = 'solved') / nullif(count_if({_DONE}), 0)::DOUBLE AS solve_rate, count_if(status = 'missing_image')::BIGINT AS missing, count_if(status = 'load_error')::BIGINT AS load_errors
FROM eval_runs GROUP BY track""")
def _(t):
    return A.track_stats(t.eval_runs, "track")


@query("a01_missing_ids", f"SELECT track, status, id FROM eval_runs WHERE NOT ({_DONE})")
def _(t):
    """The runs that a track's report lists as missing or not loadable."""
    return t.eval_runs.where(~A.attempted(F.col("status"))).select("track", "status", "id")


@query("a02_failures_by_code", "SELECT track, code, count(*) AS n FROM eval_runs WHERE status = 'failed' GROUP BY ALL")
def _(t):
    return t.eval_runs.where("status = 'failed'").groupBy("track", "code").agg(F.count(F.lit(1)).alias("n"))


@query("f53_sorted_map", """
SELECT '{' || string_agg('"' || code || '":' || n, ',' ORDER BY code) || '}' AS counts FROM (SELECT code, count(*) AS n FROM eval_runs WHERE status = 'failed' GROUP BY code)""")
def _(t):
    return A.counts_map(A.counts_by_code(t.eval_runs)).select(F.to_json("counts").alias("counts"))


@query("a03_scene_stress", f"SELECT track, count(*) AS n, count_if({_DONE})::BIGINT AS attempted, count_if(status = 'solved')::BIGINT AS solved FROM eval_runs WHERE track <> 'solver' GROUP BY track")
def _(t):
    return A.track_stats(t.eval_runs.where("track <> 'solver'"), "track").select("track", "n", "attempted", "solved")


@query("a03_unexpected_solves", "SELECT id, axis FROM eval_runs WHERE track = 'scene' AND status = 'solved'")
def _(t):
    return t.eval_runs.where("track = 'scene' and status = 'solved'").select("id", "axis")


@query("p14_attempted", f"SELECT id, {_DONE} AS attempted, status = 'solved' AS solved FROM eval_runs")
def _(t):
    return t.eval_runs.select("id", A.attempted(F.col("status")).alias("attempted"), (F.col("status") == "solved").alias("solved"))


TRACKS = ("solver", "scene", "stress")


def chosen_tracks(text: str) -> list[str]:
    """Of a list as it is typed: each track once, in the order of first mention."""
    names = list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))
    if wrong := [x for x in names if x not in TRACKS]:
        raise ValueError(f"no such track: {', '.join(wrong)}")
    return names


@query("p08_track_filter", "SELECT id, track FROM eval_runs WHERE track IN ('stress', 'solver')")
def _(t):
    return t.eval_runs.where(F.col("track").isin(chosen_tracks(" stress, solver,,stress"))).select("id", "track")


@query("u04_track_list", "SELECT cam, list_aggregate(list_sort(list_distinct(list(outcome))), 'string_agg', ',') AS outcomes FROM solve_log GROUP BY cam")
def _(t):
    return t.solve_log.groupBy("cam").agg(F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("outcomes"))


def _block_sql(x: str, name: str) -> str:
    return f"{r6(f'coalesce(quantile_cont({x}, 0.5), 0)')} AS {name}median, {r6(f'coalesce(quantile_cont({x}, 0.95), 0)')} AS {name}p95, {r6(f'greatest(coalesce(max({x}), 0), 0)')} AS {name}max"


def _rounded(columns: list, names: list[str]) -> list:
    return [R(c).alias(n) for c, n in zip(columns, names, strict=True)]


def _block(x, name: str) -> list:
    return _rounded(A.stat_block(x, name), [f"{name}{s}" for s in ("median", "p95", "max")])


@query("a06_stat_block", f"SELECT track, status, {_block_sql('roll_err', '')} FROM eval_runs GROUP BY ALL")
def _(t):
    return t.eval_runs.groupBy("track", "status").agg(*_block(F.col("roll_err"), ""))


@query("a07_pose_stats", f"""
SELECT track, count(roll_err) AS n_gt, count_if(status = 'solved' AND roll_err IS NOT NULL)::BIGINT AS n_compared,
  {_block_sql("CASE WHEN status = 'solved' AND roll_err IS NOT NULL THEN axis END", 'axis_')}, {_block_sql("CASE WHEN status = 'solved' THEN roll_err END", 'roll_')} FROM eval_runs GROUP BY track""")
def _(t):
    """Runs with a roll error are those with a true pose."""
    compared = (F.col("status") == "solved") & F.col("roll_err").isNotNull()
    return t.eval_runs.groupBy("track").agg(F.count("roll_err").alias("n_gt"), F.count_if(compared).alias("n_compared"), *_block(F.when(compared, F.col("axis")), "axis_"), *_block(F.when(compared, F.col("roll_err")), "roll_"))


@query("a08_timing_stats", f"SELECT track, {_block_sql(f'CASE WHEN {_DONE} THEN total_ms END', '')} FROM eval_runs GROUP BY track")
def _(t):
    return t.eval_runs.groupBy("track").agg(*_block(F.when(A.attempted(F.col("status")), F.col("total_ms")), ""))


@query("a04_median", f"SELECT code, {r6('quantile_cont(total_ms, 0.5)')} AS median FROM eval_runs GROUP BY code")
def _(t):
    return t.eval_runs.groupBy("code").agg(R(A.median(F.col("total_ms"))).alias("median"))


@query("a05_pct_linear", f"SELECT code, {r6('quantile_cont(axis, 0.9)')} AS p90, {r6('max(axis)')} AS p100, {r6('min(axis)')} AS p0 FROM eval_runs GROUP BY code")
def _(t):
    p = lambda q: R(A.linear_percentile(F.col("axis"), q))
    return t.eval_runs.groupBy("code").agg(p(90.0).alias("p90"), p(140.0).alias("p100"), p(-3.0).alias("p0"))


def _ranked_sql(source: str, keys: str, x: str, places: dict[str, str]) -> str:
    columns = ", ".join(f"v[1 + ({place})::BIGINT] AS {name}" for name, place in places.items())
    select, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"SELECT {select}{columns} FROM (SELECT {select}list_sort(list({x})) AS v, count({x}) AS n FROM ({source}) WHERE {x} IS NOT NULL {group})"


@query("a11_pct_nearest", _ranked_sql("FROM eval_runs", "track", "total_ms", {"p50": "round((n - 1) * 0.5::DOUBLE)", "p95": "round((n - 1) * 0.95::DOUBLE)"}))
def _(t):
    return A.ranked_values(t.eval_runs, ["track"], "total_ms", {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95)})


@query("a12_pct_half_even", _ranked_sql("FROM eval_runs", "track", "total_ms", {"p50": "round_even((n - 1) * 0.5::DOUBLE, 0)", "p95": "round_even((n - 1) * 0.95::DOUBLE, 0)"}))
def _(t):
    return A.ranked_values(t.eval_runs, ["track"], "total_ms", {"p50": ("half_even", 0.5), "p95": ("half_even", 0.95)})


@query("a13_floor_quantile", _ranked_sql("FROM eval_runs", "code", "axis", {"low": "floor((n - 1) * 0.5::DOUBLE)", "high": "floor((n - 1) * 0.9772::DOUBLE)"}))
def _(t):
    return A.ranked_values(t.eval_runs, ["code"], "axis", {"low": ("floor", 0.5), "high": ("floor", 0.9772)})


_COUNTS = "SELECT track, id % 17 AS tp, id % 5 AS fp, id % 7 AS fn FROM eval_runs"


@query("a09_micro_pr", f"SELECT track, {r6('sum(tp) / (sum(tp) + sum(fp))')} AS precision, {r6('sum(tp) / (sum(tp) + sum(fn))')} AS recall FROM ({_COUNTS}) GROUP BY track")
def _(t):
    counts = t.eval_runs.select("track", (F.col("id") % 17).alias("tp"), (F.col("id") % 5).alias("fp"), (F.col("id") % 7).alias("fn"))
    pr = A.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.groupBy("track").agg(*_rounded(pr, ["precision", "recall"]))


@query("a10_benchmark_summary", f"""
SELECT track, {r6("count_if(status = 'solved') / count(*)")} AS rate, max(axis) AS axis_max, max(total_ms) AS ms_max, any_value(axis_median) AS axis_median, any_value(axis_p95) AS axis_p95, any_value(ms_median) AS ms_median, any_value(ms_p95) AS ms_p95
FROM eval_runs JOIN ({_ranked_sql("FROM eval_runs", "track", "axis", {"axis_median": "round((n - 1) * 0.5::DOUBLE)", "axis_p95": "round((n - 1) * 0.95::DOUBLE)"})}) USING (track)
  JOIN ({_ranked_sql("FROM eval_runs", "track", "total_ms", {"ms_median": "round((n - 1) * 0.5::DOUBLE)", "ms_p95": "round((n - 1) * 0.95::DOUBLE)"})}) USING (track)
GROUP BY track""")
def _(t):
    return benchmark_summary(t, ["track"])


def benchmark_summary(t, keys: list[str]):
    """Solved of all runs, and the distributions of errors and times."""
    runs = t.eval_runs
    rate = F.count_if(F.col("status") == "solved") / F.count(F.lit(1))
    out = runs.groupBy(*keys).agg(R(rate).alias("rate"), F.max("axis").alias("axis_max"), F.max("total_ms").alias("ms_max"))
    for x, name in (("axis", "axis"), ("total_ms", "ms")):
        out = out.join(A.ranked_values(runs, keys, x, {f"{name}_median": ("nearest", 0.5), f"{name}_p95": ("nearest", 0.95)}), keys, "left")
    return out


@query("a40_drift", f"""
WITH s AS (SELECT track, avg(axis) AS a, avg(total_ms) AS b FROM eval_runs GROUP BY track)
SELECT {r6('greatest(abs(x.a - y.a) / greatest(abs(x.a), 1e-6), abs(x.b - y.b) / greatest(abs(x.b), 1e-6))')} AS drift FROM s x, s y WHERE x.track = 'solver' AND y.track = 'scene'""")
def _(t):
    s = lambda track: t.eval_runs.where(F.col("track") == track).agg(F.avg("axis").alias("a"), F.avg("total_ms").alias("b"))
    return A.drift(s("solver"), s("scene"), ["a", "b"]).select(R(F.col("drift")).alias("drift"))


@query("a45_rerun", "SELECT 0.0::DOUBLE AS drift")
def _(t):
    """The same summary worked out twice does not drift."""
    s = lambda: t.eval_runs.agg(F.count_if(F.col("status") == "solved").alias("a"), F.sum("total_ms").alias("b"))
    return A.drift(s(), s(), ["a", "b"])


_GATE = f"SELECT count_if(status = 'solved') / nullif(count_if({_DONE}), 0)::DOUBLE AS solve_rate, quantile_cont(CASE WHEN status = 'solved' THEN axis END, 0.95) AS p95 FROM eval_runs WHERE track = "


@query("j17_gate", f"SELECT coalesce(c.solve_rate < b.solve_rate, false) AS rate_regressed, coalesce(b.p95 > 2.220446049250313e-16 AND c.p95 > b.p95 * 1.1::DOUBLE, false) AS axis_regressed FROM ({_GATE} 'solver') c, ({_GATE} 'scene') b")
def _(t):
    one = lambda track: A.track_stats(t.eval_runs.where(F.col("track") == track), "track").join(t.eval_runs.where((F.col("track") == track) & (F.col("status") == "solved")).groupBy("track").agg(A.linear_percentile(F.col("axis"), 95.0).alias("p95")), "track", "left")
    return A.gate(one("solver"), one("scene"))


@query("o05_worst10", "SELECT id, axis FROM eval_runs WHERE status = 'solved' AND roll_err IS NOT NULL ORDER BY axis DESC, id LIMIT 10")
def _(t):
    """The report is the ten worst."""
    return t.eval_runs.where("status = 'solved' and roll_err is not null").select("id", "axis").orderBy(F.desc("axis"), "id").limit(10)


@query("o06_worst_by_track", "SELECT track, id, error, nth FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY error DESC, id)::INTEGER AS nth FROM (SELECT track, id, CASE status WHEN 'solved' THEN axis WHEN 'failed' THEN 180 ELSE 0 END AS error FROM eval_runs)) WHERE nth <= 5")
def _(t):
    """Rejected runs count as 180 degrees off."""
    error = F.when(F.col("status") == "solved", F.col("axis")).when(F.col("status") == "failed", 180.0).otherwise(0.0)
    nth = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("error"), "id"))
    return t.eval_runs.select("track", "id", error.alias("error")).withColumn("nth", nth).where("nth <= 5")


@query("w07_numbering", "SELECT lpad(nth::VARCHAR, 2, '0') || '_' || id AS name FROM (SELECT id, row_number() OVER (ORDER BY axis DESC, id) AS nth FROM eval_runs WHERE status = 'solved' AND roll_err IS NOT NULL) WHERE nth <= 10")
def _(t):
    worst = t.eval_runs.where("status = 'solved' and roll_err is not null").orderBy(F.desc("axis"), "id").limit(10)
    nth = F.row_number().over(Window.orderBy(F.desc("axis"), "id"))  # of ten rows
    return worst.select(F.concat(F.lpad(nth.cast("string"), 2, "0"), F.lit("_"), F.col("id").cast("string")).alias("name"))


_ASKED = (9, 3, 7, 3)


@query("j05_ids_ordered", f"SELECT a.pos::INTEGER AS pos, r.id, r.track FROM (VALUES {', '.join(f'({i}, {x})' for i, x in enumerate(_ASKED))}) AS a(pos, id) JOIN (SELECT DISTINCT id, track FROM eval_runs) r USING (id)")
def _(t):
    return joins.ordered_lookup(list(_ASKED), t.eval_runs.select("id", "track").distinct(), "id").select("pos", "id", "track")


@query("j06_truth_left", "SELECT e.id, s.dec_deg IS NOT NULL AS has_truth, CASE WHEN s.dec_deg IS NULL THEN 'no ground truth' END AS gt_error FROM eval_runs e LEFT JOIN stars s ON s.star_id = e.id AND s.star_id % 3 <> 0")
def _(t):
    truth = t.stars.where("star_id % 3 <> 0").select(F.col("star_id").alias("id"), F.lit(True).alias("found"))
    has = F.col("found").isNotNull()
    return t.eval_runs.join(truth, "id", "left").select("id", has.alias("has_truth"), F.when(~has, "no ground truth").alias("gt_error"))


@query("p21_missing_anti", "SELECT id FROM eval_runs WHERE id NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    """Runs whose files are not listed."""
    listed = t.read("orders").select(F.col("o_custkey").alias("id"))
    return t.eval_runs.join(listed, "id", "left_anti").select("id")


@query("a36_hypothesis_score", f"SELECT con, {r6('greatest(0.0, least(1.0, avg(exp(-abs(mag) / 3.0::DOUBLE)) * count(proper) / count(*)))')} AS score FROM stars GROUP BY con")
def _(t):
    """Mean likeness times coverage."""
    score = F.avg(F.exp(-F.abs("mag") / 3.0)) * F.count("proper") / F.count(F.lit(1))
    return t.stars.groupBy("con").agg(R(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"))


@query("a43_total_cost", "SELECT code, sum(total_ms)::BIGINT AS bytes, greatest(max(total_ms) - min(total_ms) - 4000, 0)::BIGINT AS cost FROM eval_runs GROUP BY code")
def _(t):
    """What starting cold costs above starting warm, at least nothing."""
    return t.eval_runs.groupBy("code").agg(F.sum("total_ms").alias("bytes"), F.greatest(F.max("total_ms") - F.min("total_ms") - 4000, F.lit(0)).cast("long").alias("cost"))


@query("k14_sweep_table", "SELECT code, '| ' || code || ' | ' || count(*) || ' | ' || count_if(status = 'solved') || ' |' AS line FROM eval_runs GROUP BY code")
def _(t):
    s = A.track_stats(t.eval_runs, "code")
    return s.select("code", F.format_string("| %s | %d | %d |", "code", "n", "solved").alias("line"))


@query("f57_report_rows", f"SELECT id, status, CASE WHEN status = 'solved' THEN {r6('axis')} END AS axis, CASE WHEN status = 'failed' THEN code END AS failure FROM eval_runs")
def _(t):
    s = F.col("status")
    return t.eval_runs.select("id", "status", F.when(s == "solved", R(F.col("axis"))).alias("axis"), F.when(s == "failed", F.col("code")).alias("failure"))


@query("f34_relative_difference", f"SELECT id, {r6('abs(axis - total_ms) / greatest(abs(axis), 1e-6)')} AS difference FROM eval_runs")
def _(t):
    return t.eval_runs.select("id", R(C.relative_difference(F.col("axis"), F.col("total_ms"))).alias("difference"))
