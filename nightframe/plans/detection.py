"""Queries of the whole detector, on 8 x 8 rasters, and the SQL of its steps in a row."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import detector as D
from ..operators import images as I
from .bindings import R, r6
from .evaluation import _ranked_sql
from .raster import SIZE, _clipped
from .registry import query

#: The detector's settings for so small frames.
SMALL = D.Settings(mesh=4, noise_times=1.2, border=1, core_area=1, peak_times=1.0, most_area=5, elongation=2.5, most=3, saturated=0.5, saturated_area=4, concentration=1.3, diffuse_area=3, floor=0.001, apart=2.0)
SMALL_DEEP = replace(SMALL, noise_times=0.8, peak_times=0.7, most=4)
#: Detections that make a frame done in the first tier.
ENOUGH = 2


def _noise_sql(source: str, s: D.Settings, floor: float) -> str:
    inside = f"SELECT frame_id, v FROM {source} WHERE x BETWEEN {s.border} AND {SIZE[0] - 1 - s.border} AND y BETWEEN {s.border} AND {SIZE[1] - 1 - s.border}"
    return f"""SELECT frame_id, CASE WHEN mad >= {floor!r}::DOUBLE THEN mad ELSE greatest((upper - mid) / 2, {floor!r}::DOUBLE) END AS sigma
  FROM (SELECT frame_id, quantile_cont(abs(v - m), 0.5) * 1.4826::DOUBLE AS mad FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY frame_id) AS m FROM ({inside})) GROUP BY frame_id)
  JOIN ({_ranked_sql(inside, "frame_id", "v", {"mid": "floor((n - 1) * 0.5::DOUBLE)", "upper": "floor((n - 1) * 0.9772::DOUBLE)"})}) USING (frame_id)"""


def _detector_sql(s: D.Settings, tag: str, source: str) -> str:
    """Tables, named with the tag, up to `judged` (all blobs) and `kept` (detections)."""
    w, h = SIZE
    last = (w // s.mesh - 1, h // s.mesh - 1)
    kernel = I.gaussian(s.kernel_sigma)
    values = ", ".join(f"({a}, {b}, {k!r}::DOUBLE)" for a, b, k in kernel)
    norm = math.sqrt(sum(k * k for _, _, k in kernel))
    t = lambda name: f"{name}_{tag}"
    cells = _clipped("frame_id, cx, cy", f"SELECT *, x // {s.mesh} AS cx, y // {s.mesh} AS cy FROM {t('flat')}")
    moved = f"SELECT frame_id, label, x, y FROM {t('light')}"
    for _ in range(3):
        weight = "p.v * exp(-((p.x - c.x) ** 2 + (p.y - c.y) ** 2) / 4.5::DOUBLE)"
        moved = f"SELECT c.frame_id, c.label, coalesce(sum({weight} * p.x) / sum({weight}), any_value(c.x)) AS x, coalesce(sum({weight} * p.y) / sum({weight}), any_value(c.y)) AS y FROM ({moved}) c LEFT JOIN {t('resid')} p ON p.frame_id = c.frame_id AND p.v > 0 AND p.x BETWEEN round(c.x) - 5 AND round(c.x) + 5 AND p.y BETWEEN round(c.y) - 5 AND round(c.y) + 5 GROUP BY c.frame_id, c.label"
    fold = f"list_reduce(list([[label::DOUBLE, x, y]] ORDER BY flux DESC, label), lambda kept, q: CASE WHEN len(list_filter(kept, lambda p: (p[2] - q[1][2]) ** 2 + (p[3] - q[1][3]) ** 2 < {s.apart**2}::DOUBLE)) > 0 THEN kept ELSE list_concat(kept, q) END)"
    return f"""{t("columns")} AS (SELECT *, v - quantile_cont(v, 0.5) OVER (PARTITION BY frame_id, x) AS u FROM {source}),
{t("flat")} AS MATERIALIZED (SELECT frame_id, x, y, u - quantile_cont(u, 0.5) OVER (PARTITION BY frame_id, y) AS v FROM {t("columns")}),
{t("grid")} AS MATERIALIZED ({cells}),
{t("placed")} AS (SELECT *, (x + 0.5::DOUBLE) / {s.mesh} - 0.5 AS fx, (y + 0.5::DOUBLE) / {s.mesh} - 0.5 AS fy FROM {t("flat")}),
{t("corners")} AS (
  SELECT frame_id, x, y, v, greatest(0, least({last[0]}, floor(fx) + i)) AS cx, greatest(0, least({last[1]}, floor(fy) + j)) AS cy,
    (CASE i WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE j WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS w
  FROM {t("placed")}, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j)),
{t("resid")} AS MATERIALIZED (SELECT frame_id, x, y, any_value(v) - sum(w * median) AS v FROM {t("corners")} JOIN {t("grid")} USING (frame_id, cx, cy) GROUP BY frame_id, x, y),
{t("noise")} AS MATERIALIZED ({_noise_sql(t("resid"), s, s.floor)}),
{t("conv")} AS MATERIALIZED (SELECT frame_id, x, y, sum(v * k) AS v FROM (SELECT frame_id, x - dx AS x, y - dy AS y, v, k FROM {t("resid")}, (VALUES {values}) AS kernel(dx, dy, k)) WHERE x BETWEEN 0 AND {w - 1} AND y BETWEEN 0 AND {h - 1} GROUP BY frame_id, x, y),
{t("start")} AS ({_noise_sql(t("conv"), s, s.floor * norm)}),
{t("level")} AS (SELECT frame_id, arg_min(threshold, level) AS threshold FROM (
  SELECT frame_id, level, any_value(sigma) * {s.noise_times!r}::DOUBLE * pow(2.0::DOUBLE, level) AS threshold, avg(CASE WHEN v > sigma * {s.noise_times!r}::DOUBLE * pow(2.0::DOUBLE, level) THEN 1.0::DOUBLE ELSE 0.0 END) AS fill
  FROM {t("conv")} JOIN {t("start")} USING (frame_id), range(0, 5) AS l(level) GROUP BY frame_id, level) WHERE fill <= 0.02::DOUBLE OR level = 4 GROUP BY frame_id),
{t("mask")} AS MATERIALIZED (SELECT c.frame_id, c.x, c.y, r.v FROM {t("conv")} c JOIN {t("level")} l ON l.frame_id = c.frame_id JOIN {t("resid")} r ON r.frame_id = c.frame_id AND r.x = c.x AND r.y = c.y WHERE c.v > l.threshold),
{t("reach")} AS (SELECT frame_id, x, y, y::BIGINT * 1048576 + x AS label FROM {t("mask")}
  UNION SELECT m.frame_id, m.x, m.y, r.label FROM {t("reach")} r JOIN {t("mask")} m ON m.frame_id = r.frame_id AND m.x BETWEEN r.x - 1 AND r.x + 1 AND m.y BETWEEN r.y - 1 AND r.y + 1),
{t("blobs")} AS MATERIALIZED (SELECT frame_id, x, y, any_value(v) AS v, min(label) AS label FROM {t("reach")} JOIN {t("mask")} USING (frame_id, x, y) GROUP BY frame_id, x, y),
{t("whole")} AS MATERIALIZED (SELECT frame_id, label, count(*) AS area, max(v) AS peak, any_value(sigma) AS sigma,
    CASE WHEN min(x) < {s.border} OR min(y) < {s.border} OR max(x) >= {w - s.border} OR max(y) >= {h - s.border} THEN 'border' WHEN count_if(v > 3 * sigma) < {s.core_area} THEN 'small' WHEN max(v) < {s.peak_times!r}::DOUBLE * any_value(sigma) THEN 'faint' END AS reason
  FROM {t("blobs")} JOIN {t("noise")} USING (frame_id) GROUP BY frame_id, label),
{t("core")} AS MATERIALIZED (SELECT frame_id, label, b.x, b.y, b.v FROM {t("blobs")} b JOIN {t("whole")} USING (frame_id, label) WHERE reason IS NULL AND (area <= {s.most_area} OR v >= 0.5 * peak)),
{t("middle")} AS (SELECT frame_id, label, count(*) AS core, sum(greatest(v, 0)) AS w, sum(greatest(v, 0) * x) / sum(greatest(v, 0)) AS mx, sum(greatest(v, 0) * y) / sum(greatest(v, 0)) AS my FROM {t("core")} GROUP BY frame_id, label),
{t("moments")} AS (SELECT frame_id, label, any_value(core) AS core, any_value(w) AS w, sum(greatest(v, 0) * (x - mx) ** 2) / any_value(w) AS xx, sum(greatest(v, 0) * (y - my) ** 2) / any_value(w) AS yy, sum(greatest(v, 0) * (x - mx) * (y - my)) / any_value(w) AS xy FROM {t("core")} JOIN {t("middle")} USING (frame_id, label) GROUP BY frame_id, label),
{t("shape")} AS (SELECT frame_id, label, core, CASE WHEN w <= 0 THEN 1.0 ELSE sqrt(((xx + yy) / 2 + root) / greatest((xx + yy) / 2 - root, 1e-12::DOUBLE)) END AS elongation FROM (SELECT *, sqrt(greatest(((xx + yy) / 2) ** 2 - (xx * yy - xy * xy), 0)) AS root FROM {t("moments")})),
{t("second")} AS MATERIALIZED (SELECT w.* EXCLUDE (reason), core, elongation, CASE WHEN reason IS NOT NULL THEN reason WHEN area > {s.most_area} AND core > CASE WHEN peak >= {s.saturated!r}::DOUBLE THEN {s.saturated_area} ELSE {s.most_area} END THEN 'large' WHEN core >= 6 AND elongation > {s.elongation!r}::DOUBLE THEN 'elongated' END AS reason FROM {t("whole")} w LEFT JOIN {t("shape")} USING (frame_id, label)),
{t("ring")} AS (SELECT c.frame_id, c.label, c.x + dx AS x, c.y + dy AS y FROM {t("core")} c, (VALUES {", ".join(str(o) for o in I.AROUND)}) AS o(dx, dy)),
{t("samples")} AS (SELECT frame_id, label, x, y, v FROM {t("core")} UNION ALL SELECT r.frame_id, r.label, r.x, r.y, p.v FROM {t("ring")} r JOIN {t("resid")} p USING (frame_id, x, y) WHERE NOT EXISTS (SELECT 1 FROM {t("core")} c WHERE c.frame_id = r.frame_id AND c.label = r.label AND c.x = r.x AND c.y = r.y)),
{t("light")} AS MATERIALIZED (SELECT frame_id, label, sum(v) AS flux, sum(v * x) / sum(v) AS x, sum(v * y) / sum(v) AS y FROM {t("samples")} WHERE v > 0 GROUP BY frame_id, label),
{t("moved")} AS MATERIALIZED ({moved}),
{t("judged")} AS MATERIALIZED (SELECT s.* EXCLUDE (reason), m.x, m.y, l.flux, CASE WHEN reason IS NOT NULL THEN reason WHEN area BETWEEN {s.diffuse_area} AND {s.most_area} AND peak < {s.saturated!r}::DOUBLE AND peak * area / greatest(flux, 1e-9::DOUBLE) < {s.concentration!r}::DOUBLE THEN 'diffuse' END AS reason
  FROM {t("second")} s LEFT JOIN {t("moved")} m USING (frame_id, label) LEFT JOIN {t("light")} l USING (frame_id, label)),
{t("ranked")} AS (SELECT frame_id, unnest(kept)[1]::BIGINT AS label, unnest(range(0, len(kept)))::INTEGER AS rank FROM (SELECT frame_id, {fold} AS kept FROM {t("judged")} WHERE reason IS NULL GROUP BY frame_id)),
{t("kept")} AS MATERIALIZED (SELECT frame_id, label, rank, {r6("x")} AS x, {r6("y")} AS y, {r6("flux")} AS flux, {r6("flux / (sigma * sqrt(area))")} AS snr, area FROM {t("ranked")} JOIN {t("judged")} USING (frame_id, label) WHERE rank < {s.most})"""


_CLEAN = _detector_sql(SMALL, "a", "pixels")


def shown() -> list:
    return ["frame_id", "label", "rank", *[R(F.col(c)).alias(c) for c in ("x", "y", "flux", "snr")], "area"]


@query("i01_detector", f"WITH RECURSIVE {_CLEAN} SELECT * FROM kept_a")
def _(t):
    return D.detect(t.pixels, SIZE, SMALL)[0].select(*shown())


@query("i01_detector_counts", f"WITH RECURSIVE {_CLEAN} SELECT p.frame_id, {r6('any_value(sigma)')} AS sigma, {r6('any_value(middle)')} AS background_median, count(label) AS candidates, count_if(label IS NOT NULL AND reason IS NULL)::BIGINT AS accepted, {', '.join(f'''count(CASE WHEN reason = '{r}' THEN 1 END) AS {r}''' for r in D.REASONS)} FROM (SELECT frame_id, quantile_cont(v, 0.5) AS middle FROM pixels GROUP BY frame_id) p JOIN noise_a n USING (frame_id) LEFT JOIN (SELECT frame_id, label, reason FROM judged_a) j USING (frame_id) GROUP BY p.frame_id")
def _(t):
    counts = D.detect(t.pixels, SIZE, SMALL)[1]
    return counts.select("frame_id", *[R(F.col(c)).alias(c) for c in ("sigma", "background_median")], "candidates", "accepted", *D.REASONS)


@query("i05_two_tiers", f"""
WITH RECURSIVE {_CLEAN}, done AS MATERIALIZED (SELECT frame_id FROM kept_a GROUP BY frame_id HAVING count(*) >= {ENOUGH}), left_over AS MATERIALIZED (SELECT * FROM pixels WHERE frame_id NOT IN (FROM done)),
{_detector_sql(SMALL_DEEP, "b", "left_over")}
SELECT *, 'clean' AS tier FROM kept_a WHERE frame_id IN (FROM done) UNION ALL SELECT *, 'deep' FROM kept_b""")
def _(t):
    """The deep settings for the frames in which the usual ones find too little."""
    return D.in_two_tiers(t.pixels, SIZE, ENOUGH, SMALL, SMALL_DEEP).select(*shown(), "tier")
