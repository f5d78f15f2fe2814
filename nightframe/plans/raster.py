"""Queries over pixels: the detector's steps one by one, on 8 x 8 rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import images as I
from .bindings import R, r6
from .evaluation import _ranked_sql
from .registry import query

SIZE, MESH = (8, 8), 4
#: A pixel above this is part of a blob.
LEVEL = 0.15


def px(x: str = "v") -> list:
    return ["frame_id", "x", "y", R(F.col(x)).alias(x)]


_PX = f"frame_id, x, y, {r6('v')} AS v"


@query("a29_colrow_median", f"""
WITH a AS (SELECT *, v - quantile_cont(v, 0.5) OVER (PARTITION BY frame_id, x) AS w FROM pixels)
SELECT frame_id, x, y, {r6('w - quantile_cont(w, 0.5) OVER (PARTITION BY frame_id, y)')} AS v FROM a""")
def _(t):
    return I.remove_stripes(t.pixels).select(*px())


@query("a26_mad", f"""
WITH a AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY frame_id) AS m FROM pixels)
SELECT frame_id, {r6('any_value(m)')} AS median, {r6('quantile_cont(abs(v - m), 0.5)')} AS mad, {r6('quantile_cont(abs(v - m), 0.5) * 1.4826')} AS sigma FROM a GROUP BY frame_id""")
def _(t):
    return A.mad_sigma(t.pixels, ["frame_id"], "v").select("frame_id", *[R(F.col(c)).alias(c) for c in ("median", "mad", "sigma")])


def _clipped(keys: str, source: str, rounds: int = 3) -> str:
    for _ in range(rounds):
        source = f"""
SELECT {keys}, v FROM (SELECT *, bool_or(near) OVER (PARTITION BY {keys}) AS any_near FROM (
  SELECT *, abs(v - m) <= 3 * (1.4826::DOUBLE * quantile_cont(abs(v - m), 0.5) OVER (PARTITION BY {keys})) AS near
  FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY {keys}) AS m FROM ({source})))) WHERE near OR NOT any_near"""
    return f"SELECT {keys}, quantile_cont(v, 0.5) AS median FROM ({source}) GROUP BY {keys}"


@query("a27_sigma_clip", f"SELECT frame_id, {r6('median')} AS median FROM ({_clipped('frame_id', 'SELECT * FROM pixels')})")
def _(t):
    return A.clipped_median(t.pixels, ["frame_id"], "v").select("frame_id", R(F.col("median")).alias("median"))


_CELLS = _clipped("frame_id, cx, cy", f"SELECT *, x // {MESH} AS cx, y // {MESH} AS cy FROM pixels")


@query("a28_mesh_median", f"SELECT frame_id, cx::INTEGER AS cx, cy::INTEGER AS cy, {r6('median')} AS median FROM ({_CELLS})")
def _(t):
    return I.mesh_medians(t.pixels, MESH).select("frame_id", "cx", "cy", R(F.col("median")).alias("median"))


_LAST = (SIZE[0] // MESH - 1, SIZE[1] // MESH - 1)


@query("w12_bilinear", f"""
WITH grid AS ({_CELLS}), placed AS (SELECT frame_id, x, y, (x + 0.5::DOUBLE) / {MESH} - 0.5 AS fx, (y + 0.5::DOUBLE) / {MESH} - 0.5 AS fy FROM pixels),
corners AS (
  SELECT frame_id, x, y, greatest(0, least({_LAST[0]}, floor(fx) + i)) AS cx, greatest(0, least({_LAST[1]}, floor(fy) + j)) AS cy,
    (CASE i WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE j WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS w
  FROM placed, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j))
SELECT frame_id, x, y, {r6('sum(w * median)')} AS bg FROM corners JOIN grid USING (frame_id, cx, cy) GROUP BY ALL""")
def _(t):
    return I.background(t.pixels, MESH, SIZE).select(*px("bg"))


KERNEL = I.gaussian(1.2)


@query("w08_convolve", f"SELECT frame_id, x, y, {r6('sum(v * k)')} AS v FROM (SELECT frame_id, x - dx AS x, y - dy AS y, v, k FROM pixels, (VALUES {', '.join(f'({a}, {b}, {k!r}::DOUBLE)' for a, b, k in KERNEL)}) AS kernel(dx, dy, k)) WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY ALL")
def _(t):
    return I.convolve(t.pixels, KERNEL, SIZE).select(*px())


def _blur_sql(sigma: float) -> str:
    import math

    half = math.ceil(3 * sigma)
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-half, half + 1)]
    weights = ", ".join(f"({d}, {k / sum(raw)!r}::DOUBLE)" for d, k in zip(range(-half, half + 1), raw, strict=True))
    step = lambda source, axis, other: f"SELECT t.frame_id, t.x, t.y, sum(s.v * w.k) AS v FROM pixels t, (VALUES {weights}) AS w(d, k), ({source}) s WHERE s.frame_id = t.frame_id AND s.{other} = t.{other} AND s.{axis} = greatest(0, least(7, t.{axis} + w.d)) GROUP BY ALL"
    return f"SELECT {_PX} FROM ({step(step('SELECT * FROM pixels', 'x', 'y'), 'y', 'x')})"


@query("w09_blur", _blur_sql(0.7))
def _(t):
    return I.blur(t.pixels, 0.7, SIZE).select(*px())


@query("j22_local_max", f"SELECT {_PX} FROM pixels p WHERE NOT EXISTS (SELECT 1 FROM pixels q WHERE q.frame_id = p.frame_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.v > p.v)")
def _(t):
    return I.local_maxima(t.pixels).select(*px())


@query("i04_simple_detector", f"SELECT {_PX} FROM pixels p WHERE v > {LEVEL} AND NOT EXISTS (SELECT 1 FROM pixels q WHERE q.frame_id = p.frame_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.v > p.v)")
def _(t):
    """Threshold and local maxima, before suppression."""
    return I.local_maxima(t.pixels, above=LEVEL).select(*px())


@query("p19_adaptive_threshold", """
SELECT frame_id, min(level)::INTEGER AS level, arg_min(threshold, level) AS threshold FROM (
  SELECT frame_id, level, 0.05::DOUBLE * pow(2.0::DOUBLE, level) AS threshold, avg(CASE WHEN v > 0.05::DOUBLE * pow(2.0::DOUBLE, level) THEN 1.0::DOUBLE ELSE 0.0 END) AS fill FROM pixels, range(0, 5) AS l(level) GROUP BY ALL)
WHERE fill <= 0.02::DOUBLE OR level = 4 GROUP BY frame_id""")
def _(t):
    return I.adaptive_threshold(t.pixels, F.lit(0.05)).select("frame_id", F.col("level").cast("int").alias("level"), "threshold")


@query("a44_mask_fill", f"SELECT frame_id, {r6(f'count_if(v > {LEVEL}::DOUBLE) / count(*)')} AS fill FROM pixels GROUP BY frame_id")
def _(t):
    return t.pixels.groupBy("frame_id").agg(R(F.avg((F.col("v") > LEVEL).cast("int"))).alias("fill"))


_LABELS = f"""
WITH RECURSIVE mask AS (SELECT frame_id, x, y, v FROM pixels WHERE v > {LEVEL}::DOUBLE), reach AS (
  SELECT frame_id, x, y, y::BIGINT * 1048576 + x AS label FROM mask
  UNION SELECT m.frame_id, m.x, m.y, r.label FROM reach r JOIN mask m ON m.frame_id = r.frame_id AND m.x BETWEEN r.x - 1 AND r.x + 1 AND m.y BETWEEN r.y - 1 AND r.y + 1
), blobs AS (SELECT frame_id, x, y, any_value(v) AS v, min(label) AS label FROM reach JOIN mask USING (frame_id, x, y) GROUP BY frame_id, x, y)"""


def blobs(t):
    """Pixels of the mask with their blob's label."""
    mask = t.pixels.where(F.col("v") > LEVEL)
    return I.components(mask).join(mask, ["frame_id", "x", "y"])


@query("u06_components", f"{_LABELS} SELECT frame_id, x, y, label FROM blobs")
def _(t):
    return blobs(t).select("frame_id", "x", "y", "label")


_SHAPES = f"""{_LABELS}, sums AS (
  SELECT frame_id, label, sum(v) AS w, sum(v * x) / sum(v) AS cx, sum(v * y) / sum(v) AS cy FROM blobs GROUP BY ALL
), moments AS (
  SELECT b.frame_id, b.label, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, max(v) AS peak, any_value(w) AS flux, any_value(cx) AS cx, any_value(cy) AS cy,
    sum(v * (x - cx) * (x - cx)) / any_value(w) AS mxx, sum(v * (y - cy) * (y - cy)) / any_value(w) AS myy, sum(v * (x - cx) * (y - cy)) / any_value(w) AS mxy
  FROM blobs b JOIN sums s ON b.frame_id = s.frame_id AND b.label = s.label GROUP BY b.frame_id, b.label
), shapes AS (
  SELECT *, sqrt(((mxx + myy) / 2 + root) / greatest((mxx + myy) / 2 - root, 1e-12::DOUBLE)) AS elongation
  FROM (SELECT *, sqrt(greatest(((mxx + myy) / 2) ** 2 - (mxx * myy - mxy * mxy), 0)) AS root FROM moments)
)"""


@query("a24_centroid", f"{_SHAPES} SELECT frame_id, label, {r6('flux')} AS flux, {r6('cx')} AS cx, {r6('cy')} AS cy FROM shapes")
def _(t):
    return I.blob_shapes(blobs(t)).select("frame_id", "label", *[R(F.col(c)).alias(c) for c in ("flux", "cx", "cy")])


@query("a25_elongation", f"{_SHAPES} SELECT frame_id, label, {r6('elongation')} AS elongation FROM shapes WHERE area > 2 AND elongation < 50")
def _(t):
    """Thin blobs have no finite one."""
    s = I.blob_shapes(blobs(t)).where("area > 2 and elongation < 50")
    return s.select("frame_id", "label", R(F.col("elongation")).alias("elongation"))


@query("a46_bounding_box", f"{_SHAPES} SELECT frame_id, label, area, min_x, max_x, min_y, max_y FROM shapes")
def _(t):
    return I.blob_shapes(blobs(t)).select("frame_id", "label", "area", "min_x", "max_x", "min_y", "max_y")


_REJECT = f"""{_SHAPES}, judged AS (SELECT frame_id, label, area, flux, min_y, min_x, CASE WHEN min_x < 1 OR min_y < 1 OR max_x >= 7 OR max_y >= 7 THEN 'border' WHEN area < 2 THEN 'small' WHEN peak < 0.2::DOUBLE THEN 'faint'
  WHEN area > 8 THEN 'large' WHEN area >= 6 AND elongation > 2.5::DOUBLE THEN 'elongated' WHEN area >= 3 AND peak < 0.9::DOUBLE AND peak * area / greatest(flux, 1e-9::DOUBLE) < 1.3::DOUBLE THEN 'diffuse' END AS reason FROM shapes)"""
_FILTERS = {"border": 1, "size": SIZE, "least_area": 2, "least_peak": 0.2, "most_area": 8, "most_elongation": 2.5, "diffuse_area": 3, "least_concentration": 1.3, "saturated": 0.9}


def judged(t):
    return I.blob_shapes(blobs(t)).withColumn("reason", I.reject_reason(**_FILTERS))


@query("p18_reject_reason", f"{_REJECT} SELECT frame_id, label, reason FROM judged")
def _(t):
    return judged(t).select("frame_id", "label", "reason")


@query("a30_reject_counts", f"{_REJECT} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM judged GROUP BY ALL")
def _(t):
    return judged(t).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("w01_flux_rank", f"{_SHAPES} SELECT frame_id, label, (row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, label) - 1)::INTEGER AS rank FROM shapes")
def _(t):
    return I.ranked(I.blob_shapes(blobs(t)), ties=("label",)).select("frame_id", "label", "rank")


@query("o03_top_detections", f"{_SHAPES} SELECT frame_id, label, rank FROM (SELECT frame_id, label, (row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, label) - 1)::INTEGER AS rank FROM shapes) WHERE rank < 3")
def _(t):
    return I.ranked(I.blob_shapes(blobs(t)), ties=("label",), top=3).select("frame_id", "label", "rank")


@query("w02_intensity_rank", "SELECT frame_id, x, y, row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, y, x)::INTEGER AS rank FROM pixels")
def _(t):
    return I.ranked(t.pixels, flux="v").select("frame_id", "x", "y", (F.col("rank") + 1).alias("rank"))


@query("j23_ring", f"{_LABELS} SELECT frame_id, label, x, y, count(*) AS times FROM (SELECT frame_id, label, x + dx AS x, y + dy AS y FROM blobs, (VALUES {', '.join(str(o) for o in I.AROUND)}) AS o(dx, dy)) r WHERE NOT EXISTS (SELECT 1 FROM blobs b WHERE b.frame_id = r.frame_id AND b.label = r.label AND b.x = r.x AND b.y = r.y) GROUP BY ALL")
def _(t):
    """A pixel of the ring counts once for each pixel of the blob that it touches."""
    return I.dilation_ring(blobs(t)).groupBy("frame_id", "label", "x", "y").agg(F.count(F.lit(1)).alias("times"))


@query("u03_ring_difference", f"{_LABELS} SELECT DISTINCT frame_id, label, x + dx AS x, y + dy AS y FROM blobs, (VALUES {', '.join(str(o) for o in I.AROUND)}) AS o(dx, dy) EXCEPT SELECT frame_id, label, x, y FROM blobs")
def _(t):
    own = blobs(t).select("frame_id", "label", "x", "y")
    return I.scatter(own, I.AROUND).select(own.columns).distinct().join(own, own.columns, "left_anti")


@query("i03_half_peak_core", f"{_LABELS} SELECT frame_id, label, x, y FROM (SELECT *, max(v) OVER w AS peak, count(*) OVER w AS area FROM blobs WINDOW w AS (PARTITION BY frame_id, label)) WHERE area <= 8 OR v >= 0.5 * peak")
def _(t):
    return I.half_peak_cores(blobs(t), 8).select("frame_id", "label", "x", "y")


@query("i02_noise", f"""
WITH inside AS (SELECT * FROM pixels WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6), m AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY frame_id) AS m FROM inside),
s AS (SELECT frame_id, 1.4826::DOUBLE * quantile_cont(abs(v - m), 0.5) AS sigma FROM m GROUP BY frame_id), q AS ({_ranked_sql("SELECT * FROM inside", "frame_id", "v", {"mid": "floor((n - 1) * 0.5::DOUBLE)", "upper": "floor((n - 1) * 0.9772::DOUBLE)"})})
SELECT frame_id, {r6("CASE WHEN sigma >= 0.08::DOUBLE THEN sigma ELSE greatest((upper - mid) / 2, 0.08::DOUBLE) END")} AS sigma FROM s JOIN q USING (frame_id)""")
def _(t):
    return I.noise_sigma(t.pixels, SIZE, 1, 0.08).select("frame_id", R(F.col("sigma")).alias("sigma"))


def _refine_sql(half: int, sigma: float, rounds: int) -> str:
    source = "SELECT frame_id, label, cx AS x, cy AS y FROM shapes"
    for _ in range(rounds):
        w = f"p.v * exp(-((p.x - c.x) ** 2 + (p.y - c.y) ** 2) / {2 * sigma * sigma!r}::DOUBLE)"
        source = f"SELECT c.frame_id, c.label, coalesce(sum({w} * p.x) / sum({w}), any_value(c.x)) AS x, coalesce(sum({w} * p.y) / sum({w}), any_value(c.y)) AS y FROM ({source}) c LEFT JOIN pixels p ON p.frame_id = c.frame_id AND p.v > 0 AND p.x BETWEEN round(c.x) - {half} AND round(c.x) + {half} AND p.y BETWEEN round(c.y) - {half} AND round(c.y) + {half} GROUP BY c.frame_id, c.label"
    return f"{_SHAPES} SELECT frame_id, label, {r6('x')} AS x, {r6('y')} AS y FROM ({source})"


@query("w10_refine_centroid", _refine_sql(2, 1.5, 3))
def _(t):
    points = I.blob_shapes(blobs(t)).select("frame_id", "label", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return I.refine_centroids(points, t.pixels, "label", half=2).select("frame_id", "label", R(F.col("x")).alias("x"), R(F.col("y")).alias("y"))


_BYTE = "SELECT frame_id, least(255, greatest(0, floor(v * 400 + 100)))::INTEGER AS q FROM pixels"


@query("a14_inspect", _ranked_sql(_BYTE, "frame_id", "q", {"lowest": "0", "highest": "n - 1", "middle": "floor(n * 0.5::DOUBLE)", "upper": "least(floor(n * 0.99::DOUBLE), n - 1)"}))
def _(t):
    q = t.pixels.select("frame_id", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("v") * 400 + 100))).cast("int").alias("q"))
    return A.ranked_values(q, ["frame_id"], "q", {"lowest": ("floor", 0.0), "highest": ("floor", 1.0), "middle": ("count", 0.5), "upper": ("count", 0.99)})


@query("a16_stretch_ends", _ranked_sql("SELECT frame_id, v FROM pixels", "frame_id", "v", {"low": "round((n - 1) * 0.1::DOUBLE)", "high": "round((n - 1) * 0.9995::DOUBLE)"}))
def _(t):
    return A.ranked_values(t.pixels, ["frame_id"], "v", {"low": ("nearest", 0.1), "high": ("nearest", 0.9995)})


@query("a17_every7", f"SELECT frame_id, {r6('quantile_cont(v, 0.05)')} AS low, {r6('quantile_cont(v, 0.95)')} AS high FROM pixels WHERE (y * 8 + x) % 7 = 0 GROUP BY frame_id")
def _(t):
    """From every seventh pixel: the estimator's own definition."""
    some = t.pixels.where((F.col("y") * 8 + F.col("x")) % 7 == 0)
    return some.groupBy("frame_id").agg(R(A.linear_percentile(F.col("v"), 5.0)).alias("low"), R(A.linear_percentile(F.col("v"), 95.0)).alias("high"))


@query("f42_stretch", f"""
SELECT frame_id, x, y, round(least(1.0, greatest(0.0, (v - low) / greatest(high - low, 1e-6::DOUBLE))) * 255)::INTEGER AS q
FROM pixels JOIN ({_ranked_sql("SELECT frame_id, v FROM pixels", "frame_id", "v", {"low": "round((n - 1) * 0.1::DOUBLE)", "high": "round((n - 1) * 0.9995::DOUBLE)"})}) USING (frame_id)""")
def _(t):
    ends = A.ranked_values(t.pixels, ["frame_id"], "v", {"low": ("nearest", 0.1), "high": ("nearest", 0.9995)})
    share = (F.col("v") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))
    return t.pixels.join(ends, "frame_id").select("frame_id", "x", "y", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * 255).cast("int").alias("q"))
