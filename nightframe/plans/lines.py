"""Queries over polylines: counts, pieces along great circles, runs on the screen, the overlay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import sphere as S
from ..operators import joins, views
from ..operators import polylines as P
from ..operators.views import each
from .bindings import FOCAL, HEIGHT, WIDTH, R, r6, unit_sql
from .registry import query


@query("a19_counts", "SELECT count(DISTINCT line_id) AS lines, count(*) AS vertices FROM polylines")
def _(t):
    return t.polylines.groupBy("line_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("vertices"))


@query("p06_two_vertices", "SELECT line_id, count(*) AS n FROM (SELECT * FROM polylines WHERE line_id % 5 <> 0 OR seq = 0) GROUP BY line_id HAVING count(*) >= 2")
def _(t):
    """Every fifth line is cut to one vertex, so it goes."""
    some = t.polylines.where((F.col("line_id") % 5 != 0) | (F.col("seq") == 0))
    return some.groupBy("line_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("f50_flatten", "SELECT line_id, count(*) AS vertices, min(seq)::BIGINT AS first FROM polylines GROUP BY line_id")
def _(t):
    """Nested lines, flattened again."""
    nested = t.polylines.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ra", "dec"))).alias("line")).select("line_id", F.array("line").alias("lines"))
    flat = nested.select("line_id", F.explode(F.flatten("lines")).alias("v"))
    return flat.groupBy("line_id").agg(F.count(F.lit(1)).alias("vertices"), F.min("v.seq").alias("first"))


@query("j01_names_left", "SELECT l.line_id, l.abbr, coalesce(n.name, l.abbr) AS name FROM (SELECT DISTINCT line_id, 'C' || (line_id % 25) AS abbr FROM polylines) l LEFT JOIN names n ON n.abbr = l.abbr")
def _(t):
    lines = t.polylines.select("line_id", F.concat(F.lit("C"), (F.col("line_id") % 25).cast("string")).alias("abbr")).distinct()
    return joins.with_default(lines, t.names, "abbr", "name", F.col("abbr")).select("line_id", "abbr", "name")


@query("w04_adjacent", f"SELECT line_id, seq, {r6('ra')} AS ra, {r6('dec')} AS dec, {r6('ra2')} AS ra2, {r6('dec2')} AS dec2 FROM (SELECT *, lead(ra) OVER w AS ra2, lead(dec) OVER w AS dec2 FROM polylines WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE ra2 IS NOT NULL")
def _(t):
    return P.segments(t.polylines).select("line_id", "seq", *[R(F.col(c)).alias(c) for c in ("ra", "dec", "ra2", "dec2")])


_U, _V = unit_sql("ra", "dec"), unit_sql("ra2", "dec2")
_SEGMENTS = f"SELECT *, {_U[0]} * {_V[0]} + {_U[1]} * {_V[1]} + {_U[2]} * {_V[2]} AS d FROM (SELECT *, lead(ra) OVER w AS ra2, lead(dec) OVER w AS dec2 FROM polylines WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE ra2 IS NOT NULL"
_SLERP = [f"(p * {a} + q * side * {b})" for a, b in zip(_U, _V, strict=True)]
_PIECES = f"""
WITH segments AS ({_SEGMENTS}), pieces AS (
  SELECT *, unnest(range(1, pieces + 1)) AS piece FROM (SELECT *, greatest(1, ceil(degrees(acos(greatest(-1.0, least(1.0, d)))) / 1.0))::BIGINT AS pieces FROM segments)
), weights AS (
  SELECT *, CASE WHEN d < 0 THEN -1.0 ELSE 1.0 END AS side, piece::DOUBLE / pieces AS t, acos(greatest(-1.0, least(1.0, abs(d)))) AS angle FROM pieces
), mixed AS (
  SELECT *, CASE WHEN abs(d) > 0.9995 THEN (1 - t) / sqrt((1 - t) ** 2 + t ** 2 + 2 * t * (1 - t) * abs(d)) ELSE sin((1 - t) * angle) / sin(angle) END AS p,
    CASE WHEN abs(d) > 0.9995 THEN t / sqrt((1 - t) ** 2 + t ** 2 + 2 * t * (1 - t) * abs(d)) ELSE sin(t * angle) / sin(angle) END AS q FROM weights
), tessellated AS (
  SELECT line_id, seq, piece::INTEGER AS piece, CASE WHEN pieces = 1 THEN ra2 ELSE CASE WHEN degrees(atan2({_SLERP[1]}, {_SLERP[0]})) < 0 THEN 360 ELSE 0 END + degrees(atan2({_SLERP[1]}, {_SLERP[0]})) END AS ra,
    CASE WHEN pieces = 1 THEN dec2 ELSE degrees(asin(greatest(-1.0, least(1.0, {_SLERP[2]})))) END AS dec FROM mixed
  UNION ALL SELECT line_id, seq, 0, ra, dec FROM polylines WHERE seq = 0
)"""


@query("g04_slerp", f"{_PIECES} SELECT line_id, seq, piece::INTEGER AS piece, {', '.join(f'{r6(x)} AS {c}' for c, x in zip('xyz', _SLERP, strict=True))} FROM mixed")
def _(t):
    s = P.segments(t.polylines)
    u, v = S.unit(F.col("ra"), F.col("dec")), S.unit(F.col("ra2"), F.col("dec2"))
    s = s.withColumn("u", u.struct()).withColumn("v", v.struct())
    s = s.withColumn("pieces", F.greatest(F.lit(1), F.ceil(S.separation(F.col("u"), F.col("v")))).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("pieces"))))
    at = S.slerp(F.col("u"), F.col("v"), F.col("piece") / F.col("pieces"))
    return s.select("line_id", "seq", "piece", *[R(x).alias(c) for c, x in zip("xyz", at, strict=True)])


@query("w05_tessellate", f"{_PIECES} SELECT line_id, seq, piece, {r6('ra')} AS ra, {r6('dec')} AS dec FROM tessellated")
def _(t):
    return P.tessellate(t.polylines).select("line_id", "seq", "piece", R(F.col("ra")).alias("ra"), R(F.col("dec")).alias("dec"))


#: A line is drawn in one frame here: the one with its number.
_W = unit_sql("ra", "dec")
_SCREEN = f"""{_PIECES}, screen AS (
  SELECT line_id, seq, piece, CASE WHEN cz > 0.05 THEN {WIDTH} / 2.0 + {FOCAL} * cx / cz END AS x, CASE WHEN cz > 0.05 THEN {HEIGHT} / 2.0 - {FOCAL} * cy / cz END AS y FROM (
    SELECT p.*, f.rx * {_W[0]} + f.ry * {_W[1]} + f.rz * {_W[2]} AS cx, f.ux * {_W[0]} + f.uy * {_W[1]} + f.uz * {_W[2]} AS cy, f.fx * {_W[0]} + f.fy * {_W[1]} + f.fz * {_W[2]} AS cz
    FROM tessellated p JOIN frame_rot f ON f.frame_id = p.line_id % 10)
), marked AS (SELECT *, coalesce(x BETWEEN -1500 AND {WIDTH} + 1500 AND y BETWEEN -1500 AND {HEIGHT} + 1500, false) AS visible FROM screen
), runs AS (SELECT *, count(*) OVER (PARTITION BY line_id, run) AS size FROM (SELECT *, sum(CASE WHEN visible THEN 0 ELSE 1 END) OVER (PARTITION BY line_id ORDER BY seq, piece) AS run FROM marked) WHERE visible)"""


def screen(t):
    """A wide margin, as few lines would be seen in frames of 22 degrees."""
    pieces = P.tessellate(t.polylines).withColumn("frame_id", F.col("line_id") % 10)
    return P.on_screen(pieces, t.frames, margin=1500.0)


@query("p13_margin", f"{_SCREEN} SELECT line_id, seq, piece, visible FROM marked")
def _(t):
    return screen(t).select("line_id", "seq", "piece", "visible")


@query("w06_islands", f"{_SCREEN} SELECT line_id, run::BIGINT AS run, count(*) AS n FROM runs WHERE size >= 2 GROUP BY ALL")
def _(t):
    runs = P.islands(screen(t), ["line_id"], ["seq", "piece"], "visible")
    return runs.groupBy("line_id", "run").agg(F.count(F.lit(1)).alias("n"))


@query("g28_project_split", f"{_SCREEN} SELECT line_id, run::BIGINT AS run, seq, piece, {r6('x')} AS x, {r6('y')} AS y FROM runs WHERE size >= 2")
def _(t):
    runs = P.islands(screen(t), ["line_id"], ["seq", "piece"], "visible")
    return runs.select("line_id", "run", "seq", "piece", R(F.col("x")).alias("x"), R(F.col("y")).alias("y"))


@query("a22_label_xy", f"{_SCREEN} SELECT line_id, {r6('avg(x)')} AS x, {r6('avg(y)')} AS y, count(*) AS n FROM runs WHERE size >= 2 AND x >= 0 AND x < {WIDTH} AND y >= 0 AND y < {HEIGHT} GROUP BY line_id HAVING count(*) >= 2")
def _(t):
    runs = P.islands(screen(t), ["line_id"], ["seq", "piece"], "visible")
    return P.label_place(runs, ["line_id"], WIDTH, HEIGHT).select("line_id", R(F.col("x")).alias("x"), R(F.col("y")).alias("y"), "n")


@query("g17_grid", """
SELECT 'ra' AS kind, v::INTEGER AS value, ((d + 80) // 2)::INTEGER AS seq, v::DOUBLE AS ra, d::DOUBLE AS dec FROM range(0, 360, 15) a(v), range(-80, 81, 2) b(d)
UNION ALL SELECT 'dec', v::INTEGER, (d // 2)::INTEGER, d::DOUBLE, v::DOUBLE FROM range(-80, 81, 10) a(v), range(0, 360, 2) b(d)""")
def _(t):
    return P.grid(t.spark)


@query("j04_edge_double", "SELECT a.line_id, a.seq, a.mag AS mag, b.mag AS mag2 FROM (SELECT line_id, seq, s.mag FROM polylines JOIN stars s ON s.star_id = (line_id * 8 + seq) % 150 WHERE s.mag < 5) a JOIN (SELECT line_id, seq, s.mag FROM polylines JOIN stars s ON s.star_id = (line_id * 8 + seq) % 150 WHERE s.mag < 5) b ON b.line_id = a.line_id AND b.seq = a.seq + 1")
def _(t):
    """Edges of which both ends are bright stars."""
    ends = t.polylines.select("line_id", "seq", ((F.col("line_id") * 8 + F.col("seq")) % 150).alias("star_id"))
    bright = ends.join(t.stars.where("mag < 5").select("star_id", "mag"), "star_id").select("line_id", "seq", "mag")
    other = bright.select("line_id", (F.col("seq") - 1).alias("seq"), F.col("mag").alias("mag2"))
    return bright.join(other, ["line_id", "seq"])


@query("g23_overlay", f"""{_SCREEN}, drawn AS (SELECT line_id % 10 AS frame_id, count(DISTINCT line_id) AS lines, count(*) AS points FROM runs WHERE size >= 2 GROUP BY 1),
labelled AS (SELECT frame_id, count(*) AS stars, count(proper) AS named FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY mag, star_id) AS nth FROM in_frame WHERE mag < 6 OR proper IS NOT NULL) WHERE nth <= 40 GROUP BY frame_id)
SELECT frame_id, coalesce(lines, 0) AS lines, coalesce(points, 0) AS points, coalesce(stars, 0) AS stars, coalesce(named, 0) AS named FROM drawn FULL JOIN labelled USING (frame_id)""")
def _(t):
    """What each frame's overlay holds: runs of lines, and its brightest stars."""
    runs = P.islands(screen(t), ["line_id"], ["seq", "piece"], "visible")
    drawn = runs.groupBy("frame_id", "line_id").agg(F.count(F.lit(1)).alias("n")).groupBy("frame_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("points"))

    def bright(v):
        v = v.seen()
        return v.only((v.star["mag"] < 6) | v.star["named"])

    def one(v):
        v = bright(v)
        top = np.lexsort((v.star["star_id"], v.star["mag"]))[:40]
        return (v.frame_id, len(top), np.count_nonzero(v.star["named"][top])) if len(top) else None

    # stars come by magnitude, and fainter ones than a frame's 40 are not worked out
    enough = views.Choice("mag", lambda v: len(bright(v).place) >= 40)
    labelled = t.by_frame(each(one), "frame_id long, stars long, named long", choice=enough)
    return drawn.join(labelled, "frame_id", "full").na.fill(0)
