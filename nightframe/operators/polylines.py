"""Polylines on the sphere and on the screen: line_id, seq, ra, dec."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sphere as S
from ..session import worked_out
from .joins import CAMERA, with_rotation


def segments(lines: DataFrame) -> DataFrame:
    """Neighbouring vertices: line_id, seq, ra, dec, ra2, dec2."""
    order = Window.partitionBy("line_id").orderBy("seq")
    out = lines.withColumn("ra2", F.lead("ra").over(order)).withColumn("dec2", F.lead("dec").over(order))
    return out.where(F.col("ra2").isNotNull())


def tessellate(lines: DataFrame, step_deg: float = 1.0) -> DataFrame:
    """Segments cut into pieces of at most step_deg along the great circle: line_id, seq, piece
    (0 for a line's first vertex only), ra, dec."""
    s = segments(lines).withColumn("u", S.unit(F.col("ra"), F.col("dec")).struct()).withColumn("v", S.unit(F.col("ra2"), F.col("dec2")).struct())
    s = s.withColumn("pieces", F.greatest(F.lit(1), F.ceil(S.separation(F.col("u"), F.col("v")) / step_deg)).cast("int"))
    s = s.withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("pieces"))))
    s = s.withColumn("p", S.slerp(F.col("u"), F.col("v"), F.col("piece") / F.col("pieces")).struct())
    ra, dec = S.ra_dec(F.col("p"))
    own = s.select("line_id", "seq", "piece", F.when(F.col("pieces") == 1, F.col("ra2")).otherwise(ra).alias("ra"), F.when(F.col("pieces") == 1, F.col("dec2")).otherwise(dec).alias("dec"))
    first = lines.withColumn("n", F.row_number().over(Window.partitionBy("line_id").orderBy("seq"))).where("n = 1")
    return own.unionByName(first.select("line_id", "seq", F.lit(0).alias("piece"), "ra", "dec"))


def on_screen(points: DataFrame, frames: DataFrame, k1: float = 0.0, margin: float = 60.0) -> DataFrame:
    """points (ra, dec and any keys) with the columns of their frame: x, y, and whether each is
    within a margin of the frame, its edges included."""
    u = S.unit(F.col("ra"), F.col("dec"))
    both = worked_out(points.join(with_rotation(frames), "frame_id"), **dict(zip(("ux", "uy", "uz"), u, strict=True)))
    both = worked_out(both, **dict(zip(CAMERA, S.to_camera(F.col("rot"), S.Vector(F.col("ux"), F.col("uy"), F.col("uz"))), strict=True)))
    seen, x, y = S.project(S.Vector(*map(F.col, CAMERA)), F.col("focal"), F.lit(k1), F.col("w"), F.col("h"))
    both = worked_out(both, seen=seen, x=x, y=y)
    near = F.col("x").between(-margin, F.col("w") + margin) & F.col("y").between(-margin, F.col("h") + margin)
    return both.withColumn("visible", F.coalesce(F.col("seen") & near, F.lit(False))).drop("rot", "ux", "uy", "uz", "seen", *CAMERA)


def islands(points: DataFrame, keys: list[str], order: list[str], visible: str, least: int = 2) -> DataFrame:
    """Runs of visible points with `run`; shorter runs than least go."""
    by = Window.partitionBy(*keys).orderBy(*order)
    out = points.withColumn("run", F.sum((~F.col(visible)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.where(F.col(visible)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run")))
    return out.where(F.col("size") >= least).drop("size")


def grid(spark, ra_step: int = 15, dec_step: int = 10, fine: int = 2) -> DataFrame:
    """Meridians from -80 to 80 and parallels that do not close: kind, value, seq, ra, dec."""
    one = spark.range(1)
    meridians = one.select(F.explode(F.sequence(F.lit(0), F.lit(360 - ra_step), F.lit(ra_step))).alias("value"))
    meridians = meridians.select(F.lit("ra").alias("kind"), "value", F.posexplode(F.sequence(F.lit(-80), F.lit(80), F.lit(fine))).alias("seq", "other"))
    parallels = one.select(F.explode(F.sequence(F.lit(-80), F.lit(80), F.lit(dec_step))).alias("value"))
    parallels = parallels.select(F.lit("dec").alias("kind"), "value", F.posexplode(F.sequence(F.lit(0), F.lit(360 - fine), F.lit(fine))).alias("seq", "other"))
    both = meridians.unionByName(parallels)
    along = F.col("kind") == "ra"
    return both.select("kind", "value", "seq", F.when(along, F.col("value")).otherwise(F.col("other")).cast("double").alias("ra"), F.when(along, F.col("other")).otherwise(F.col("value")).cast("double").alias("dec"))


def label_place(points: DataFrame, keys: list[str], w, h) -> DataFrame:
    """Mean of the points in the frame, if there are two."""
    inside = points.where(S.in_bounds(F.col("x"), F.col("y"), F.lit(w), F.lit(h)))
    return inside.groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).where("n >= 2")
