"""Spatial, temporal and ordered joins, made of equi-joins with a residual condition.

Theta joins would be nested loops. Here each side gets cell keys that only near rows share, so
Spark shuffles or broadcasts by key, can split skewed cells, and the exact condition decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sphere as S
from ..session import spread, worked_out


def _zones(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))


def with_cell(points: DataFrame, size: float, ra: str, dec: str) -> DataFrame:
    """points with the zone of declination and the cell of right ascension that each lies in."""
    cells = max(1, math.floor(360.0 / size))
    cell = F.least(F.floor(F.pmod(F.col(ra), F.lit(360.0)) / (360.0 / cells)), F.lit(cells - 1)).cast("int")
    return points.withColumn("zone", F.floor(F.col(dec) / size).cast("int")).withColumn("cell", cell)


def with_cells_about(points: DataFrame, radius_deg: float, size: float, ra: str, dec: str) -> DataFrame:
    """points, once for each zone and cell that the cone about them can touch: the more cells the
    nearer to a pole, all of a zone at the pole, and across 0 / 360."""
    cells = max(1, math.floor(360.0 / size))
    width = 360.0 / cells
    rows = points.withColumn("zone", F.explode(_zones(F.col(dec) - radius_deg, F.col(dec) + radius_deg, size)))
    # within a zone, the declination farthest from the equator makes the cone widest in right ascension
    far = F.least(F.greatest(F.abs(F.col("zone") * size), F.abs((F.col("zone") + 1) * size)), F.lit(90.0))
    rows = worked_out(rows, far=F.greatest(far, F.abs(F.col(dec)) + radius_deg))
    reach = F.when(F.col("far") >= 89.0, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(radius_deg))) / F.cos(F.radians(F.least("far", F.lit(89.0))))))) + width * 1e-6)
    rows = worked_out(rows, reach=reach)
    first, last = F.floor((F.col(ra) - F.col("reach")) / width), F.floor((F.col(ra) + F.col("reach")) / width)
    last = F.least(last, first + cells - 1)
    return rows.withColumn("cell", F.explode(F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda c: F.pmod(c, F.lit(cells))))).drop("far", "reach")


def cone_join(stars: DataFrame, frames: DataFrame, radius_deg: float, ra: str = "ra_deg", dec: str = "dec_deg", ra0: str = "ra0", dec0: str = "dec0", cell_deg: float | None = None) -> DataFrame:
    """Rows of stars within radius_deg of each frame's axis, with `axis_dot` and the star's unit
    vector `star_u`. A frame takes all cells that its cone can touch; a star is in exactly one."""
    size = cell_deg or max(radius_deg, 1.0)
    left = spread(with_cell(stars, size, ra, dec), "zone", "cell").withColumn("star_u", S.unit(F.col(ra), F.col(dec)).struct())
    right = with_cells_about(frames, radius_deg, size, ra0, dec0).withColumn("frame_u", S.unit(F.col(ra0), F.col(dec0)).struct())
    both = left.join(right, ["zone", "cell"])
    return worked_out(both, axis_dot=S.dot(F.col("frame_u"), F.col("star_u"))).drop("zone", "cell", "frame_u").where(F.col("axis_dot") >= math.cos(math.radians(radius_deg)))


def with_rotation(frames: DataFrame) -> DataFrame:
    """frames with `rot`, worked out once a frame."""
    return frames.withColumn("rot", S.rotation(F.col("ra0"), F.col("dec0"), F.col("roll")).struct())


#: Of a star seen from a frame.
CAMERA = ("cam_x", "cam_y", "cam_z")


def with_camera(stars: DataFrame, frames: DataFrame, radius_deg: float) -> DataFrame:
    """Cone join with the stars' camera vectors."""
    near = cone_join(stars, with_rotation(frames), radius_deg)
    return worked_out(near, **dict(zip(CAMERA, S.to_camera(F.col("rot"), F.col("star_u")), strict=True)))


def stars_in_frames(stars: DataFrame, frames: DataFrame, radius_deg: float, k1: float = 0.0) -> DataFrame:
    """Cone join, projection and the frame's bounds: frame_id, the star's columns, x, y, w, h."""
    near = with_camera(stars, frames, radius_deg)
    seen, x, y = S.project(S.Vector(*map(F.col, CAMERA)), F.col("focal"), F.lit(k1), F.col("w"), F.col("h"))
    px = worked_out(near.where(seen), x=x, y=y).where(S.in_bounds(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    return px.select("frame_id", *stars.columns, "x", "y", "w", "h")


def radius_join(left: DataFrame, right: DataFrame, keys: list[str], r: float, x: str = "x", y: str = "y", suffix: str = "_2") -> DataFrame:
    """Pairs with equal keys whose points are at most r apart, with `d2`. Right columns but the
    keys get the suffix."""
    cell = lambda c: F.floor(c / r).cast("long")
    a = left.withColumn("cx", cell(F.col(x))).withColumn("cy", cell(F.col(y)))
    b = right.select(*keys, *[F.col(c).alias(c + suffix) for c in right.columns if c not in keys])
    around = lambda c: F.explode(F.sequence(cell(F.col(c + suffix)) - 1, cell(F.col(c + suffix)) + 1))
    b = b.withColumn("cx", around(x)).withColumn("cy", around(y))
    d2 = F.pow(F.col(x) - F.col(x + suffix), 2) + F.pow(F.col(y) - F.col(y + suffix), 2)
    return a.join(b, [*keys, "cx", "cy"]).drop("cx", "cy").withColumn("d2", d2).where(F.col("d2") <= r * r)


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, order: str, value: str, name: str) -> DataFrame:
    """left with the value of the right row that is nearest in time, before or after; of equally
    near ones the least by order. Without a dated row, the first right row by order.

    One sorted pass over the union finds the nearest row on either side, so neither side is
    multiplied by the other."""
    struct = lambda: F.struct(F.col(time).alias("t"), F.col(order).alias("o"), F.col(value).alias("v"))
    a = left.select(*keys, F.col(time), F.col(order), F.lit(None).cast(right.select(struct()).schema[0].dataType).alias("r"), F.struct(*left.columns).alias("row"))
    b = right.select(*keys, F.col(time), F.col(order), struct().alias("r"), F.lit(None).cast(a.schema["row"].dataType).alias("row"))
    # of rows with one time only the least by order can win
    least = b.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.min_by("r", order).alias("r"), F.min(order).alias(order))
    both = a.unionByName(least.select(*keys, time, order, "r", F.lit(None).cast(a.schema["row"].dataType).alias("row")))
    back = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(time)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.desc_nulls_first(time)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("p", F.last("r", ignorenulls=True).over(back)).withColumn("n", F.last("r", ignorenulls=True).over(ahead)).where(F.col("row").isNotNull())
    gap = lambda c: F.abs(F.unix_micros(F.col(f"{c}.t").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp")))
    first = right.groupBy(*keys).agg(F.min_by(value, order).alias("first_value")) if keys else right.groupBy().agg(F.min_by(value, order).alias("first_value"))
    near = F.when(F.col(time).isNull(), None).when(F.col("n").isNull() | ((gap("p") < gap("n")) | ((gap("p") == gap("n")) & (F.col("p.o") <= F.col("n.o")))), F.col("p.v")).otherwise(F.col("n.v"))
    both = both.withColumn("near", near)
    both = both.join(first, keys, "left") if keys else both.crossJoin(F.broadcast(first))  # one row
    return both.select("row.*", F.coalesce("near", "first_value").alias(name))


def ordered_lookup(ids: list, table: DataFrame, key: str) -> DataFrame:
    """Rows of table in the order of ids, with `pos`; an id that is missing raises an error."""
    asked = table.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, {key} {table.schema[key].dataType.simpleString()}")
    found = F.broadcast(asked).join(table.withColumn("found", F.lit(True)), key, "left")
    return found.where(F.coalesce(F.col("found"), F.raise_error(F.concat(F.lit("no such id: "), F.col(key).cast("string"))).cast("boolean"))).drop("found").orderBy("pos")


def with_default(left: DataFrame, right: DataFrame, on: str, value: str, default: Column) -> DataFrame:
    """Left join on a key; value falls back to default."""
    return left.join(right, on, "left").withColumn(value, F.coalesce(value, default))
