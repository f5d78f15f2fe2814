"""Operators on rasters given as pixels: frame_id, x, y, v.

Every step is a join on pixel or cell keys, a group of them, or work on tiles of bounded size, so
frames of any size spread over the cluster; nothing gathers a frame in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from . import tiles
from .aggregates import mad_sigma, median, ranked_values

KEY = "frame_id"
AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]
#: The detector's limits: part of a frame that may be above the threshold, and doublings.
MASK_FILL, DOUBLINGS = 0.02, 4


def _offsets(pairs: list[tuple]) -> Column:
    """An array of structs dx, dy and, if given, k."""
    return F.array(*[F.struct(F.lit(p[0]).alias("dx"), F.lit(p[1]).alias("dy"), *([F.lit(float(p[2])).alias("k")] if len(p) > 2 else [])) for p in pairs])


def scatter(pixels: DataFrame, pairs: list[tuple]) -> DataFrame:
    """Each pixel once for each offset, at x + dx, y + dy."""
    out = pixels.withColumn("o", F.explode(_offsets(pairs)))
    return out.withColumn("x", F.col("x") + F.col("o.dx")).withColumn("y", F.col("y") + F.col("o.dy"))


def remove_stripes(pixels: DataFrame) -> DataFrame:
    """Column medians off, then row medians of what is left."""
    by_column = pixels.groupBy(KEY, "x").agg(median(F.col("v")).alias("m"))
    out = pixels.join(by_column, [KEY, "x"]).select(KEY, "x", "y", (F.col("v") - F.col("m")).alias("v"))
    by_row = out.groupBy(KEY, "y").agg(median(F.col("v")).alias("m"))
    return out.join(by_row, [KEY, "y"]).select(KEY, "x", "y", (F.col("v") - F.col("m")).alias("v"))


def _clipped(v: np.ndarray, rounds: int = 3, width: float = 3.0) -> float | None:
    """Median after dropping, so many times, what is more than width sigmas off; a round that
    would drop all keeps all."""
    for _ in range(rounds if len(v) else 0):
        off = np.abs(v - np.median(v))
        near = off <= width * (np.median(off) * 1.4826)
        v = v[near] if near.any() else v
    return float(np.median(v)) if len(v) else None


def mesh_medians(pixels: DataFrame, mesh: int) -> DataFrame:
    """frame_id, cx, cy, median: sigma-clipped, of each mesh cell. A cell has mesh * mesh values
    at most; they are gathered once."""
    cell = lambda c: F.floor(F.col(c) / mesh).cast("int")
    cells = pixels.groupBy(KEY, cell("x").alias("cx"), cell("y").alias("cy")).agg(F.collect_list(F.col("v").cast("double")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, ends = b["v"].flatten().to_numpy(zero_copy_only=False), np.cumsum(b["v"].value_lengths().to_numpy())
            medians = pa.array([_clipped(v) for v in np.split(values, ends[:-1])] if len(ends) else [], pa.float64())
            yield pa.RecordBatch.from_arrays([b[KEY], b["cx"], b["cy"], medians], [KEY, "cx", "cy", "median"])

    return cells.mapInArrow(run, f"{KEY} {cells.schema[KEY].dataType.simpleString()}, cx int, cy int, median double")


def with_background(pixels: DataFrame, mesh: int, size: tuple[int, int]) -> DataFrame:
    """pixels with bg, the mesh medians between cell centres, level beyond the outermost ones. The
    four medians around a place are one row, so each pixel is joined once."""
    columns, rows = -(-size[0] // mesh), -(-size[1] // mesh)

    def places(c: str, n: int) -> Column:
        """Squares between centres that a cell is a corner of, 0 for the lower end and 1 for the upper."""
        at = lambda q, i: F.struct(q.alias("q"), F.lit(i).alias("i"))
        edge = [F.when(F.col(c) == 0, at(F.lit(-1), 0)), F.when(F.col(c) == n - 1, at(F.lit(n - 1), 1))]
        return F.explode(F.array_compact(F.array(at(F.col(c), 0), at(F.col(c) - 1, 1), *edge)))

    corners = mesh_medians(pixels, mesh).withColumn("a", places("cx", columns)).withColumn("b", places("cy", rows))
    corner = lambda i, j: F.max(F.when((F.col("a.i") == i) & (F.col("b.i") == j), F.col("median"))).alias(f"m{i}{j}")
    squares = corners.groupBy(KEY, F.col("a.q").alias("qx"), F.col("b.q").alias("qy")).agg(*[corner(i, j) for j in (0, 1) for i in (0, 1)])
    at = lambda c: (F.col(c) + 0.5) / mesh - 0.5
    placed = pixels.withColumn("qx", F.floor(at("x")).cast("int")).withColumn("qy", F.floor(at("y")).cast("int"))
    both = placed.join(squares, [KEY, "qx", "qy"])
    part = lambda c, q, i: at(c) - F.col(q) if i else 1 - (at(c) - F.col(q))
    bg = sum((part("x", "qx", i) * part("y", "qy", j) * F.col(f"m{i}{j}") for j in (0, 1) for i in (0, 1)), F.lit(0.0))
    return both.select(*[F.col(c) for c in pixels.columns], bg.alias("bg"))


def background(pixels: DataFrame, mesh: int, size: tuple[int, int]) -> DataFrame:
    return with_background(pixels, mesh, size).select(KEY, "x", "y", "bg")


def gaussian(sigma: float, half: int = 3) -> list[tuple[int, int, float]]:
    raw = [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))) for dy in range(-half, half + 1) for dx in range(-half, half + 1)]
    total = sum(k for _, _, k in raw)
    return [(dx, dy, k / total) for dx, dy, k in raw]


def convolve(pixels: DataFrame, kernel: list[tuple[int, int, float]], size: tuple[int, int]) -> DataFrame:
    """Zero outside the frame."""
    return tiles.convolved(pixels, kernel, size).drop("raw")


def blur(pixels: DataFrame, sigma: float, size: tuple[int, int]) -> DataFrame:
    """Separable, radius ceil(3 sigma); the frame's edge is repeated outwards."""
    half = math.ceil(3 * sigma)
    raw = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-half, half + 1)]
    return tiles.blurred(pixels, [k / sum(raw) for k in raw], size)


def local_maxima(pixels: DataFrame, above: float | None = None) -> DataFrame:
    """Pixels that no neighbour exceeds; plateaus stay."""
    out = tiles.maxima(pixels)
    return out if above is None else out.where(F.col("v") > above)


def adaptive_threshold(pixels: DataFrame, start: Column) -> DataFrame:
    """frame_id, level, threshold: start doubled until few enough pixels are above it, or as
    often as allowed. All levels are counted in one pass."""
    fill = lambda k: F.avg((F.col("v") > start * 2.0**k).cast("int"))
    counted = pixels.groupBy(KEY).agg(F.first(start).alias("start"), *[fill(k).alias(f"f{k}") for k in range(DOUBLINGS)])
    level = F.coalesce(*[F.when(F.col(f"f{k}") <= MASK_FILL, k) for k in range(DOUBLINGS)], F.lit(DOUBLINGS))
    return counted.select(KEY, level.alias("level"), (F.col("start") * F.pow(F.lit(2.0), level)).alias("threshold"))


def components(mask: DataFrame) -> DataFrame:
    """8-connected components of mask pixels (frame_id, x, y): with `label`, the least y * 2**20
    + x of the component. Tiles are labelled by themselves; where a pixel on an edge has two
    labels they are one, and only such labels spread and jump until nothing changes."""
    labelled = checkpointed(tiles.tile_components(mask))
    own = labelled.where("own").select(KEY, "x", "y", "label")
    other = labelled.where("not own").select(KEY, "x", "y", F.col("label").alias("other"))
    met = own.join(other, [KEY, "x", "y"]).where("label <> other")
    ends = F.explode(F.array(F.struct("label", "other"), F.struct(F.col("other").alias("label"), F.col("label").alias("other"))))
    links = checkpointed(met.select(KEY, ends.alias("e")).select(KEY, "e.*").distinct())
    nodes = links.select(KEY, "label", F.col("label").alias("least")).distinct()
    while not links.isEmpty():
        least = nodes.select(KEY, F.col("label").alias("other"), F.col("least").alias("o"))
        near = links.join(least, [KEY, "other"]).groupBy(KEY, "label").agg(F.min("o").alias("near"))
        new = nodes.join(near, [KEY, "label"]).select(KEY, "label", F.least("least", "near").alias("mid"), F.col("least").alias("old"))
        # the label found is one that has a label itself
        further = new.select(KEY, F.col("label").alias("mid"), F.col("mid").alias("least"))
        new = checkpointed(new.join(further, [KEY, "mid"]).select(KEY, "label", F.least("mid", "least").alias("least"), "old"))
        if new.where("least <> old").isEmpty():
            return own.join(new.select(KEY, "label", "least"), [KEY, "label"], "left").select(KEY, "x", "y", F.coalesce("least", "label").alias("label"))
        nodes = new.drop("old")
    return own


def blob_shapes(blobs: DataFrame) -> DataFrame:
    """Of pixels with label and v: area, box, peak, weighted centre and elongation of each blob."""
    w = F.greatest(F.col("v"), F.lit(0.0))
    keys = [KEY, "label"]
    sums = blobs.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("y")).alias("wy"))
    centred = blobs.join(sums, keys).withColumn("dx", F.col("x") - F.col("wx") / F.col("w")).withColumn("dy", F.col("y") - F.col("wy") / F.col("w"))
    moment = lambda a, b: F.sum(w * F.col(a) * F.col(b)) / F.first(F.col("w"))
    out = centred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
        F.max("v").alias("peak"),
        F.first("w").alias("flux"),
        F.first(F.col("wx") / F.col("w")).alias("cx"),
        F.first(F.col("wy") / F.col("w")).alias("cy"),
        moment("dx", "dx").alias("mxx"),
        moment("dy", "dy").alias("myy"),
        moment("dx", "dy").alias("mxy"),
    )
    half = (F.col("mxx") + F.col("myy")) / 2.0
    root = F.sqrt(F.greatest(half * half - (F.col("mxx") * F.col("myy") - F.col("mxy") * F.col("mxy")), F.lit(0.0)))
    longer = F.sqrt((half + root) / F.greatest(half - root, F.lit(1e-12)))
    return out.withColumn("elongation", F.when(F.col("flux") <= 0, 1.0).otherwise(longer)).drop("mxx", "myy", "mxy")


def reject_reason(border: int, size: tuple[int, int], least_area: int, least_peak: float, most_area: int, most_elongation: float, diffuse_area: int, least_concentration: float, saturated: float) -> Column:
    """The first filter that a blob fails, or null: border, small, faint, large, elongated,
    diffuse (its light is spread evenly, and it is neither saturated nor large)."""
    edge = (F.col("min_x") < border) | (F.col("min_y") < border) | (F.col("max_x") >= size[0] - border) | (F.col("max_y") >= size[1] - border)
    concentration = F.col("peak") * F.col("area") / F.greatest(F.col("flux"), F.lit(1e-9))
    return (
        F.when(edge, "border")
        .when(F.col("area") < least_area, "small")
        .when(F.col("peak") < least_peak, "faint")
        .when(F.col("area") > most_area, "large")
        .when((F.col("area") >= 6) & (F.col("elongation") > most_elongation), "elongated")
        .when((F.col("area") >= diffuse_area) & (F.col("peak") < saturated) & (concentration < least_concentration), "diffuse")
    )


def half_peak_cores(blobs: DataFrame, most_area: int) -> DataFrame:
    """Pixels of blobs; of those with more pixels than most_area only the ones of half the peak or more."""
    own = Window.partitionBy(KEY, "label")
    out = blobs.withColumn("peak", F.max("v").over(own)).withColumn("area", F.count(F.lit(1)).over(own))
    return out.where((F.col("area") <= most_area) | (F.col("v") >= 0.5 * F.col("peak"))).drop("peak", "area")


def noise_sigma(pixels: DataFrame, size: tuple[int, int], border: int, floor: float) -> DataFrame:
    """frame_id, sigma: 1.4826 times the median deviation of the pixels within the border; where
    that is below the floor, half of what lies between the median and the quantile 0.9772, and
    the floor at least."""
    inside = pixels.where(F.col("x").between(border, size[0] - 1 - border) & F.col("y").between(border, size[1] - 1 - border))
    spread = ranked_values(inside, [KEY], "v", {"mid": ("floor", 0.5), "upper": ("floor", 0.9772)})
    both = mad_sigma(inside, [KEY], "v").join(spread, KEY)
    wide = F.greatest((F.col("upper") - F.col("mid")) / 2.0, F.lit(floor))
    return both.select(KEY, F.when(F.col("sigma") >= floor, F.col("sigma")).otherwise(wide).alias("sigma"))


def refine_centroids(points: DataFrame, pixels: DataFrame, item: str, half: int = 5, sigma: float = 1.5, rounds: int = 3) -> DataFrame:
    """points (frame_id, item, x, y) moved, so many times, to the mean of the bright pixels of a
    window around each, weighted by brightness and a Gaussian of the distance."""
    bright = pixels.where("v > 0").select(KEY, F.col("x").alias("px"), F.col("y").alias("py"), "v")
    around = lambda c: F.explode(F.sequence(F.round(c).cast("int") - half, F.round(c).cast("int") + half))
    out = points.select(KEY, item, "x", "y")
    for _ in range(rounds):
        near = out.withColumn("px", around(F.col("x"))).withColumn("py", around(F.col("y"))).join(bright, [KEY, "px", "py"])
        d2 = F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)
        near = near.withColumn("w", F.col("v") * F.exp(-d2 / (2.0 * sigma * sigma)))
        moved = near.groupBy(KEY, item).agg((F.sum(F.col("w") * F.col("px")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("py")) / F.sum("w")).alias("my"))
        out = out.join(moved, [KEY, item], "left").select(KEY, item, F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y"))
    return out


def dilation_ring(blobs: DataFrame) -> DataFrame:
    """Pixels around each blob that are not its own, once for each pixel of the blob that they touch."""
    return scatter(blobs.select(KEY, "label", "x", "y"), AROUND).select(KEY, "label", "x", "y").join(blobs.select(KEY, "label", "x", "y"), [KEY, "label", "x", "y"], "left_anti")


def ranked(detections: DataFrame, flux: str = "flux", ties: tuple[str, ...] = ("y", "x"), top: int | None = None) -> DataFrame:
    """rank from 0, brightest first."""
    out = detections.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(flux), *ties)) - 1)
    return out if top is None else out.where(F.col("rank") < top)
