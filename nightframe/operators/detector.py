"""Detecting stars in frames: the whole chain from pixels to ranked detections, for all frames at once.

Stripes and background go, noise is estimated, a matched filter and an adaptive threshold give a
mask, its components are judged, and centres are refined. Steps over neighbours work on tiles;
after the mask only pixels of blobs and those around them are read.

Frames are pixels frame_id, x, y, v, dense, all of one size. An empty table gives no rows; a frame
without detections has a row of counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from . import images as I
from . import tiles
from .aggregates import median
from .matching import suppress

KEY = "frame_id"


@dataclass(frozen=True)
class Settings:
    """Fixed values of the usual detector."""

    mesh: int = 32
    kernel_sigma: float = 1.2
    noise_times: float = 2.5
    border: int = 8
    core_area: int = 2
    peak_times: float = 4.0
    most_area: int = 150
    elongation: float = 2.5
    most: int = 40
    saturated: float = 0.7
    saturated_area: int = 1500
    concentration: float = 2.5
    diffuse_area: int = 25
    floor: float = 1.0 / 255.0
    apart: float = 3.0


CLEAN = Settings()
#: For frames that the clean detections do not solve.
DEEP = replace(CLEAN, noise_times=2.0, peak_times=3.0, most=50)
REASONS = ("border", "small", "faint", "large", "elongated", "diffuse")


def flattened(pixels: DataFrame, size: tuple[int, int], mesh: int) -> DataFrame:
    """v without stripes and background."""
    clean = checkpointed(I.remove_stripes(pixels.select(KEY, "x", "y", "v")))
    return I.with_background(clean, mesh, size).select(KEY, "x", "y", (F.col("v") - F.col("bg")).alias("v"))


def blobs(residual: DataFrame, noise: DataFrame, size: tuple[int, int], s: Settings) -> DataFrame:
    """frame_id, x, y, label, v: pixels where the filtered residual is above the threshold, with
    their residual."""
    kernel = I.gaussian(s.kernel_sigma)
    filtered = checkpointed(tiles.convolved(residual, kernel, size))
    norm = math.sqrt(sum(k * k for _, _, k in kernel))
    spread = I.noise_sigma(filtered, size, s.border, s.floor * norm).withColumnRenamed("sigma", "spread")
    spread = noise.select(KEY).join(spread, KEY, "left").select(KEY, F.coalesce("spread", F.lit(s.floor * norm)).alias("spread"))
    level = I.adaptive_threshold(filtered.join(spread, KEY), F.col("spread") * s.noise_times)
    mask = checkpointed(filtered.join(level, KEY).where("v > threshold").select(KEY, "x", "y", F.col("raw").alias("v")))
    return I.components(mask).join(mask, [KEY, "x", "y"])


def measured(pixels: DataFrame, residual: DataFrame, noise: DataFrame, size: tuple[int, int], s: Settings) -> DataFrame:
    """A row for each blob: frame_id, label, area, peak, elongation, x, y, flux, sigma and reason,
    the first test that it fails, or null. pixels: of blobs."""
    own = pixels.join(noise, KEY)
    whole = own.groupBy(KEY, "label").agg(
        F.count(F.lit(1)).alias("area"), F.max("v").alias("peak"), F.first("sigma").alias("sigma"),
        F.count_if(F.col("v") > 3.0 * F.col("sigma")).alias("core_area"),
        *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))],
    )
    edge = (F.col("min_x") < s.border) | (F.col("min_y") < s.border) | (F.col("max_x") >= size[0] - s.border) | (F.col("max_y") >= size[1] - s.border)
    first = F.when(edge, "border").when(F.col("core_area") < s.core_area, "small").when(F.col("peak") < s.peak_times * F.col("sigma"), "faint")
    whole = checkpointed(whole.select(KEY, "label", "area", "peak", "sigma", first.alias("reason")))

    # of blobs of many pixels, the part of half the peak or more is judged
    open_ = pixels.join(whole.where("reason is null").select(KEY, "label"), [KEY, "label"], "left_semi")
    core = checkpointed(I.half_peak_cores(open_, s.most_area).select(KEY, "label", "x", "y", "v"))
    shape = I.blob_shapes(core).select(KEY, "label", F.col("area").alias("core"), "elongation")
    cap = F.when(F.col("peak") >= s.saturated, s.saturated_area).otherwise(s.most_area)
    second = F.when((F.col("area") > s.most_area) & (F.col("core") > cap), "large").when((F.col("core") >= 6) & (F.col("elongation") > s.elongation), "elongated")
    judged = checkpointed(whole.join(shape, [KEY, "label"], "left").withColumn("reason", F.coalesce("reason", second)))

    # light of the core and of what touches it, a pixel once for each that it touches
    good = judged.where("reason is null").select(KEY, "label")
    core = core.join(good, [KEY, "label"], "left_semi")
    ring = I.dilation_ring(core).join(residual, [KEY, "x", "y"]).select(KEY, "label", "x", "y", "v")
    light = core.unionByName(ring).where("v > 0").groupBy(KEY, "label")
    centre = light.agg(F.sum("v").alias("flux"), *[(F.sum(F.col("v") * F.col(c)) / F.sum("v")).alias(c) for c in "xy"])
    refined = I.refine_centroids(centre, residual, "label").join(centre.select(KEY, "label", "flux"), [KEY, "label"])
    out = judged.join(checkpointed(refined), [KEY, "label"], "left")
    spread = (F.col("area") <= s.most_area) & (F.col("area") >= s.diffuse_area) & (F.col("peak") < s.saturated)
    flat = F.col("peak") * F.col("area") / F.greatest(F.col("flux"), F.lit(1e-9)) < s.concentration
    return out.withColumn("reason", F.coalesce("reason", F.when(spread & flat, "diffuse")))


def detect(pixels: DataFrame, size: tuple[int, int], settings: Settings = CLEAN) -> tuple[DataFrame, DataFrame]:
    """Detections (frame_id, label, x, y, flux, peak, snr, area, elongation, rank from 0, brightest
    first) and counts (frame_id, sigma, background_median, candidates, accepted and one column
    for each reason)."""
    residual, noise = prepared(pixels, size, settings)
    rows = checkpointed(judged(residual, noise, size, settings))

    by_reason = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    counts = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("reason").isNull()).alias("accepted"), *by_reason)
    middle = pixels.groupBy(KEY).agg(median(F.col("v")).alias("background_median"))
    counts = noise.join(middle, KEY).join(counts, KEY, "left").na.fill(0, ["candidates", "accepted", *REASONS])
    return ranked(rows, settings), counts


def prepared(pixels: DataFrame, size: tuple[int, int], s: Settings) -> tuple[DataFrame, DataFrame]:
    """What a frame's steps share, whatever the thresholds: its flattened pixels and its noise."""
    residual = checkpointed(flattened(pixels, size, s.mesh))
    # frames that are all border have no noise of their own
    noise = pixels.select(KEY).distinct().join(I.noise_sigma(residual, size, s.border, s.floor), KEY, "left")
    return residual, checkpointed(noise.select(KEY, F.coalesce("sigma", F.lit(s.floor)).alias("sigma")))


def judged(residual: DataFrame, noise: DataFrame, size: tuple[int, int], s: Settings) -> DataFrame:
    """As measured, of all blobs."""
    return measured(blobs(residual, noise, size, s), residual, noise, size, s)


def ranked(rows: DataFrame, s: Settings) -> DataFrame:
    """The detections among judged blobs."""
    accepted = rows.where("reason is null").withColumn("snr", F.col("flux") / (F.col("sigma") * F.sqrt("area")))
    order = [(-F.col("flux")).alias("order"), "label"]
    kept = suppress(accepted.withColumn("order", -F.col("flux")), ["order"], "label", s.apart, inclusive=False, most=s.most)
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(*order)) - 1
    return kept.select(KEY, "label", "x", "y", "flux", "peak", "snr", "area", "elongation", rank.alias("rank"))


def in_two_tiers(pixels: DataFrame, size: tuple[int, int], enough: int, clean: Settings = CLEAN, deep: Settings = DEEP) -> DataFrame:
    """Detections with `tier`: those of the deep settings for frames that have fewer than `enough`
    of the clean ones. What both settings share is worked out once."""
    residual, noise = prepared(pixels, size, clean)
    first = checkpointed(ranked(checkpointed(judged(residual, noise, size, clean)), clean))
    done = checkpointed(first.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough).select(KEY))
    if (deep.mesh, deep.border, deep.floor) == (clean.mesh, clean.border, clean.floor):  # a frame's own, so it is as before
        residual, noise = (x.join(done, KEY, "left_anti") for x in (residual, noise))
    else:
        residual, noise = prepared(pixels.join(done, KEY, "left_anti"), size, deep)
    second = ranked(checkpointed(judged(residual, noise, size, deep)), deep)
    return first.join(done, KEY, "left_semi").withColumn("tier", F.lit("clean")).unionByName(second.withColumn("tier", F.lit("deep")))
