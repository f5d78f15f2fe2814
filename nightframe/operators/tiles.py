"""Rasters in square tiles with a margin, so that a step over neighbours reads each pixel about
once and not once for each neighbour.

A pixel goes to its own tile, and to others only if their margin reaches it. A tile is a group of
bounded size, whatever the frame's. Pixels are frame_id, x, y, v; a null v, or one that is no
number, counts as no pixel; of pixels that repeat a place one counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "frame_id"
#: Pixels along a tile's side.
SIDE = 64
#: The label of a pixel is y * ROW + x.
ROW = 1 << 20


@dataclass(frozen=True)
class Tile:
    """v holds the tile with its margin, cut off at the frame's edges, NaN where no pixel is;
    its corner is at x, y, and rows and columns tell which part is the tile itself."""

    v: np.ndarray
    x: int
    y: int
    rows: slice
    columns: slice

    def missing(self, margin: int) -> tuple[tuple[int, int], tuple[int, int]]:
        """How much of the margin lies outside the frame: above and below, left and right."""
        cut = lambda s, n: (margin - s.start, margin - (n - s.stop))
        return cut(self.rows, self.v.shape[0]), cut(self.columns, self.v.shape[1])

    def own(self, where: np.ndarray | None = None, **values: np.ndarray) -> dict[str, np.ndarray]:
        """x, y and the values (arrays like v) of the tile's own pixels."""
        part = (self.rows, self.columns)
        there = ~np.isnan(self.v[part])
        if where is not None:
            there &= where[part]
        y, x = np.nonzero(there)
        return {"x": x + self.x + self.columns.start, "y": y + self.y + self.rows.start, **{k: a[part][there] for k, a in values.items()}}


def around(v: np.ndarray, outside: float) -> list[np.ndarray]:
    """The eight neighbours of each place."""
    p = np.pad(v, 1, constant_values=outside)
    h, w = v.shape
    return [p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]


def by_tile(pixels: DataFrame, f: Callable[[Tile], dict[str, np.ndarray]], columns: str, margin: int, size: tuple[int, int] | None = None) -> DataFrame:
    """frame_id, x, y and the columns that f gives for each tile. Without a size, frames have no
    right and lower edge."""
    side = SIDE

    def tiles(c: str, n: int | None) -> Column:
        last = F.col(c) + margin if n is None else F.least(F.col(c) + margin, F.lit(n - 1))
        return F.explode(F.sequence(F.floor(F.greatest(F.col(c) - margin, F.lit(0)) / side).cast("int"), F.floor(last / side).cast("int")))

    w, h = size or (None, None)
    inside = (F.col("x") >= 0) & (F.col("y") >= 0)
    if size is not None:
        inside &= (F.col("x") < w) & (F.col("y") < h)
    dealt = pixels.where(inside).select(KEY, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("v").cast("double").alias("v"))
    dealt = dealt.withColumn("tx", tiles("x", w)).withColumn("ty", tiles("y", h))
    # a number of its own, so that partitions of few bytes, but much work, are not put together
    dealt = dealt.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), KEY, "tx", "ty")

    def axis(t: int, n: int | None) -> tuple[int, int, slice]:
        low, high = t * side, (t + 1) * side if n is None else min((t + 1) * side, n)
        start, stop = max(low - margin, 0), high + margin if n is None else min(high + margin, n)
        return start, stop - start, slice(low - start, high - start)

    kind = pixels.schema[KEY].dataType.simpleString()
    names = ["x", "y", *[c.split()[0] for c in columns.split(",") if c.strip()]]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        (x0, nx, across), (y0, ny, down) = axis(key[1].as_py(), w), axis(key[2].as_py(), h)
        v = np.full((ny, nx), np.nan)
        v[table["y"].to_numpy() - y0, table["x"].to_numpy() - x0] = table["v"].to_numpy()
        out = f(Tile(v, x0, y0, down, across))
        types = {"x": pa.int32(), "y": pa.int32()}
        arrays = [pa.array(out[c], types.get(c)) for c in names]
        frame = pa.array([key[0].as_py()], key[0].type).take(pa.array(np.zeros(len(out["x"]), np.int64)))
        return pa.Table.from_arrays([frame, *arrays], [KEY, *names])

    schema = f"{KEY} {kind}, x int, y int" + (f", {columns}" if columns else "")
    return dealt.groupBy(KEY, "tx", "ty").applyInArrow(run, schema)


def convolved(pixels: DataFrame, kernel: list[tuple[int, int, float]], size: tuple[int, int]) -> DataFrame:
    """v, zero outside the frame, and the pixel's own value as `raw`."""
    half = max(max(abs(dx), abs(dy)) for dx, dy, _ in kernel)

    def f(t: Tile) -> dict[str, np.ndarray]:
        p = np.pad(np.nan_to_num(t.v), half)
        h, w = t.v.shape
        v = np.zeros_like(t.v)
        for dx, dy, k in kernel:
            v += k * p[half + dy : half + dy + h, half + dx : half + dx + w]
        return t.own(v=v, raw=t.v)

    return by_tile(pixels, f, "v double, raw double", half, size)


def blurred(pixels: DataFrame, weights: list[float], size: tuple[int, int]) -> DataFrame:
    """v: weights along x, then along y; the frame's edge is repeated outwards."""
    half = len(weights) // 2

    def f(t: Tile) -> dict[str, np.ndarray]:
        p = np.pad(np.nan_to_num(t.v), t.missing(half), mode="edge")
        h, w = p.shape
        p = sum(k * p[:, i : i + w - 2 * half] for i, k in enumerate(weights))
        own = sum(k * p[i : i + h - 2 * half] for i, k in enumerate(weights))
        v = np.zeros_like(t.v)
        v[t.rows, t.columns] = own
        return t.own(v=v)

    return by_tile(pixels, f, "v double", half, size)


def maxima(pixels: DataFrame) -> DataFrame:
    """Pixels that no neighbour exceeds."""

    def f(t: Tile) -> dict[str, np.ndarray]:
        v = np.where(np.isnan(t.v), -np.inf, t.v)
        return t.own(np.all([v >= n for n in around(v, -np.inf)], axis=0), v=t.v)

    return by_tile(pixels, f, "v double", 1)


def _labels(mask: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each masked place the least id of its 8-connected component."""
    beyond = np.iinfo(np.int64).max
    out = np.where(mask, ids, beyond)
    while True:
        new = np.where(mask, np.minimum.reduce([out, *around(out, beyond)]), beyond)
        if np.array_equal(new, out):
            return out
        out = new


def tile_components(mask: DataFrame) -> DataFrame:
    """label and own: the least pixel of the component inside a tile and its margin. A pixel on a
    tile's edge has several labels, of which that of its own tile is its own."""

    def f(t: Tile) -> dict[str, np.ndarray]:
        there = ~np.isnan(t.v)
        y, x = np.nonzero(there)
        ids = (np.arange(t.v.shape[0])[:, None] + t.y) * ROW + np.arange(t.v.shape[1]) + t.x
        own = np.zeros_like(there)
        own[t.rows, t.columns] = True
        return {"x": x + t.x, "y": y + t.y, "label": _labels(there, ids)[there], "own": own[there]}

    return by_tile(mask.select(KEY, "x", "y", F.lit(1.0).alias("v")), f, "label bigint, own boolean", 1)
