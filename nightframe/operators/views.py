"""What frames show, worked out frame by frame where their stars come together.

Rows of a frame and a star are as many as frames times stars, and pairs within a frame more. Here
they are neither shuffled nor written: a frame goes to its cell of the sky, a star to the cells
whose frames may show it, and each frame's rows are made, matched or summed in the task that has
both. What is shuffled grows with stars and frames only. Crowded cells are cut into blocks of
frames, so no group has more than BLOCK frames and the stars about one cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import sphere as S
from ..session import spread
from . import joins

#: Frames of a cell that one group holds at most, on average.
BLOCK = 512
#: Rows of a batch that leaves a task, at least, while there are more.
BATCH = 20000


@dataclass
class View:
    """A frame and the stars about its axis: columns of the stars, `u` and `cam`, their vectors in
    the sky and the camera, and `place`, where they stand among the group's stars; `own`, more
    columns of the frame; `rot`, its rotation by rows."""

    frame_id: int
    focal: float
    w: float
    h: float
    star: dict[str, np.ndarray]
    u: tuple[np.ndarray, ...]
    cam: tuple[np.ndarray, ...]
    place: np.ndarray
    own: dict | None = None
    rot: list[float] | None = None

    def only(self, mask: np.ndarray) -> View:
        at = np.flatnonzero(mask)
        take = lambda values: tuple(v[at] for v in values)
        return View(self.frame_id, self.focal, self.w, self.h, {k: v[at] for k, v in self.star.items()}, take(self.u), take(self.cam), self.place[at], self.own, self.rot)

    def seen(self, k1: float = 0.0) -> View:
        """The stars that the frame shows, with x and y."""
        ahead = self if (self.cam[2] > S.NEAR).all() else self.only(self.cam[2] > S.NEAR)
        x, y, z = ahead.cam
        if k1:
            r2 = (x / z) ** 2 + (y / z) ** 2
            if k1 < 0:
                ahead, r2 = ahead.only(r2 < -1.0 / (3.0 * k1)), r2[r2 < -1.0 / (3.0 * k1)]
                x, y, z = ahead.cam
            x, y = x * (1.0 + k1 * r2), y * (1.0 + k1 * r2)
        x, y = self.w / 2.0 + self.focal * x / z, self.h / 2.0 - self.focal * y / z
        inside = (x >= 0) & (x < self.w) & (y >= 0) & (y < self.h)
        shown = ahead.only(inside)
        shown.star |= {"x": x[inside], "y": y[inside]}
        return shown


Work = Callable[[Iterator[View]], Iterator[tuple]]


@dataclass
class Choice:
    """Stars that a view may leave out. rising, enough: stars come by this column, and a view has
    those up to a value at which it has enough. near: of a frame's own columns, pixels x and y and
    a radius; a view has the stars that may lie so near to one of them (without distortion)."""

    rising: str | None = None
    enough: Callable[[View], bool] | None = None
    near: Callable[[dict], tuple[np.ndarray, np.ndarray, float]] | None = None


class _Lattice:
    """Unit vectors in cubes of a side: which ones may lie within the side of others."""

    STEP = 1 << 20

    def __init__(self, u: list[np.ndarray], side: float):
        self.side = max(side * (1 + 1e-9), 1e-5)
        key = self.key(*[self.cube(c) for c in u])
        self.order = np.argsort(key, kind="stable")
        self.key_of = key[self.order]

    def cube(self, c: np.ndarray) -> np.ndarray:
        return np.floor((c + 1.0) / self.side).astype(np.int64) + 1

    def key(self, x, y, z):
        return (x * self.STEP + y) * self.STEP + z

    def about(self, u: list[np.ndarray]) -> np.ndarray:
        x, y, z = (self.cube(c)[:, None] for c in u)
        dx, dy = np.array([-1, 0, 1]).repeat(3), np.array([-1, 0, 1] * 3)
        rows = np.unique(self.key(x + dx, y + dy, z))  # three cubes beside each other are a range
        first = np.searchsorted(self.key_of, rows - 1, "left")
        n = np.searchsorted(self.key_of, rows + 1, "right") - first
        first, n = first[n > 0], n[n > 0]
        return np.unique(self.order[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)])


def _views(table: pa.Table, columns: list[str], least: float, choice: Choice) -> Iterator[View]:
    frames = table.filter(table["view"].is_valid())
    stars = table.filter(table["view"].is_null())
    if choice.rising:
        stars = stars.sort_by(choice.rising)
    array = lambda c: stars[c].combine_chunks().to_numpy(zero_copy_only=False)
    own, u = {c: array(c) for c in columns}, [array(c) for c in ("ux", "uy", "uz")]
    more = frames["own"].to_pylist() if "own" in table.column_names else [None] * len(frames)
    n, lattice = len(u[0]), None
    dot = lambda row, v: row[0] * v[0] + row[1] * v[1] + row[2] * v[2]
    for frame_id, view, extra in zip(frames["star_id"].to_pylist(), frames["view"].to_pylist(), more, strict=True):
        *rot, focal, w, h = view

        def show(place: np.ndarray | slice) -> View:
            z = dot(rot[6:9], [v[place] for v in u])  # noqa: B023
            ok = np.flatnonzero(z >= least)
            place = ok if isinstance(place, slice) else place[ok]
            near = tuple(v[place] for v in u)
            cam = (dot(rot[0:3], near), dot(rot[3:6], near), z[ok])  # noqa: B023
            return View(frame_id, focal, w, h, {k: v[place] for k, v in own.items()}, near, cam, place, extra, rot)  # noqa: B023

        if choice.near:
            px, py, r = choice.near(extra)
            a, b = (px - w / 2.0) / focal, (h / 2.0 - py) / focal
            long = np.sqrt(a * a + b * b + 1.0)
            # on the sphere, two rays are no farther apart than on the plane of the pixels
            if lattice is None or lattice.side < r / focal:
                lattice = _Lattice(u, r / focal)
            yield show(lattice.about([(rot[c] * a + rot[3 + c] * b + rot[6 + c]) / long for c in range(3)]))
            continue
        end = n if choice.enough is None else max(n // 32, 64)
        while choice.enough is not None and end < n:
            end = int(np.searchsorted(own[choice.rising], own[choice.rising][end - 1], "right"))
            if end < n:
                some = show(slice(0, end))
                if choice.enough(some):
                    yield some
                    break
            end *= 2
        else:
            yield show(slice(0, n))


def by_frame(stars: DataFrame, frames: DataFrame, radius_deg: float, work: Work, schema: str, columns: tuple[str, ...] = ("mag",), more: tuple[str, ...] = (), choice: Choice = Choice(), batch: int = BATCH) -> DataFrame:
    """Rows that work makes of a group's frames, each with the stars within radius_deg of its axis.
    work takes an iterator of views and gives tuples of columns, as in schema; a number stands for
    a row. stars: star_id, ra_deg, dec_deg and the columns; frames: frame_id, ra0, dec0, roll,
    focal, w, h, and more columns, which views have as `own`. batch: rows that leave a task at once."""
    size = max(radius_deg, 1.0)
    rot = [F.col(f"rot.{row}.{c}") for row in ("right", "up", "forward") for c in "xyz"]
    sides = [F.col(c).cast("double") for c in ("focal", "w", "h")]
    own = joins.with_cell(joins.with_rotation(frames), size, "ra0", "dec0").select("zone", "cell", F.col("frame_id").alias("star_id"), F.array(*rot, *sides).alias("view"), *([F.struct(*more).alias("own")] if more else []))
    # as many rows as cells of the sky have frames
    blocks = F.broadcast(own.groupBy("zone", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    own = own.join(blocks, ["zone", "cell"]).withColumn("block", F.pmod(F.xxhash64("star_id"), "blocks"))
    u = S.unit(F.col("ra_deg"), F.col("dec_deg"))
    place = [c for c in ("ra_deg", "dec_deg") if c not in columns]
    about = spread(stars, "star_id").select("star_id", *place, *columns, *[c.alias(f"u{n}") for n, c in zip("xyz", u, strict=True)])
    about = joins.with_cells_about(about, radius_deg, size, "ra_deg", "dec_deg").drop(*place)
    about = about.join(blocks, ["zone", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["zone", "cell", "block"]
    both = about.drop("blocks").unionByName(own.drop("blocks"), allowMissingColumns=True)
    # groups are costly, so they are dealt over more tasks than their bytes ask for: with two for
    # each group, hardly any task has several, and none grows but with the stars about one cell
    groups = blocks.agg(F.sum("blocks")).first()[0] or 0
    both = both.repartition(max(8 * stars.sparkSession.sparkContext.defaultParallelism, 2 * groups), *keys)
    types = to_arrow_schema(StructType.fromDDL(schema))
    least, names = math.cos(math.radians(radius_deg)), ["star_id", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for row in work(_views(pa.Table.from_batches(list(batches)), names, least, choice)):
            values = [np.atleast_1d(v) for v in row]
            long = max(map(len, values))
            waiting.append([np.broadcast_to(v, long) if len(v) == 1 else v for v in values] if min(map(len, values)) else None)
            n += long if waiting[-1] is not None else 0
            if n >= batch:
                yield _batch(waiting, types)
                waiting, n = [], 0
        yield _batch(waiting, types)

    return both.groupBy(*keys).applyInArrow(run, schema)


def _batch(rows: list, types: pa.Schema) -> pa.RecordBatch:
    rows = [r for r in rows if r is not None]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[i] for r in rows]) if rows else [], t.type) for i, t in enumerate(types)], schema=types)


def each(one: Callable[[View], tuple | None]) -> Work:
    """Work that treats frames one by one; None for no rows."""

    def work(views: Iterator[View]) -> Iterator[tuple]:
        return (rows for rows in map(one, views) if rows is not None)

    return work


# -- within a frame --------------------------------------------------------------------------
def rounded(x: np.ndarray) -> np.ndarray:
    """Six places, halves away from zero."""
    y = x * 1e6
    whole = np.trunc(y)
    return (whole + np.sign(y) * (np.abs(y - whole) >= 0.5)) / 1e6 + 0.0


#: Candidates of a pair that are held at a time, but for a single point's own.
CHUNK = 1 << 20


def _ranges(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of points (u, v), and for each (x, y) three ranges of it, as first places and
    lengths, that hold all at most r apart. A grid of cells as wide as r; the three cells beside
    each other in a row are one range."""
    row, size = 1 << 24, r * (1 + 1e-9)  # wider, as quotients are rounded
    cell = lambda a, b: np.floor(b / size).astype(np.int64) * row + np.floor(a / size).astype(np.int64)
    there = cell(u, v)
    order = np.argsort(there, kind="stable")
    there, here = there[order], cell(x, y)[:, None] + np.array([-row, 0, row])
    first = np.searchsorted(there, here - 1, "left")
    return order, first, np.searchsorted(there, here + 1, "right") - first


def near_chunks(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i of points (x, y) and j of points (u, v) at most r apart, and d2; all of a point i in
    one chunk."""
    order, first, n = _ranges(x, y, u, v, r)
    chunk = np.cumsum(n.sum(axis=1)) // CHUNK
    bounds = [*np.searchsorted(chunk, np.unique(chunk)), len(x)]
    for begin, end in zip(bounds, bounds[1:], strict=False):
        m, at = n[begin:end].ravel(), first[begin:end].ravel()
        i = np.repeat(np.arange(begin, end).repeat(3), m)
        j = order[np.arange(len(i)) + np.repeat(at - (np.cumsum(m) - m), m)]
        d2 = (x[i] - u[j]) ** 2 + (y[i] - v[j]) ** 2
        ok = d2 <= r * r
        yield i[ok], j[ok], d2[ok]


def near_pairs(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of near_chunks at once."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(part) for part in zip(none, *near_chunks(x, y, u, v, r), strict=True))


def any_near(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, r: float, most: float) -> np.ndarray:
    """Whether each point (x, y) has a point (u, v) with a d2 of `most` at most, which r reaches. A
    small reach decides most points of dense fields; it doubles for the others."""
    found, open_, reach = np.zeros(len(x), bool), np.arange(len(x)), r
    while reach > r * 1e-6 and len(x) and _ranges(x, y, u, v, reach)[2].sum() > 8 * len(x):
        reach /= 2
    while len(open_):
        for i, _, d2 in near_chunks(x[open_], y[open_], u, v, reach):
            found[open_[i[d2 <= most]]] = True
        if reach >= r:
            break
        open_, reach = open_[~found[open_]], min(2 * reach, r)
    return found


#: Candidates of a point at which whole rows of cells pay, and cells along the radius at most.
DENSE, FINEST = 64, 64


def near_total(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, r: float) -> tuple[int, float]:
    """How many pairs near_chunks has, and the sum of their d2, of dense fields without making all.

    Points (x, y) come together in cells and points (u, v) in rows, both a small part of r wide. What
    a row has within r of all of a cell is a stretch of it, whose part of the sum follows from running
    sums; only what is within r of some of a cell is paired. Cells narrow as fields get denser."""
    if not len(x) or not len(u):
        return 0, 0.0
    crowd = _ranges(x, y, u, v, r)[2].sum() / len(x)
    n, total = 0, 0.0
    if crowd < DENSE:
        for _, _, d2 in near_chunks(x, y, u, v, r):
            n, total = n + len(d2), total + float(d2.sum())
        return n, total
    k = min(int(math.sqrt(crowd) / 2), FINEST)
    side, slack, long = r / k, r * 1e-6, np.longdouble  # running sums are taken apart again, so they need more digits
    left, below = min(x.min(), u.min()), min(y.min(), v.min())
    x, y, u, v = x - left, y - below, u - left, v - below
    row = lambda c: np.floor(c / side).astype(np.int64)
    order = np.lexsort((u, row(v)))
    u, v = u[order], v[order]
    wide = max(x.max(), u.max()) + 4 * r
    there = row(v) * wide + u
    at = lambda rows, c: np.searchsorted(there, rows * wide + np.clip(c, -r, wide - 2 * r))
    mx, my = np.median(u), np.median(v)  # from here, the sums of most points are small
    a, b = (u - mx).astype(long), (v - my).astype(long)
    sums = [np.concatenate([[0], np.cumsum(c)]) for c in (a, b, a * a + b * b)]
    order = np.lexsort((row(x), row(y)))
    x, y = x[order], y[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(row(x)) != 0) | (np.diff(row(y)) != 0)]))
    size = np.diff(np.append(begin, len(x)))
    cx, cy = (np.add.reduceat(c, begin) / size for c in (x, y))
    own = np.add.reduceat((x - np.repeat(cx, size)) ** 2 + (y - np.repeat(cy, size)) ** 2, begin)
    (x0, x1), (y0, y1) = ([f.reduceat(c, begin) for f in (np.minimum, np.maximum)] for c in (x, y))
    about = np.arange(-k - 1, k + 2)
    for some in np.array_split(np.arange(len(begin)), -(-len(begin) * len(about) * 8 // CHUNK)):
        of, rows = np.repeat(some, len(about)), (row(y0[some])[:, None] + about).ravel()
        least = np.maximum(np.maximum(rows * side - y1[of], y0[of] - (rows + 1) * side) - slack, 0)
        of, rows, least = of[least <= r], rows[least <= r], least[least <= r]
        reach = np.sqrt(r * r - least * least) + slack
        first, last = at(rows, x0[of] - reach), at(rows, x1[of] + reach)
        of, rows, first, last = (c[last > first] for c in (of, rows, first, last))
        most = np.maximum((rows + 1) * side - y0[of], y1[of] - rows * side) + slack
        reach = np.sqrt(np.maximum(r * r - most * most, 0)) - slack
        whole = x1[of] - reach < x0[of] + reach
        low = np.where(whole, np.clip(at(rows, x1[of] - reach), first, last), last)
        high = np.where(whole, np.clip(at(rows, x0[of] + reach), low, last), last)
        m, (su, sv, squares) = high - low, (c[high] - c[low] for c in sums)
        ax, ay = (cx[of] - mx).astype(long), (cy[of] - my).astype(long)
        n += int((size[of] * m).sum())
        total += float((size[of] * (squares - 2 * (ax * su + ay * sv) + m * (ax * ax + ay * ay)) + m * own[of]).sum())
        # on either side of the stretch, each point of the cell with what is there
        of, first, last = np.tile(of, 2), np.concatenate([first, high]), np.concatenate([low, last])
        of, first, last = (c[last > first] for c in (of, first, last))
        points = np.arange(size[of].sum()) + np.repeat(begin[of] - (np.cumsum(size[of]) - size[of]), size[of])
        first, count = np.repeat(first, size[of]), np.repeat(last - first, size[of])
        chunk = np.cumsum(count) // CHUNK
        bounds = [*np.searchsorted(chunk, np.unique(chunk)), len(count)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            i, start = np.repeat(points[a:b], count[a:b]), np.repeat(first[a:b] - (np.cumsum(count[a:b]) - count[a:b]), count[a:b])
            j = np.arange(len(i)) + start
            d2 = (x[i] - u[j]) ** 2 + (y[i] - v[j]) ** 2
            d2 = d2[d2 <= r * r]
            n, total = n + len(d2), total + float(d2.sum())
    return n, total


#: Matches begin within this part of the radius, so that dense fields need not be paired in full.
FIRST_REACH = 1 / 64
#: Candidates of a point beyond which the first reach is halved, how a reach grows, and pairs of a
#: point that are decided at once.
CROWD, GROWTH, AT_ONCE = 32, 1.25, 4


def nearest_first(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, left: np.ndarray, right: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j and d2 of the pairs at most r apart that a pass by rising d2 keeps one to one;
    ties by left, then right. Shorter pairs come first, so those within a small reach are decided
    first, and a longer reach pairs only what is free then; of many pairs the shortest go first."""
    a, b, reach, kept = np.arange(len(x)), np.arange(len(u)), r * FIRST_REACH, []
    while reach > r * 1e-6 and _ranges(x, y, u, v, reach)[2].sum() > CROWD * len(x):
        reach /= 2
    while True:
        i, j, d2 = near_pairs(x[a], y[a], u[b], v[b], reach)
        most = AT_ONCE * min(len(a), len(b))
        cut = len(d2) > most
        if cut:
            short = d2 <= np.partition(d2, most)[most]  # with all that are as long
            i, j, d2 = i[short], j[short], d2[short]
        order = np.lexsort((right[b[j]], left[a[i]], d2))
        order = order[greedy(i[order], j[order])]
        i, j = i[order], j[order]
        kept.append((a[i], b[j], d2[order]))
        a, b = np.delete(a, i), np.delete(b, j)
        if not cut:
            if reach >= r or not len(a) or not len(b):
                return tuple(np.concatenate(part) for part in zip(*kept, strict=True))
            reach = min(GROWTH * reach, r)


def in_turn(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, right: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of the pairs in which points (x, y), in order, each take the nearest free (u, v)
    at most r away; ties by right. All ask at once: a point asks its nearest one, who holds the
    first in order of those that ask, and who is sent off asks the next. No asking point loses
    one to a later point, so the outcome is that of the order. Lists of whom to ask are made
    as far as they are read, without those who hold an earlier point."""
    n, none = len(x), len(x)
    holder, reach = np.full(len(u), none), np.zeros(n)
    at, end, asked = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(0, np.int64)
    open_ = np.arange(n)
    while len(open_):
        dry = open_[(at[open_] == end[open_]) & (reach[open_] < r)]
        if len(dry):
            low = reach[dry].min()
            dry = dry[reach[dry] == low]
            high = min(max(2 * low, r * FIRST_REACH), r)
            i, j, d2 = near_pairs(x[dry], y[dry], u, v, high)
            new = ((d2 > low * low) | (low == 0)) & (holder[j] > dry[i])
            i, j, d2 = i[new], j[new], d2[new]
            order = np.lexsort((right[j], d2, i))
            count = np.bincount(i, minlength=len(dry))
            end[dry] = len(asked) + np.cumsum(count)
            at[dry], reach[dry] = end[dry] - count, high
            asked = np.concatenate([asked, j[order]])
            continue
        open_ = np.sort(open_[at[open_] < end[open_]])  # the others have asked all
        target = asked[at[open_]]
        at[open_] += 1
        before = np.unique(holder[target])
        np.minimum.at(holder, target, open_)
        lost = open_[holder[target] != open_]
        now = np.isin(before, holder[target], invert=True) & (before < none)
        open_ = np.concatenate([lost, before[now]])
    j = np.flatnonzero(holder < none)
    return holder[j], j


def greedy(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs that a pass in order keeps, one to one; left and right are small numbers.
    A pair that comes first at both its ends is kept by any such pass, so each round keeps all of
    those and drops what they exclude."""
    open_, kept = np.arange(len(left)), []
    first_left, first_right = np.zeros(left.max(initial=-1) + 1, np.int64), np.zeros(right.max(initial=-1) + 1, np.int64)
    while len(open_):
        a, b = left[open_], right[open_]
        # written backwards, so that the first pair of each end stays
        first_left[a[::-1]], first_right[b[::-1]] = open_[::-1], open_[::-1]
        now = (first_left[a] == open_) & (first_right[b] == open_)
        kept.append(open_[now])
        first_left[a[now]] = first_right[b[now]] = -1
        open_ = open_[(first_left[a] >= 0) & (first_right[b] >= 0)]
    return np.sort(np.concatenate(kept)) if kept else open_


def spaced(x: np.ndarray, y: np.ndarray, r: float, inclusive: bool, head: int = 1024) -> np.ndarray:
    """Places of the points, given in order, that a pass keeps which leaves out those near one kept
    before: within r, or nearer than it. A stretch of the order is decided, then what is near its
    kept points is dropped from the rest, so dense fields are not paired in full."""
    close = lambda d2: d2 <= r * r if inclusive else d2 < r * r
    open_, kept = np.arange(len(x)), []
    while len(open_):
        now, open_ = open_[:head], open_[head:]
        i, j, d2 = near_pairs(x[now], y[now], x[now], y[now], r)
        before = (i < j) & close(d2)
        i, j = i[before], j[before]
        alive, order = np.ones(len(now), bool), np.argsort(j, kind="stable")
        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):  # all before b are decided
            if alive[a]:
                alive[b] = False
        now = now[alive]
        kept.append(now)
        i, _, d2 = near_pairs(x[open_], y[open_], x[now], y[now], r)
        out = np.zeros(len(open_), bool)
        out[i[close(d2)]] = True
        open_ = open_[~out]
    return np.concatenate(kept) if kept else open_


def least_angles(v: View, k: int) -> np.ndarray:
    """Of each star that a frame shows (View.seen) the k least angles to others, rising: (n, k), or
    as many as there are others. A small reach comes first and doubles for stars with too few, so
    dense fields are not paired in full; the plane of the pixels is a little wider than the sphere."""
    x, y, n = v.star["x"], v.star["y"], len(v.place)
    k = max(0, min(k, n - 1))
    out, open_, reach = np.zeros((n, k)), np.arange(n if k else 0), 0.05
    last = math.hypot(v.w, v.h) + 1.0
    shrunk = float(v.cam[2].min()) ** 2 / v.focal * (1 - 1e-6) if n else 0.0
    while len(open_):
        wait = []
        for i, j, _ in near_chunks(x[open_], y[open_], x, y, reach):
            at = open_[i]
            i, j, at = i[at != j], j[at != j], at[at != j]
            angle = np.arccos(np.clip(v.u[0][at] * v.u[0][j] + v.u[1][at] * v.u[1][j] + v.u[2][at] * v.u[2][j], -1.0, 1.0))
            sure = (angle <= reach * shrunk) | (reach >= last)
            i, angle = i[sure], angle[sure]
            order = np.lexsort((angle, i))
            i, angle = i[order], angle[order]
            begin = np.flatnonzero(np.concatenate([[True], np.diff(i) > 0])) if len(i) else i
            full = begin[np.diff(np.append(begin, len(i))) >= k]
            out[open_[i[full]]] = angle[full[:, None] + np.arange(k)]
            wait.append(i[full])
        open_ = np.delete(open_, np.concatenate(wait))
        reach *= 2
    return out


def most_alike(seen: np.ndarray, own: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of seen the k rows of own (places) with the least mean absolute difference, and
    that; ties by item. Means differ by no more than rows, so rows come by their means, and a
    window about a row widens until what is outside is farther."""
    n, size = own.shape
    k = min(k, n)
    place, least = np.zeros((len(seen), k), np.int64), np.zeros((len(seen), k))
    mean = own.mean(axis=1)
    order = np.argsort(mean, kind="stable")
    mean, asked = np.concatenate([[-np.inf], mean[order], [np.inf]]), seen.mean(axis=1)
    middle, open_, reach = np.searchsorted(mean[1:-1], asked), np.arange(len(seen)), 8
    while len(open_):
        wide = []
        for part in np.array_split(open_, -(-len(open_) * 2 * reach // 200000)):
            at = middle[part][:, None] + np.arange(-reach, reach)
            inside = (at >= 0) & (at < n)
            j = order[np.clip(at, 0, n - 1)]
            d = np.zeros(at.shape)
            for c in range(size):
                d += np.abs(seen[part, c][:, None] - own[j, c])
            d = np.where(inside, d / size, np.inf)
            row, column = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])  # k of each row, and those that tie
            value, where = d[row, column], j[row, column]
            nth = np.lexsort((item[where], value, row))
            nth = nth[np.searchsorted(row[nth], np.arange(len(part)))[:, None] + np.arange(k)]
            place[part], least[part] = where[nth], value[nth]
            first, last = np.maximum(middle[part] - reach, 0), np.minimum(middle[part] + reach + 1, n + 1)
            gap = np.minimum(asked[part] - mean[first], mean[last] - asked[part])
            wide.append(part[least[part, -1] >= gap - 1e-12])
        open_ = np.concatenate(wide)
        reach *= 2
    return place, least
