"""Steps on tiles, and the whole detector, against versions that take one frame after another."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframe.operators import detector as D
from nightframe.operators import images as I
from nightframe.session import ship

W, H = 150, 110
RNG = np.random.default_rng(5)


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def table(spark, frames):
    rows = [(f, x, y, float(v[y, x])) for f, v in frames.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "frame_id long, x int, y int, v double").repartition(4)


def arrays(df, size, column="v"):
    out = {}
    for r in df.collect():
        out.setdefault(r.frame_id, np.full((size[1], size[0]), np.nan))[r.y, r.x] = r[column]
    return out


def filtered(v):
    kernel, p = I.gaussian(1.2), np.pad(v, 3)
    return sum(k * p[3 + dy : 3 + dy + v.shape[0], 3 + dx : 3 + dx + v.shape[1]] for dx, dy, k in kernel)


def flooded(mask):
    """Pixels of each component, by walking."""
    left, out = {(int(x), int(y)) for y, x in np.argwhere(mask)}, []
    while left:
        todo, blob = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            blob.add((x, y))
            near = {(x + dx, y + dy) for dx, dy in I.AROUND} & left
            left -= near
            todo += near
        out.append(blob)
    return out


def test_filters_across_tiles(spark):
    frames = {1: RNG.normal(0, 1, (H, W)), 2: RNG.integers(0, 4, (H, W)).astype(float)}
    pixels = table(spark, frames)
    got = arrays(I.convolve(pixels, I.gaussian(1.2), (W, H)), (W, H))
    soft = arrays(I.blur(pixels, 1.5, (W, H)), (W, H))
    tops = arrays(I.local_maxima(pixels), (W, H))
    weights = np.exp(-(np.arange(-5, 6) ** 2) / (2 * 1.5**2))
    for f, v in frames.items():
        np.testing.assert_allclose(got[f], filtered(v), atol=1e-9)
        p = np.pad(v, 5, mode="edge")
        want = np.apply_along_axis(np.convolve, 0, np.apply_along_axis(np.convolve, 1, p, weights / weights.sum(), "valid"), weights / weights.sum(), "valid")
        np.testing.assert_allclose(soft[f], want, atol=1e-9)
        p = np.pad(v, 1, constant_values=-np.inf)
        greatest = np.max([p[1 + dy : 1 + dy + H, 1 + dx : 1 + dx + W] for dx, dy in I.AROUND], axis=0)
        assert np.array_equal(~np.isnan(tops[f]), v >= greatest)


def test_a_pixel_is_dealt_about_once(spark):
    from nightframe.operators import tiles

    pixels = table(spark, {1: np.zeros((H, W))})
    n = tiles.by_tile(pixels, lambda t: {"x": np.zeros(1, int), "y": np.zeros(1, int), "n": np.array([np.isfinite(t.v).sum()])}, "n bigint", 3, (W, H)).agg(F.sum("n")).first()[0]
    assert n < 1.25 * W * H


def test_components_across_tiles(spark):
    snake = np.zeros((H, W))
    for i, y in enumerate(range(1, H, 2)):
        snake[y, 1 : W - 1] = 1
        snake[y - 1, (1 if i % 2 else W - 2)] = 1
    spots = (RNG.random((H, W)) < 0.3).astype(float)
    frames = {1: snake, 2: spots, 3: np.zeros((H, W))}
    got = {}
    for r in I.components(table(spark, frames).where("v > 0")).collect():
        got.setdefault((r.frame_id, r.label), set()).add((r.x, r.y))
    want = {(f, min(y * (1 << 20) + x for x, y in b)): b for f, v in frames.items() for b in flooded(v > 0)}
    assert got == want
    assert I.components(table(spark, {1: np.zeros((4, 4))}).where("v > 0")).count() == 0


def test_mesh_with_gaps(spark):
    """A cell without values has no median; missing pixels count for nothing."""
    v = RNG.normal(0, 1, (40, 40))
    v[:10, :10] = 50
    pixels = table(spark, {1: v}).withColumn("v", F.when((F.col("x") < 16) | (F.col("y") < 16), F.col("v")))
    got = {(r.cx, r.cy): r["median"] for r in I.mesh_medians(pixels, 16).collect()}
    assert got[(1, 1)] is None and got[(2, 2)] is None
    part = v[:16, :16].ravel()
    for _ in range(3):
        off = np.abs(part - np.median(part))
        part = part[off <= 3 * 1.4826 * np.median(off)]
    assert got[(0, 0)] == pytest.approx(np.median(part))


def clipped(v):
    for _ in range(3):
        off = np.abs(v - np.median(v))
        near = off <= 3 * (1.4826 * np.median(off))
        v = v[near] if near.any() else v
    return np.median(v)


def noise(v, border, floor):
    inside = v[border : v.shape[0] - border, border : v.shape[1] - border].ravel()
    if not inside.size:
        return floor
    sigma = 1.4826 * np.median(np.abs(inside - np.median(inside)))
    if sigma >= floor:
        return sigma
    s = np.sort(inside)
    return max((s[int((len(s) - 1) * 0.9772)] - s[int((len(s) - 1) * 0.5)]) / 2, floor)


def one_frame(gray, s):
    """The detector, step by step."""
    h, w = gray.shape
    v = gray - np.median(gray, axis=0)
    v = v - np.median(v, axis=1)[:, None]
    m = s.mesh
    grid = np.array([[clipped(v[y : y + m, x : x + m].ravel()) for x in range(0, w, m)] for y in range(0, h, m)])
    bg = np.zeros_like(v)
    for y in range(h):
        for x in range(w):
            fx, fy = (x + 0.5) / m - 0.5, (y + 0.5) / m - 0.5
            ix, iy = math.floor(fx), math.floor(fy)
            at = lambda a, b: grid[min(max(b, 0), grid.shape[0] - 1), min(max(a, 0), grid.shape[1] - 1)]
            bg[y, x] = (1 - fy + iy) * ((1 - fx + ix) * at(ix, iy) + (fx - ix) * at(ix + 1, iy)) + (fy - iy) * ((1 - fx + ix) * at(ix, iy + 1) + (fx - ix) * at(ix + 1, iy + 1))
    v = v - bg
    sigma, conv = noise(v, s.border, s.floor), filtered(v)
    norm = math.sqrt(sum(k * k for _, _, k in I.gaussian(s.kernel_sigma)))
    level = s.noise_times * noise(conv, s.border, s.floor * norm)
    for _ in range(4):
        if (conv > level).mean() > 0.02:
            level *= 2
    counts, found = dict.fromkeys(("accepted", *D.REASONS), 0), []
    all_blobs = flooded(conv > level)
    for blob in all_blobs:
        xs, ys = [p[0] for p in blob], [p[1] for p in blob]
        light = {p: v[p[1], p[0]] for p in blob}
        area, peak = len(blob), max(light.values())
        if min(xs) < s.border or min(ys) < s.border or max(xs) >= w - s.border or max(ys) >= h - s.border:
            counts["border"] += 1
            continue
        if sum(u > 3 * sigma for u in light.values()) < s.core_area:
            counts["small"] += 1
            continue
        if peak < s.peak_times * sigma:
            counts["faint"] += 1
            continue
        core = {p for p in blob if light[p] >= peak / 2} if area > s.most_area else blob
        if area > s.most_area and len(core) > (s.saturated_area if peak >= s.saturated else s.most_area):
            counts["large"] += 1
            continue
        pts = np.array(sorted(core), float)
        weight = np.array([max(light[int(x), int(y)], 0) for x, y in pts])
        d = pts - (weight[:, None] * pts).sum(0) / weight.sum()
        cov = (weight[:, None, None] * d[:, :, None] * d[:, None, :]).sum(0) / weight.sum()
        low, high = np.linalg.eigvalsh(cov)
        elongation = math.sqrt(max(high, 1e-12) / max(low, 1e-12))
        if len(core) >= 6 and elongation > s.elongation:
            counts["elongated"] += 1
            continue
        samples = [*core, *[(x + dx, y + dy) for x, y in core for dx, dy in I.AROUND if (x + dx, y + dy) not in core and 0 <= x + dx < w and 0 <= y + dy < h]]
        samples = [(x, y, v[y, x]) for x, y in samples if v[y, x] > 0]
        flux = sum(u for *_, u in samples)
        cx, cy = sum(x * u for x, _, u in samples) / flux, sum(y * u for _, y, u in samples) / flux
        for _ in range(3):
            ax, ay = math.floor(cx + 0.5), math.floor(cy + 0.5)
            near = [(x, y, v[y, x] * math.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 4.5)) for y in range(max(0, ay - 5), min(h, ay + 6)) for x in range(max(0, ax - 5), min(w, ax + 6)) if v[y, x] > 0]
            total = sum(u for *_, u in near)
            if total > 0:
                cx, cy = sum(x * u for x, _, u in near) / total, sum(y * u for _, y, u in near) / total
        if s.diffuse_area <= area <= s.most_area and peak < s.saturated and peak * area / max(flux, 1e-9) < s.concentration:
            counts["diffuse"] += 1
            continue
        counts["accepted"] += 1
        found.append((flux, cx, cy, peak, area, flux / (sigma * math.sqrt(area))))
    kept = []
    for d in sorted(found, reverse=True):
        if all(math.hypot(d[1] - k[1], d[2] - k[2]) >= s.apart for k in kept):
            kept.append(d)
    return kept[: s.most], {**counts, "candidates": len(all_blobs), "sigma": sigma, "background_median": np.median(gray)}


def scene(seed, stars, level=0.1, spread=0.01):
    rng = np.random.default_rng(seed)
    v = level + rng.normal(0, spread, (H, W)) + np.linspace(0, 0.05, W) + (rng.random(H)[:, None] < 0.1) * 0.03
    y, x = np.mgrid[:H, :W]
    for _ in range(stars):
        cx, cy, f = rng.uniform(0, W), rng.uniform(0, H), rng.uniform(0.05, 0.9)
        v += f * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * 1.3**2))
    return np.clip(v, 0, 1), (x, y)


@pytest.fixture(scope="module")
def frames():
    crowd, _ = scene(1, 60)
    few, (x, y) = scene(2, 12)
    few += 0.9 * np.exp(-((x - 60) ** 2 + (y - 50) ** 2) / (2 * 6.0**2))  # a large one
    few += 0.5 * (np.abs(y - 0.4 * x - 40) < 1.5) * (x > 30) * (x < 80)  # a trail
    few += 0.08 * ((x - 110) ** 2 + (y - 70) ** 2 < 30)  # a flat patch
    return {1: crowd, 2: np.clip(few, 0, 1), 3: scene(3, 0)[0], 4: np.zeros((H, W))}


@pytest.mark.parametrize("settings", [D.CLEAN, D.DEEP, D.Settings(mesh=16, most=5, most_area=20, diffuse_area=6)])
def test_detector_is_that_of_one_frame(spark, frames, settings):
    found, counts = D.detect(table(spark, frames), (W, H), settings)
    rows, totals = found.orderBy("frame_id", "rank").collect(), {r.frame_id: r for r in counts.collect()}
    assert sorted(totals) == sorted(frames)
    for f, gray in frames.items():
        kept, want = one_frame(gray, settings)
        for name, value in want.items():
            assert totals[f][name] == pytest.approx(value, abs=1e-9), (f, name)
        got = [r for r in rows if r.frame_id == f]
        assert [r["rank"] for r in got] == list(range(len(kept)))
        for r, k in zip(got, kept, strict=True):
            assert (r.flux, r.x, r.y, r.peak, r.area, r.snr) == pytest.approx(k, abs=1e-6)
    assert any(one_frame(frames[1], settings)[0])


def test_two_tiers_read_only_what_is_left(spark, frames):
    both = D.in_two_tiers(table(spark, frames), (W, H), 4).collect()
    tiers = {r.frame_id: r.tier for r in both}
    for f, gray in frames.items():
        clean = one_frame(gray, D.CLEAN)[0]
        want = clean if len(clean) >= 4 else one_frame(gray, D.DEEP)[0]
        assert sum(r.frame_id == f for r in both) == len(want)
        assert tiers.get(f, "none") == ("none" if not want else "clean" if len(clean) >= 4 else "deep")


def test_no_frames(spark):
    found, counts = D.detect(table(spark, {}), (W, H))
    assert found.count() == 0 and counts.count() == 0


def test_two_tiers_flatten_frames_once(spark, monkeypatch):
    """The tiers' settings differ in thresholds only, so the deep one takes what the clean one made."""
    made = []
    monkeypatch.setattr(D, "flattened", lambda pixels, size, mesh: made.append(mesh) or pixels)
    monkeypatch.setattr(D.I, "noise_sigma", lambda residual, *_: residual.groupBy("frame_id").agg(F.lit(1.0).alias("sigma")))
    monkeypatch.setattr(D, "blobs", lambda residual, *_: residual)
    row = {"label": "x + 0L", "flux": "v", "peak": "v", "area": "1", "elongation": "1.0D", "reason": "cast(null as string)", "sigma": "1.0D"}
    monkeypatch.setattr(D, "measured", lambda pixels, *_: pixels.selectExpr("frame_id", "x", "y", *[f"{v} AS {k}" for k, v in row.items()]))
    monkeypatch.setattr(D, "suppress", lambda points, *_, **__: points)
    both = D.in_two_tiers(spark.createDataFrame([(1, 0, 0, 1.0), (1, 5, 0, 2.0), (2, 0, 0, 1.0)], "frame_id long, x int, y int, v double"), (8, 8), 2).collect()
    assert sorted((r.frame_id, r.tier) for r in both) == [(1, "clean"), (1, "clean"), (2, "deep")]
    assert len(made) == 1
