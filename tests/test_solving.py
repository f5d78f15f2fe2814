"""The solver on frames of a scattered sky: index, ladder, tiers, hints, rematch."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframe.functions import camera as C
from nightframe.functions import scalars
from nightframe.operators import patterns, solving
from nightframe.session import ship

W, H, FOCAL = 740, 576, 1900.0


def sky():
    rng = np.random.default_rng(12)
    n = 2500
    return [(i, float(rng.uniform(0, 360)), float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(m)) for i, m in zip(range(n), np.round(rng.uniform(-1, 6.7, n), 2), strict=True)]


SKY = sky()
POSES = [(0, 10.0, 5.0, 0.0), (1, 200.0, -40.0, 170.0), (2, 120.0, 80.0, -60.0), (3, 359.5, 30.0, 45.0), (4, 77.0, -89.0, 10.0), (5, 300.0, 60.0, -120.0), (6, 45.0, -10.0, 90.0)]


def shown(frame, ra, dec, roll, focal=FOCAL, k1=0.0, noise=0.4):
    """Detections of a frame, without names: x, y, flux."""
    rng = np.random.default_rng(frame)
    world = C.unit(np.array([s[1] for s in SKY]), np.array([s[2] for s in SKY]))
    x, y = C.project(C.to_camera(C.rotation(np.array(ra), np.array(dec), np.array(roll)), world), focal, k1, W, H)
    inside = np.flatnonzero((x >= 0) & (x < W) & (y >= 0) & (y < H))
    return [(frame, float(x[i] + rng.normal(0, noise)), float(y[i] + rng.normal(0, noise)), 10.0 - SKY[i][3]) for i in inside if i % 9]


@pytest.fixture(scope="module")
def stars(spark):
    ship(spark)
    return spark.createDataFrame(SKY, "star_id long, ra_deg double, dec_deg double, mag double")


@pytest.fixture(scope="module")
def index(stars, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("patterns") / "index")
    patterns.write_index(patterns.index(stars), path)
    return patterns.read_index(stars.sparkSession, path)


def frames(spark, poses=POSES, hint=None, attitude=None):
    rows = [(f, W, H, hint, *(attitude or {}).get(f, (None, None, None))) for f, *_ in poses]
    return spark.createDataFrame(rows, "frame_id long, w int, h int, hint double, hint_ra double, hint_dec double, hint_roll double")


def detections(spark, rows):
    return spark.createDataFrame(rows, "frame_id long, x double, y double, flux double")


def off(r, pose):
    a, b = C.unit(np.array(r.ra), np.array(r.dec)), C.unit(np.array(pose[1]), np.array(pose[2]))
    return float(np.degrees(np.arccos(min(1.0, a @ b))))


def test_index_reads_scales_alone(spark, index, tmp_path):
    assert {r.scale for r in index.select("scale").distinct().collect()} == set(patterns.SCALES)
    assert index.count() == index.select(F.array_sort("stars")).distinct().count()
    path = str(tmp_path / "index")
    patterns.write_index(index, path)
    near = patterns.read_index(spark, path, 22.0, 2.0)
    assert {r.scale for r in near.select("scale").distinct().collect()} == {15.0, 22.0, 33.0}
    assert "PartitionFilters: [isnotnull(scale" in near._jdf.queryExecution().simpleString() and near.count() < index.count()


def test_quads_do_not_depend_on_the_turn(spark):
    """A quad's ratios and the order of its points are the same from anywhere."""
    rng = np.random.default_rng(1)
    u = C.rays(rng.uniform(0, W, 4), rng.uniform(0, H, 4), FOCAL, W, H)
    rows = [(k, [(i, *map(float, v)) for i, v in enumerate(u @ C.rotation(np.array(40.0 * k), np.array(20.0 * k - 60), np.array(77.0 * k)))]) for k in range(6)]
    df = spark.createDataFrame(rows, "k int, q array<struct<id: int, x: double, y: double, z: double>>")
    got = patterns.with_shape(df, "id").collect()
    edges = sorted(np.linalg.norm(u[a] - u[b]) for a, b in combinations(range(4), 2))
    for r in got:
        assert np.allclose(r.ratio, np.array(edges[:5]) / edges[5], atol=1e-9) and abs(r.longest - edges[5]) < 1e-9
        assert [p.id for p in r.q] == [p.id for p in got[0].q]


def test_probes_cover_the_tolerance(spark):
    rng = np.random.default_rng(2)
    ratio = np.sort(rng.uniform(0.05, 1.0, (200, 5)), axis=1)
    near = np.clip(ratio + rng.uniform(-patterns.RATIO_ERROR, patterns.RATIO_ERROR, ratio.shape), 0, 1)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(ratio, near, strict=True)], "a array<double>, b array<double>")
    key = patterns.key_of([F.floor(F.col("b")[i] / patterns.BIN) for i in range(5)])
    assert df.where(F.array_contains(patterns.probes(F.col("a")), key)).count() == 200


def test_rungs():
    labels = [r[1] for r in scalars.RUNGS]
    assert labels[0] == "hinted attitude" and len(set(labels)) == len(labels)


def test_blind_solve_and_failures(spark, stars, index):
    """Frames are found without ids or hints; too few detections, and chance ones, are not."""
    rng = np.random.default_rng(3)
    rows = [d for p in POSES for d in shown(*p)] + [(7, 1.0 * i, 2.0 * i, 5.0) for i in range(3)] + [(8, float(rng.uniform(0, W)), float(rng.uniform(0, H)), float(rng.uniform(3, 10))) for _ in range(12)]
    poses = [*POSES, (7, 0, 0, 0), (8, 0, 0, 0), (9, 0, 0, 0)]
    # two stages at a time, and every rung by itself: the same winners
    dets = detections(spark, rows)
    got = {r.frame_id: r for r in solving.solve(frames(spark, poses), dets, stars, index).collect()}
    for p in POSES:
        r = got[p[0]]
        assert r.status == "solved" and off(r, p) < 0.05 and abs((r.roll - p[3] + 180) % 360 - 180) < (5 if abs(p[2]) > 85 else 0.3)
        assert abs(r.fov_x - 22.04) < 0.3 and r.n_inliers >= 6 and len(r.matched) == r.n_inliers and r.confidence > 0.45
    assert (got[7].status, got[7].failure, got[7].ra) == ("failed", "too_few_stars", None)
    assert got[8].failure == "no_confident_match" and got[9].failure == "too_few_stars"
    asked = frames(spark, poses)
    numbered = solving.numbered(dets, solving.CLEAN)
    small = scalars.PREFIXES[:2]
    ways = [(((1, 1), small[:1]), ((1, 1), small[1:]), ((2, 99), small)), (((1, 99), small),)]
    key = lambda rows: sorted((r.frame_id, r.rung, r.prefix, r.hits, round(r.ra, 6)) for r in rows.collect())
    first, second = (key(solving.ladder(asked, numbered, stars, index, stages)) for stages in ways)
    assert first == second and {r[0] for r in first} >= {0, 1, 2, 3}


def test_deep_tier_is_for_what_is_left(spark, stars, index):
    clean = detections(spark, [d for d in shown(*POSES[0])] + shown(*POSES[1])[:3])
    deep = detections(spark, [d for p in POSES[:2] for d in shown(*p)])
    got = {r.frame_id: r for r in solving.solve(frames(spark, POSES[:2]), clean, stars, index, deep, stages=(((1, 1), scalars.PREFIXES[:2]),)).collect()}
    assert (got[0].tier, got[1].tier) == ("clean", "deep") and off(got[1], POSES[1]) < 0.05


def test_hints(spark, stars, index):
    """A field of view that no blind rung has is found by its hint; a wrong attitude does no harm."""
    odd = [(0, 10.0, 5.0, 0.0), (1, 200.0, -40.0, 170.0)]
    focal = W / (2 * np.tan(np.radians(30.0) / 2))
    rows = detections(spark, [d for p in odd for d in shown(*p, focal=focal)])
    stages = (((1, 2), scalars.PREFIXES[:3]),)
    got = {r.frame_id: r for r in solving.solve(frames(spark, odd, hint=30.0, attitude={0: (11.0, 4.0, 0.0), 1: (20.0, 40.0, 0.0)}), rows, stars, index, stages=stages).collect()}
    assert all(r.status == "solved" and off(r, odd[f]) < 0.05 and abs(r.fov_x - 30) < 0.3 for f, r in got.items())
    assert (got[0].rung, got[1].rung) == (0, 1)


def test_wide_frames_are_matched_again(spark, stars):
    poses = [(0, 80.0, 20.0, 15.0), (1, 250.0, -35.0, -80.0)]
    rows = [d for p in poses for d in shown(*p, focal=420.0, k1=-0.06, noise=0.1)]
    dets = solving.numbered(detections(spark, rows), solving.CLEAN)
    start = spark.createDataFrame([(f, 3, 8, ra, dec, roll, 418.0, W, H, 40, "hard") for f, ra, dec, roll in poses], "frame_id long, rung int, prefix int, ra double, dec double, roll double, focal double, w int, h int, n_detections long, accepted string")
    before = {r.frame_id: r.n for r in solving.matches(start.withColumn("k1", F.lit(0.0)), stars, dets, solving.VERIFY_PX).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.frame_id: r for r in solving.refined(start, stars, dets).collect()}
    assert all(got[f].hits > before[f] + 5 and abs(got[f].k1 + 0.06) < 0.01 and abs(got[f].focal - 420) < 1 for f in got)
    narrow = spark.createDataFrame([(0, 2, 8, *POSES[0][1:], FOCAL, W, H, 12, "hard")], start.schema)
    near = solving.numbered(detections(spark, shown(*POSES[0])), solving.CLEAN)
    r = solving.refined(narrow, stars, near).first()
    assert r.hits >= 6 and abs(r.focal - FOCAL) < 10
