"""Sizes of the geometry's expressions, and hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from nightframe.functions import scalars as C
from nightframe.functions import sphere as S

A, B, R = F.col, lambda: F.lit(1.0), lambda: F.col("rot")  # columns need a session
SIZES = {
    "rotation": lambda: S.rotation(A("ra"), A("dec"), A("roll")).struct(),
    "pose": lambda: F.struct(*S.pose(S.rotation(A("ra"), A("dec"), A("roll")))),
    "to_camera": lambda: S.to_camera(R(), S.unit(A("ra"), A("dec"))).struct(),
    "unproject": lambda: S.unproject(R(), B(), B(), B(), B(), A("ra"), A("dec")).struct(),
    "project": lambda: F.struct(*S.project(A("cam"), B(), B(), B(), B())),
    "moved": lambda: S.moved(A("ra"), A("dec"), B(), B(), B()).struct(),
    "wcs_roll": lambda: S.wcs_roll(A("ra"), A("dec"), A("roll"), B(), F.lit(True)),
    "slerp": lambda: S.slerp(A("cam"), A("cam"), A("ra")).struct(),
}


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1).select(F.lit(10.0).alias("ra"), F.lit(20.0).alias("dec"), F.lit(30.0).alias("roll"), S.rotation(F.lit(10.0), F.lit(20.0), F.lit(30.0)).struct().alias("rot"), S.Vector(F.lit(0.1), F.lit(0.2), F.lit(1.0)).struct().alias("cam"))


@pytest.mark.parametrize("name", sorted(SIZES))
def test_expressions_stay_small(one, name):
    """Nodes of the analysed expression."""
    plan = one.select(SIZES[name]().alias("x"))._jdf.queryExecution().analyzed()
    assert plan.expressions().apply(0).treeString().count("\n") < 3500


def rows(spark, values, *columns):
    names = [f"c{i}" for i in range(len(values[0]))]
    return [tuple(r) for r in spark.createDataFrame(values, names).select(*columns).collect()]


def test_poses_round_trip(spark):
    cases = [(ra, dec, roll) for ra in (0.0, 83.8, 359.5) for dec in (-90.0, -89.5, -60.0, 0.0, 45.0, 85.0) for roll in (-180.0, -120.0, 0.0, 33.0, 179.0)]
    got = rows(spark, cases, "c0", "c1", "c2", *S.pose(S.rotation(F.col("c0"), F.col("c1"), F.col("c2"))))
    for ra, dec, roll, a, d, r in got:
        assert abs(d - dec) < 1e-6 and abs((r - roll + 180) % 360 - 180) < 1e-6
        assert abs(dec) > 89.99 or abs((a - ra + 180) % 360 - 180) < 1e-6


def test_pixels_round_trip(spark):
    rot = S.rotation(F.col("c0"), F.col("c1"), F.col("c2"))
    u = S.unproject(rot, F.lit(1000.0), F.lit(-0.1), F.lit(740), F.lit(576), F.col("c3"), F.col("c4"))
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 400.0, 300.0), (200.0, -80.0, -170.0, 100.0, 500.0)], ["c0", "c1", "c2", "c3", "c4"])
    _, x, y = S.project(S.to_camera(rot, u), F.lit(1000.0), F.lit(-0.1), F.lit(740), F.lit(576))
    for r in df.withColumns({"x": x, "y": y}).collect():
        assert math.hypot(r.x - r.c3, r.y - r.c4) < 0.05


def test_no_image_behind_the_camera_or_beyond_the_fold(spark):
    seen, _, _ = S.project(S.Vector(F.col("c0"), F.col("c1"), F.col("c2")), F.lit(100.0), F.lit(-0.3), F.lit(10), F.lit(10))
    cases = [(0.0, 0.0, 1.0), (0.0, 0.0, 0.05), (0.0, 0.0, -1.0), (1.06, 0.0, 1.0), (1.0, 0.0, 1.0)]
    assert [r[0] for r in rows(spark, cases, seen)] == [True, False, False, False, True]


def test_slerp_turns_to_the_antipode_beyond_90_degrees(spark):
    at = lambda ra: S.unit(F.col(ra), F.lit(0.0))
    ra, _ = S.ra_dec(S.slerp(at("c0"), at("c1"), F.lit(0.5)))
    assert [round(r[0], 6) for r in rows(spark, [(10.0, 70.0), (0.0, 100.0), (0.0, 1.0)], ra)] == [40.0, 320.0, 0.5]


def test_wraps(spark):
    values = [(180.0,), (190.0,), (-190.0,), (765.0,), (-180.0,)]
    assert [r[0] for r in rows(spark, values, S.wrap180(F.col("c0")))] == [-180.0, -170.0, 170.0, 45.0, -180.0]
    assert [r[0] for r in rows(spark, values, S.shortest(F.col("c0"), F.lit(0.0)))] == [-180.0, -170.0, 170.0, 45.0, -180.0]


def test_hand_values(spark):
    odds = rows(spark, [(11, 33), (8, 33)], C.log_odds(F.col("c0"), F.col("c1"), F.lit(740), F.lit(576)))
    assert odds[0][0] >= 18 > odds[1][0]
    band = rows(spark, [(65.0,), (95.0,)], C.band(F.col("c0")))
    assert tuple(band[0][0]) == (48.0, 88.0) and band[1][0].max_fov == 90.0
    assert rows(spark, [(25,)], C.prefixes(F.col("c0"))) == [([8, 10, 12, 16, 20, 25],)]
