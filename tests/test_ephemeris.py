"""Against almanac places of the Sun, the Moon and Neptune at 2011-09-21 0h and 2026-07-01 0h."""

import math

from pyspark.sql import functions as F

from nightframe.functions import ephemeris

EPOCHS = [(2455825.5,), (2461222.5,)]
SUN = [(177.716371015, 0.989743986), (99.616219275, 23.141364569)]
MOON = [(92.723176638, 22.124465512), (292.002295991, -25.262251267)]


def apart(a, b):
    (r1, d1), (r2, d2) = (map(math.radians, x) for x in (a, b))
    return math.degrees(math.acos(min(1.0, math.sin(d1) * math.sin(d2) + math.cos(d1) * math.cos(d2) * math.cos(r1 - r2))))


def test_sun_and_moon(spark):
    df = ephemeris.moon(ephemeris.sun(spark.createDataFrame(EPOCHS, ["jd"]))).orderBy("jd")
    for r, sun, moon in zip(df.collect(), SUN, MOON, strict=True):
        assert apart((r.sun_ra, r.sun_dec), sun) < 0.02 and abs(r.sun_au - 1) < 0.02
        assert apart((r.moon_ra, r.moon_dec), moon) < 0.15 and 0.0023 < r.moon_au < 0.0028


def test_planets(spark):
    got = {(r.jd, r.planet): r for r in ephemeris.planets(spark.createDataFrame(EPOCHS, ["jd"])).collect()}
    assert len(got) == 14
    neptune = got[2461222.5, "Neptune"]
    assert apart((neptune.ra_deg, neptune.dec_deg), (4.244387127, 0.348592240)) < 0.1 and abs(neptune.mag - 7.762) < 0.5
    for (jd, name), r in got.items():
        assert r.au > 0 and (name not in ("Mercury", "Venus") or apart((r.ra_deg, r.dec_deg), SUN[jd > 2460000]) < 48)


def test_no_epochs(spark):
    none = spark.range(0).select(F.lit(0.0).alias("jd"))
    assert ephemeris.planets(none).count() == 0 and ephemeris.moon(none).count() == 0
