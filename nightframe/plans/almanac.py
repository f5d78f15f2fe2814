"""Queries over the Sun, the Moon and the planets at the days of the solve log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ephemeris as E
from ..functions import sphere as S
from .bindings import R, r6
from .registry import query


def days(t):
    """jd: midnights, which both engines have exactly."""
    jd = F.datediff(F.col("ts").cast("date"), F.lit("2000-01-01").cast("date")) + 2451544.5
    return t.solve_log.select(jd.alias("jd")).distinct()


_DAYS = "SELECT DISTINCT 2451544.5::DOUBLE + date_diff('day', DATE '2000-01-01', ts::DATE) AS jd FROM solve_log"
_POLY = {n: "radians(" + " + ".join(f"{c!r}::DOUBLE" + " * t" * i for i, c in enumerate(p)) + ")" for n, p in E.MOON_ARGUMENTS.items()}
_ANGLE = "(k.d * e.d + k.m * e.m + k.mm * e.mm + k.f * e.f)"
_LON = ", ".join(f"({a}, {b}, {c}, {d}, {s}::DOUBLE, {r}::DOUBLE)" for a, b, c, d, s, r in E.MOON_LONGITUDE)
_LAT = ", ".join(f"({a}, {b}, {c}, {d}, {s}::DOUBLE)" for a, b, c, d, s in E.MOON_LATITUDE)


@query("g19_moon", f"""
WITH t AS (SELECT jd, (jd - 2451545.0) / 36525.0 AS t FROM ({_DAYS})
), e AS (SELECT jd, t, {", ".join(f"{x} AS {n}" for n, x in _POLY.items())}, 1 - 0.002516::DOUBLE * t - 0.0000074::DOUBLE * t * t AS ecc FROM t
), lon AS (SELECT jd, sum(sl * pow(ecc, abs(k.m)) * sin({_ANGLE})) / 1e6 AS lon, sum(sr * pow(ecc, abs(k.m)) * cos({_ANGLE})) / 1e3 AS km FROM e, (VALUES {_LON}) AS k(d, m, mm, f, sl, sr) GROUP BY jd
), lat AS (SELECT jd, sum(sb * pow(ecc, abs(k.m)) * sin({_ANGLE})) / 1e6 AS lat FROM e, (VALUES {_LAT}) AS k(d, m, mm, f, sb) GROUP BY jd
), p AS (SELECT jd, radians(degrees(l) + lon - (5028.796195::DOUBLE * t + 1.1054348::DOUBLE * t * t) / 3600) AS a, radians(lat) AS b, (km + 385000.56::DOUBLE) / 149597870.7::DOUBLE AS au FROM e JOIN lon USING (jd) JOIN lat USING (jd)
), v AS (SELECT jd, au, cos(b) * cos(a) AS x, cos(b) * sin(a) * cos(radians(23.439291111::DOUBLE)) - sin(b) * sin(radians(23.439291111::DOUBLE)) AS y, cos(b) * sin(a) * sin(radians(23.439291111::DOUBLE)) + sin(b) * cos(radians(23.439291111::DOUBLE)) AS z FROM p)
SELECT jd, {r6('degrees(atan2(y, x)) + CASE WHEN degrees(atan2(y, x)) < 0 THEN 360 ELSE 0 END')} AS ra, {r6('degrees(asin(z))')} AS dec, {r6('au * 1000')} AS milli_au FROM v""")
def _(t):
    m = E.moon(days(t))
    return m.select("jd", R(F.col("moon_ra")).alias("ra"), R(F.col("moon_dec")).alias("dec"), R(F.col("moon_au") * 1000).alias("milli_au"))


@query("g20_planets")
def _(t):
    """Against almanac places in tests/test_ephemeris.py."""
    return E.planets(days(t)).select("jd", "planet", *[R(F.col(c)).alias(c) for c in ("ra_deg", "dec_deg", "au", "mag")])


@query("g21_sun")
def _(t):
    """Against almanac places in tests/test_ephemeris.py."""
    return E.sun(days(t)).select("jd", *[R(F.col(c)).alias(c) for c in ("sun_ra", "sun_dec", "sun_au")])


@query("u02_planets_and_moon")
def _(t):
    """All bodies of a day but the Sun."""
    moon = E.moon(days(t)).select("jd", F.lit("Moon").alias("planet"), R(F.col("moon_ra")).alias("ra_deg"), R(F.col("moon_dec")).alias("dec_deg"))
    return E.planets(days(t)).select("jd", "planet", R(F.col("ra_deg")).alias("ra_deg"), R(F.col("dec_deg")).alias("dec_deg")).unionByName(moon)


_TILT = "degrees(asin(greatest(-1.0, least(1.0, -({px} * sx + {py} * sy + {pz} * sz)))))".format(px="cos(radians(83.537::DOUBLE)) * cos(radians(40.589::DOUBLE))", py="cos(radians(83.537::DOUBLE)) * sin(radians(40.589::DOUBLE))", pz="sin(radians(83.537::DOUBLE))")
_PHASE = "(degrees(acos(greatest(-1.0, least(1.0, (r * r + delta * delta - 1) / (2 * r * delta))))))"


@query("g22_magnitudes", f"""
SELECT star_id, {r6('5 * log10(r * delta) + CASE star_id % 3 WHEN 0 THEN -1.52 + 0.016 * p WHEN 1 THEN -4.40 + p * (0.0009 + p * (0.000239 - 0.00000065 * p)) ELSE -8.88 - 2.60 * b + 1.25 * b * b END')} AS mag, {r6('ring')} AS ring
FROM (SELECT *, {_PHASE} AS p, abs(sin(radians(ring))) AS b FROM (SELECT star_id, 1.2::DOUBLE + (star_id % 50) / 10.0::DOUBLE AS r, 0.9::DOUBLE + (star_id % 40) / 10.0::DOUBLE AS delta, {_TILT} AS ring FROM star_units))""".replace("0.016 *", "0.016::DOUBLE *").replace("0.00000065 *", "0.00000065::DOUBLE *"))
def _(t):
    """Of made-up distances, toward each star."""
    k, u = F.col("star_id"), S.unit(F.col("ra_deg"), F.col("dec_deg"))
    r, delta = 1.2 + (k % 50) / 10.0, 0.9 + (k % 40) / 10.0
    planet = F.when(k % 3 == 0, "Mars").when(k % 3 == 1, "Venus").otherwise("Saturn")
    df = t.stars.select("star_id", planet.alias("planet"), r.alias("r"), delta.alias("delta"), S.ring_tilt(u).alias("ring"))
    df = df.withColumn("phase", S.phase_angle(F.col("r"), F.col("delta"), F.lit(1.0)))
    return df.select("star_id", R(S.magnitude(F.col("planet"), F.col("r"), F.col("delta"), F.col("phase"), F.col("ring"))).alias("mag"), R(F.col("ring")).alias("ring"))


@query("g18_ecliptic", f"SELECT star_id, {r6('sx')} AS x, {r6('sy * cos(radians(23.439291111::DOUBLE)) - sz * sin(radians(23.439291111::DOUBLE))')} AS y, {r6('sy * sin(radians(23.439291111::DOUBLE)) + sz * cos(radians(23.439291111::DOUBLE))')} AS z FROM star_units")
def _(t):
    v = S.ecliptic_to_equatorial(S.unit(F.col("ra_deg"), F.col("dec_deg")))
    return t.stars.select("star_id", *[R(x).alias(c) for c, x in zip("xyz", v, strict=True)])
