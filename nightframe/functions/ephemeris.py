"""Sun, Moon and planets as seen from the Earth's centre, as columns of the Julian day.

The Moon is the truncated series of Meeus, chapter 47; the Sun and the planets follow the mean
Keplerian elements that JPL publishes for 1800 to 2050, which are good to a few arc minutes.
All places are of the equator and equinox of J2000.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import worked_out
from . import sphere as S

AU_KM = 149_597_870.7
J2000, CENTURY = 2451545.0, 36525.0

# Meeus, table 47.A. Multiples of D, M, M' and F; sine terms of the longitude in
# millionths of a degree and cosine terms of the distance in metres.
MOON_LONGITUDE = (
    (0, 0, 1, 0, 6288774, -20905355),
    (2, 0, -1, 0, 1274027, -3699111),
    (2, 0, 0, 0, 658314, -2955968),
    (0, 0, 2, 0, 213618, -569925),
    (0, 1, 0, 0, -185116, 48888),
    (0, 0, 0, 2, -114332, -3149),
    (2, 0, -2, 0, 58793, 246158),
    (2, -1, -1, 0, 57066, -152138),
    (2, 0, 1, 0, 53322, -170733),
    (2, -1, 0, 0, 45758, -204586),
    (0, 1, -1, 0, -40923, -129620),
    (1, 0, 0, 0, -34720, 108743),
    (0, 1, 1, 0, -30383, 104755),
    (2, 0, 0, -2, 15327, 10321),
    (0, 0, 1, 2, -12528, 0),
    (0, 0, 1, -2, 10980, 79661),
    (4, 0, -1, 0, 10675, -34782),
    (0, 0, 3, 0, 10034, -23210),
    (4, 0, -2, 0, 8548, -21636),
    (2, 1, -1, 0, -7888, 24208),
    (2, 1, 0, 0, -6766, 30824),
    (1, 0, -1, 0, -5163, -8379),
    (1, 1, 0, 0, 4987, -16675),
    (2, -1, 1, 0, 4036, -12831),
    (2, 0, 2, 0, 3994, -10445),
    (4, 0, 0, 0, 3861, -11650),
    (2, 0, -3, 0, 3665, 14403),
    (0, 1, -2, 0, -2689, -7003),
    (2, 0, -1, 2, -2602, 0),
    (2, -1, -2, 0, 2390, 10056),
    (1, 0, 1, 0, -2348, 6322),
    (2, -2, 0, 0, 2236, -9884),
    (0, 1, 2, 0, -2120, 5751),
    (0, 2, 0, 0, -2069, 5717),
    (2, -2, -1, 0, 2048, -8950),
)
# Meeus, table 47.B. Sine terms of the latitude in millionths of a degree.
MOON_LATITUDE = (
    (0, 0, 0, 1, 5128122),
    (0, 0, 1, 1, 280602),
    (0, 0, 1, -1, 277693),
    (2, 0, 0, -1, 173237),
    (2, 0, -1, 1, 55413),
    (2, 0, -1, -1, 46271),
    (2, 0, 0, 1, 32573),
    (0, 0, 2, 1, 17198),
    (2, 0, 1, -1, 9266),
    (0, 0, 2, -1, 8822),
    (2, -1, 0, -1, 8216),
    (2, 0, -2, -1, 4324),
    (2, 0, 1, 1, 4200),
    (2, 1, 0, -1, -3359),
    (2, -1, -1, 1, 2463),
    (2, -1, 0, 1, 2211),
    (2, -1, -1, -1, 2065),
    (0, 1, -1, -1, -1870),
    (4, 0, -1, -1, 1828),
    (0, 1, 0, 1, -1794),
)
# Polynomials in Julian centuries of the Moon's mean longitude, its elongation D,
# the anomalies M (Sun) and M' (Moon), and the argument of latitude F, in degrees.
MOON_ARGUMENTS = {
    "l": (218.3164477, 481267.88123421, -0.0015786, 1 / 538841, -1 / 65194000),
    "d": (297.8501921, 445267.1114034, -0.0018819, 1 / 545868, -1 / 113065000),
    "m": (357.5291092, 35999.0502909, -0.0001536, 1 / 24490000),
    "mm": (134.9633964, 477198.8675055, 0.0087414, 1 / 69699, -1 / 14712000),
    "f": (93.2720950, 483202.0175233, -0.0036539, -1 / 3526000, 1 / 863310000),
}
# JPL's mean elements at J2000 and their change in a century: a (AU), e, and in
# degrees the inclination, mean longitude, longitude of perihelion and of the ascending node.
ELEMENTS = {
    "Mercury": ((0.38709927, 3.7e-07), (0.20563593, 1.906e-05), (7.00497902, -0.00594749), (252.2503235, 149472.67411175), (77.45779628, 0.16047689), (48.33076593, -0.12534081)),
    "Venus": ((0.72333566, 3.9e-06), (0.00677672, -4.107e-05), (3.39467605, -0.0007889), (181.9790995, 58517.81538729), (131.60246718, 0.00268329), (76.67984255, -0.27769418)),
    "Earth": ((1.00000261, 5.62e-06), (0.01671123, -4.392e-05), (-1.531e-05, -0.01294668), (100.46457166, 35999.37244981), (102.93768193, 0.32327364), (0.0, 0.0)),
    "Mars": ((1.52371034, 1.847e-05), (0.0933941, 7.882e-05), (1.84969142, -0.00813131), (-4.55343205, 19140.30268499), (-23.94362959, 0.44441088), (49.55953891, -0.29257343)),
    "Jupiter": ((5.202887, -0.00011607), (0.04838624, -0.00013253), (1.30439695, -0.00183714), (34.39644051, 3034.74612775), (14.72847983, 0.21252668), (100.47390909, 0.20469106)),
    "Saturn": ((9.53667594, -0.0012506), (0.05386179, -0.00050991), (2.48599187, 0.00193609), (49.95424423, 1222.49362201), (92.59887831, -0.41897216), (113.66242448, -0.28867794)),
    "Uranus": ((19.18916464, -0.00196176), (0.04725744, -4.397e-05), (0.77263783, -0.00242939), (313.23810451, 428.48202785), (170.9542763, 0.40805281), (74.01692503, 0.04240589)),
    "Neptune": ((30.06992276, 0.00026291), (0.00859048, 5.105e-05), (1.77004347, 0.00035372), (-55.12002969, 218.45945325), (44.96476227, -0.32241464), (131.78422574, -0.00508664)),
}
NAMES = ("a", "e", "i", "l", "peri", "node")
#: Newton steps for Kepler's equation; five reach the last digit for these orbits.
STEPS = 5


def centuries(jd: Column) -> Column:
    return (jd - J2000) / CENTURY


def _polynomial(t: Column, terms: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * t + c, reversed(terms[:-1]), F.lit(float(terms[-1])))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def moon(epochs: DataFrame, jd: str = "jd") -> DataFrame:
    """epochs with moon_ra, moon_dec (degrees) and moon_au."""
    df = worked_out(epochs, t=centuries(F.col(jd)))
    df = worked_out(df, **{n: F.radians(_polynomial(F.col("t"), p)) for n, p in MOON_ARGUMENTS.items()}, ecc=1.0 - 0.002516 * F.col("t") - 0.0000074 * F.col("t") * F.col("t"))
    scale = lambda m: [F.lit(1.0), F.col("ecc"), F.col("ecc") * F.col("ecc")][abs(m)]
    angle = lambda k: _sum([F.lit(float(n)) * F.col(c) for n, c in zip(k, ("d", "m", "mm", "f"), strict=True) if n])
    lon = _sum([scale(x[1]) * float(x[4]) * F.sin(angle(x[:4])) for x in MOON_LONGITUDE]) / 1e6
    km = _sum([scale(x[1]) * float(x[5]) * F.cos(angle(x[:4])) for x in MOON_LONGITUDE if x[5]]) / 1e3 + 385000.56
    lat = _sum([scale(x[1]) * float(x[4]) * F.sin(angle(x[:4])) for x in MOON_LATITUDE]) / 1e6
    # from the equinox of date to that of J2000 by the precession in longitude
    precession = (5028.796195 * F.col("t") + 1.1054348 * F.col("t") * F.col("t")) / 3600.0
    df = worked_out(df, lon=F.degrees("l") + lon - precession, lat=lat, moon_au=km / AU_KM)
    ra, dec = S.ra_dec(S.ecliptic_to_equatorial(S.unit(F.col("lon"), F.col("lat"))))
    return df.withColumn("moon_ra", ra).withColumn("moon_dec", dec).drop("t", *MOON_ARGUMENTS, "ecc", "lon", "lat")


def heliocentric(df: DataFrame, jd: str, prefix: str) -> DataFrame:
    """Adds {prefix}x, y, z (AU, ecliptic of J2000) from the elements a, e, i, l, peri, node, which
    are arrays of value and change in columns of those names."""
    t = centuries(F.col(jd))
    at = {n: F.col(n)[0] + F.col(n)[1] * t for n in NAMES}
    df = worked_out(df, **{f"_{n}": v for n, v in at.items()})
    mean = F.radians(S.wrap180(F.col("_l") - F.col("_peri")))
    df = worked_out(df, _mean=mean, _ecc=mean + F.col("_e") * F.sin(mean))
    old = F.col("_old")
    for _ in range(STEPS):
        better = old - (old - F.col("_e") * F.sin(old) - F.col("_mean")) / (1.0 - F.col("_e") * F.cos(old))
        df = worked_out(df.withColumnRenamed("_ecc", "_old"), _ecc=better).drop("_old")
    x = F.col("_a") * (F.cos("_ecc") - F.col("_e"))
    y = F.col("_a") * F.sqrt(1.0 - F.col("_e") * F.col("_e")) * F.sin("_ecc")
    w, node, i = F.radians(F.col("_peri") - F.col("_node")), F.radians("_node"), F.radians("_i")
    df = worked_out(df, _x=x * F.cos(w) - y * F.sin(w), _y=x * F.sin(w) + y * F.cos(w), _cn=F.cos(node), _sn=F.sin(node), _ci=F.cos(i), _si=F.sin(i))
    c = F.col
    df = worked_out(df, **{f"{prefix}x": c("_x") * c("_cn") - c("_y") * c("_ci") * c("_sn"), f"{prefix}y": c("_x") * c("_sn") + c("_y") * c("_ci") * c("_cn"), f"{prefix}z": c("_y") * c("_si")})
    return df.drop(*[f"_{n}" for n in (*NAMES, "mean", "ecc", "x", "y", "cn", "sn", "ci", "si")])


def _elements(names: list[str]) -> Column:
    row = lambda n: F.struct(F.lit(n).alias("planet"), *[F.array(F.lit(float(v)), F.lit(float(d))).alias(k) for k, (v, d) in zip(NAMES, ELEMENTS[n], strict=True)])
    return F.inline(F.array(*map(row, names)))


#: Days that light takes for an astronomical unit.
LIGHT_DAYS = 0.0057755183


def planets(epochs: DataFrame, jd: str = "jd") -> DataFrame:
    """epochs once for each planet: planet, ra_deg, dec_deg, au, mag, each seen where it was when
    its light left."""
    own = epochs.columns
    earth = epochs.select("*", _elements(["Earth"])).drop("planet")
    earth = heliocentric(earth, jd, "earth_").drop(*NAMES)
    each = earth.select("*", _elements([n for n in ELEMENTS if n != "Earth"]))
    each = heliocentric(each, jd, "now_")
    gap = lambda p: S.Vector(*[F.col(f"{p}{c}") - F.col(f"earth_{c}") for c in "xyz"])
    length = lambda v: F.sqrt(S.dot(v, v))
    each = worked_out(each, _then=F.col(jd) - LIGHT_DAYS * length(gap("now_")))
    each = heliocentric(each, "_then", "then_")
    geo = gap("then_")
    each = worked_out(each, gx=geo.x, gy=geo.y, gz=geo.z, r=length(S.Vector(*[F.col(f"then_{c}") for c in "xyz"])), sun=length(S.Vector(*[F.col(f"earth_{c}") for c in "xyz"])))
    ecliptic = S.Vector(F.col("gx"), F.col("gy"), F.col("gz"))
    equatorial = S.ecliptic_to_equatorial(ecliptic)
    each = worked_out(each, au=length(ecliptic), qx=equatorial.x, qy=equatorial.y, qz=equatorial.z)
    u = S.normalized(S.Vector(F.col("qx"), F.col("qy"), F.col("qz")))
    ra, dec = S.ra_dec(u)
    phase = S.phase_angle(F.col("r"), F.col("au"), F.col("sun"))
    each = worked_out(each, ra_deg=ra, dec_deg=dec, _phase=phase, _ring=S.ring_tilt(S.Vector(F.col("qx"), F.col("qy"), F.col("qz"))))
    mag = S.magnitude(F.col("planet"), F.col("r"), F.col("au"), F.col("_phase"), F.col("_ring"))
    return each.select(*own, "planet", "ra_deg", "dec_deg", "au", mag.alias("mag"))


def sun(epochs: DataFrame, jd: str = "jd") -> DataFrame:
    """epochs with sun_ra, sun_dec and sun_au: opposite to where the Earth is."""
    df = heliocentric(epochs.select("*", _elements(["Earth"])).drop("planet"), jd, "earth_").drop(*NAMES)
    v = S.Vector(*[-F.col(f"earth_{c}") for c in "xyz"])
    equatorial = S.ecliptic_to_equatorial(v)
    df = worked_out(df, sun_au=F.sqrt(S.dot(v, v)), qx=equatorial.x, qy=equatorial.y, qz=equatorial.z)
    ra, dec = S.ra_dec(S.normalized(S.Vector(F.col("qx"), F.col("qy"), F.col("qz"))))
    return df.select(*epochs.columns, ra.alias("sun_ra"), dec.alias("sun_dec"), "sun_au")
