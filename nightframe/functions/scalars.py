"""Parsing, time and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: 35 mm film: the diagonal of 36 x 24 mm; fields of view that a camera can have (degrees).
FILM_DIAGONAL_MM = 43.26661530556787
FOV_MIN, FOV_MAX = 3.0, 95.0
J2000, JULIAN_YEAR = 2451545.0, 365.25


# -- text ------------------------------------------------------------------------------------
def field(x: Column) -> Column:
    """Trimmed; empty is null."""
    t = F.trim(x)
    return F.when(t != "", t)


def number(x: Column) -> Column:
    """A double, or null if the text is no plain decimal number."""
    t = F.trim(x)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def boolean(x: Column) -> Column:
    """true, false, or null for a word that is neither; a missing one is false."""
    t = F.lower(F.trim(x))
    return F.when(x.isNull() | t.isin("", "0", "false", "no", "off"), False).when(t.isin("1", "true", "yes", "on"), True)


def ranged(x: Column, lo: float, hi: float) -> Column:
    """Struct of value and error: null, bad_number or out_of_range. Empty is no value."""
    v = number(x)
    error = F.when(field(x).isNull(), None).when(v.isNull(), "bad_number").when(~v.between(lo, hi), "out_of_range")
    return F.struct(F.when(error.isNull(), v).alias("value"), error.alias("error"))


def words_list(x: Column, sep: str = ",") -> Column:
    """Trimmed parts of a list, without empty ones."""
    return F.filter(F.transform(F.split(x, sep), lambda v: F.trim(v)), lambda v: v != "")


def quaternion(x: Column) -> Column:
    """Four doubles, or null unless there are exactly four numbers."""
    parts = F.transform(F.split(x, ","), lambda v: number(v))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda v: v.isNull()), parts)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


def exposure(stem: Column) -> Column:
    """What follows "Exp-" up to "_", else the last "_" part like 10ms, 2s or 1m, else null."""
    named = F.regexp_extract(stem, r"Exp-([^_]+)", 1)
    last = F.try_element_at(F.filter(F.split(stem, "_"), lambda p: p.rlike(r"^[0-9]+(ms|s|m)$")), F.lit(-1))
    return F.when(named != "", named).otherwise(last)


def cache_name(tag: Column, magnitude: Column, version: str) -> Column:
    return F.concat(F.lit("index-"), tag, F.lit("-mag"), F.round(magnitude * 10).cast("int").cast("string"), F.lit(f"-{version}.bin"))


def hms(deg: Column) -> Column:
    hours = (deg / 15.0) % 24.0
    hours = F.when(hours < 0, hours + 24.0).otherwise(hours)
    minutes = (hours - F.floor(hours)) * 60.0
    return F.format_string("%dh %dm %ds", F.floor(hours), F.floor(minutes), F.floor((minutes - F.floor(minutes)) * 60.0 + 0.5))


def dms(deg: Column) -> Column:
    a = F.abs(deg)
    minutes = (a - F.floor(a)) * 60.0
    return F.concat(F.when(deg < 0, "−").otherwise("+"), F.format_string("%d° %d′ %d″", F.floor(a), F.floor(minutes), F.floor((minutes - F.floor(minutes)) * 60.0 + 0.5)))


def confidence_label(log_odds: Column) -> Column:
    return F.when(log_odds >= 30, "high").when(log_odds >= 18, "medium").when(log_odds.isNotNull(), "low").otherwise("-")


def frame_name(n: Column) -> Column:
    return F.concat(F.lit("frame-"), F.lpad(n.cast("string"), 6, "0"))


# -- time ------------------------------------------------------------------------------------
STAMP = r"^(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})-(\d{3})"
SHORT_STAMP = r"^CD_(\d{4})-(\d{2})-(\d{2})_(\d{2})(\d{2})"


def stem_time(stem: Column) -> Column:
    """Civil time of a file's stem as a struct of its fields, or null: the long form, which may
    be followed by anything, before the short one."""
    part = lambda p, i: F.regexp_extract(stem, p, i).try_cast("int")
    names = ("year", "month", "day", "hour", "minute", "second", "ms")
    long = F.struct(*[part(STAMP, i + 1).alias(n) for i, n in enumerate(names)])
    short = F.struct(*[part(SHORT_STAMP, i + 1).alias(n) for i, n in enumerate(names[:5])], F.lit(0).alias("second"), F.lit(0).alias("ms"))
    return F.when(stem.rlike(STAMP), long).when(stem.rlike(SHORT_STAMP), short)


def day_fraction(t: Column) -> Column:
    return (t["hour"] + t["minute"] / 60.0 + (t["second"] + t["ms"] / 1000.0) / 3600.0) / 24.0


def epoch_year(t: Column) -> Column:
    """Civil year with the part of the year that has passed, over 365 or 366 days."""
    date = F.make_date(t["year"], t["month"], t["day"])
    days = F.dayofyear(F.make_date(t["year"], F.lit(12), F.lit(31)))
    return t["year"] + (F.dayofyear(date) - 1 + day_fraction(t)) / days


def julian_day(t: Column, utc_offset_hours: Column | float = 0.0) -> Column:
    """Of a civil time whose zone is so many hours east of Greenwich."""
    offset = F.lit(utc_offset_hours) if isinstance(utc_offset_hours, (int, float)) else utc_offset_hours
    days = F.datediff(F.make_date(t["year"], t["month"], t["day"]), F.lit("2000-01-01").cast("date"))
    return F.lit(2451544.5) + days + day_fraction(t) - offset / 24.0


def julian_epoch(jd: Column) -> Column:
    return 2000.0 + (jd - J2000) / JULIAN_YEAR


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# -- numbers ---------------------------------------------------------------------------------
def rounded(x: Column, places: int) -> Column:
    """Half away from zero, by scaling."""
    return F.round(x * 10.0**places) / 10.0**places + 0.0


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.lit(1e-6))


def intensity(mag: Column, zero: float, scale: float) -> Column:
    return scale * F.pow(F.lit(10.0), -0.4 * (mag - zero))


def exif_fov(f35: Column, zoom: Column, w: Column, h: Column) -> Column:
    """Horizontal field of view that keeps the 35 mm diagonal, or null if it is unlikely."""
    z = F.when(zoom > 1, zoom).otherwise(1.0)
    tan = FILM_DIAGONAL_MM / (2.0 * f35 * z) * w / F.sqrt(w * w + h * h)
    fov = F.degrees(2.0 * F.atan(tan))
    return F.when(fov.between(FOV_MIN, FOV_MAX), fov)


#: The weight of the prior on distortion, up to a field of view and from one on.
PRIOR = ((30.0, 10.0), (70.0, 2.5))


def distortion_weight(fov: Column) -> Column:
    """Falls in a straight line between the two."""
    (low, full), (high, least) = PRIOR
    return full + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (fov - low) / (high - low))) * (least - full)


def band(center: Column) -> Column:
    """The index band of a field of view: 0.75 to 1.35 of the rounded centre, at most 90."""
    c = F.round(center)
    top = F.least(F.ceil(c * 1.35).cast("double"), F.lit(90.0))
    return F.struct(F.least(F.floor(c * 0.75).cast("double"), top - 1.0).alias("min_fov"), top.alias("max_fov"))


#: Prefixes of detections, and what to try, in order: what a rung needs, its field
#: of view and its tolerance (both null: the hint's own).
PREFIXES = (8, 10, 12, 16, 20, 30)
LEAST_DETECTIONS = 4
RUNGS = (
    (0, "hinted attitude", True, True, None, None),
    (1, "hinted field", True, False, None, None),
    (2, "usual field", False, False, 22.0, 5.0),
    (3, "field 15", None, False, 15.0, 5.25),
    (4, "field 25", None, False, 25.0, 8.75),
    (5, "field 40", None, False, 40.0, 14.0),
    (6, "field 60", None, False, 60.0, 21.0),
)


def rungs(hint: Column, attitude: Column) -> Column:
    """The rungs that a request takes, in order: an array of rung, label, fov, fov_err. A rung is
    for requests with a hint, without one, or for all."""
    near = F.greatest(hint * 0.12, F.lit(5.0))
    each = []
    for rung, label, needs_hint, needs_attitude, fov, err in RUNGS:
        takes = F.lit(True) if needs_hint is None else hint.isNotNull() == F.lit(needs_hint)
        item = F.struct(F.lit(rung).alias("rung"), F.lit(label).alias("label"), (hint if fov is None else F.lit(fov)).cast("double").alias("fov"), (near if err is None else F.lit(err)).cast("double").alias("fov_err"))
        each.append(F.when(takes & (attitude | F.lit(not needs_attitude)), item))
    return F.array_compact(F.array(*each))


def prefixes(n: Column) -> Column:
    """How many of the brightest detections to try, in order."""
    capped = F.array_distinct(F.array(*[F.least(F.lit(p), n) for p in PREFIXES]))
    return F.filter(capped, lambda k: k >= LEAST_DETECTIONS)


def log_odds(hits: Column, n: Column, w: Column, h: Column, radius: float = 3.0) -> Column:
    """Of a match against chance, if 0.85 of the detections are stars."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(0.2), n * F.pi() * radius * radius / (w * h)))
    return F.when(n == 0, 0.0).otherwise(hits * F.log(0.85 / p) + (n - hits) * F.log(0.15 / (1.0 - p)))


def no_match_message(best_fov: Column) -> Column:
    """Fixed texts of a solve without an accepted match, with the field that came nearest, or without one."""
    near = F.concat(F.lit("no candidate cleared verification (need log_odds ≥ 18, hits ≥ 6); best tetra3 FOV guess ≈ "), F.format_string("%.1f", best_fov), F.lit(" deg"))
    return F.when(best_fov.isNull(), "no tetra3 pattern match found across the retry ladder").otherwise(near)


def failed_report(code: Column, message: Column) -> Column:
    """The report of a frame that was not solved, as JSON: nothing but what went wrong."""
    return F.to_json(F.struct(F.lit("failed").alias("status"), F.struct(code.alias("code"), message.alias("message")).alias("failure")))


def quantize(v: Column, scale: float) -> Column:
    """To 8 bits, cutting off the fraction."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), v * scale)).cast("int")
