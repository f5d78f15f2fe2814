"""Queries over text, time and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..functions import sphere as S
from ..operators import matching
from .bindings import R, r6
from .registry import query


def _cases(values: list[str], name: str = "raw") -> str:
    """One of the values for each event, as an expression of both engines."""
    return f"CASE event_id % {len(values) + 1} {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))} END AS {name}"


def cases(t, values: list[str]):
    """id, raw."""
    return t.read("events").select(F.col("event_id").alias("id"), F.expr(_cases(values)))


def _from(values: list[str]) -> str:
    return f"(SELECT event_id AS id, {_cases(values)} FROM events)"


FIELDS = ["  a b ", "", "   ", "x", "0"]
NUMBERS = ["12", " -3.5 ", "1e3", ".5", "7.", "1.5d", "abc", "", "0x10", "1 2", "+4", "NaN", "4.0f"]
_NUMBER = r"CASE WHEN regexp_matches(trim(raw), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(raw) AS DOUBLE) END"


@query("f01_field", f"SELECT id, nullif(trim(raw), '') AS value FROM {_from(FIELDS)}")
def _(t):
    return cases(t, FIELDS).select("id", C.field(F.col("raw")).alias("value"))


@query("f02_number", f"SELECT id, {_NUMBER} AS value FROM {_from(NUMBERS)}")
def _(t):
    return cases(t, NUMBERS).select("id", C.number(F.col("raw")).alias("value"))


@query("p16_ranged", f"""
SELECT id, CASE WHEN error IS NULL THEN v END AS value, error FROM (
  SELECT *, CASE WHEN raw IS NULL OR trim(raw) = '' THEN NULL WHEN v IS NULL THEN 'bad_number' WHEN v NOT BETWEEN 3 AND 95 THEN 'out_of_range' END AS error FROM (SELECT *, {_NUMBER} AS v FROM {_from(NUMBERS)}))""")
def _(t):
    r = C.ranged(F.col("raw"), 3.0, 95.0)
    return cases(t, NUMBERS).select("id", r["value"].alias("value"), r["error"].alias("error"))


@query("p27_depth_knob", f"SELECT id, CASE WHEN v BETWEEN 5 AND 9 THEN v ELSE 6.5 END AS depth FROM (SELECT *, {_NUMBER} AS v FROM {_from(NUMBERS)})")
def _(t):
    """What is no number from 5 to 9 counts as not set."""
    v = C.number(F.col("raw"))
    return cases(t, NUMBERS).select("id", F.when(v.between(5.0, 9.0), v).otherwise(6.5).alias("depth"))


BOOLEANS = ["1", "TRUE", " yes ", "on", "0", "False", "no", "off", "", "maybe", "2"]


@query("p17_bool", f"SELECT id, CASE WHEN raw IS NULL OR lower(trim(raw)) IN ('', '0', 'false', 'no', 'off') THEN false WHEN lower(trim(raw)) IN ('1', 'true', 'yes', 'on') THEN true END AS value FROM {_from(BOOLEANS)}")
def _(t):
    return cases(t, BOOLEANS).select("id", C.boolean(F.col("raw")).alias("value"))


MODES = ["", "none", "png", "inline", "gif", " PNG "]


@query("p32_overlay_mode", f"SELECT id, CASE coalesce(trim(raw), '') WHEN '' THEN 'none' WHEN 'none' THEN 'none' WHEN 'png' THEN 'png' WHEN 'inline' THEN 'inline' END AS mode FROM {_from(MODES)}")
def _(t):
    """Null for a mode that there is none of."""
    m = F.coalesce(F.trim("raw"), F.lit(""))
    return cases(t, MODES).select("id", F.when(m == "", "none").when(m.isin("none", "png", "inline"), m).alias("mode"))


LISTS = ["a, b,,c ", "", ",", "one", " x ,y", "22, 40,7,abc,95,96"]


@query("f08_list", f"SELECT id, array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM {_from(LISTS)}")
def _(t):
    return cases(t, LISTS).select("id", F.array_join(C.words_list(F.col("raw")), "|").alias("parts"))


@query("p29_prewarm", f"SELECT id, array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: TRY_CAST(trim(x) AS INTEGER)), lambda x: x BETWEEN 8 AND 95), '|') AS fovs FROM {_from(LISTS)}")
def _(t):
    """Whole degrees from 8 to 95."""
    fovs = F.filter(F.transform(C.words_list(F.col("raw")), lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))), lambda v: v.between(8, 95))
    return cases(t, LISTS).select("id", F.array_join(F.transform(fovs, lambda v: v.cast("string")), "|").alias("fovs"))


QUATERNIONS = ["1,0,0,0", "0.5, 0.5,0.5 ,0.5", "1,2,3", "1,2,3,4,5", "a,b,c,d", ""]


@query("f09_quaternion", f"SELECT id, q[1] AS w, q[2] AS x, q[3] AS y, q[4] AS z FROM (SELECT id, CASE WHEN len(p) = 4 AND len(list_filter(p, lambda v: v IS NULL)) = 0 THEN p END AS q FROM (SELECT id, list_transform(string_split(raw, ','), lambda v: TRY_CAST(trim(v) AS DOUBLE)) AS p FROM {_from(QUATERNIONS)}))")
def _(t):
    q = C.quaternion(F.col("raw"))
    return cases(t, QUATERNIONS).select("id", *[q[i].alias(c) for i, c in enumerate("wxyz")])


STEMS = ["CD_2011-09-19_0020", "2011-09-20_23-49-51-296_Gain-128_Exp-20m", "g128_40ms_1s", "x_Exp-5s_2m", "plain", "2024-02-29_01-02-03-004", "10ms_y"]
_LONG = r"^(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})-(\d{3})"
_SHORT = r"^CD_(\d{4})-(\d{2})-(\d{2})_(\d{2})(\d{2})"
_PARTS = ("year", "month", "day", "hour", "minute", "second", "ms")


def _stem_sql(source: str) -> str:
    part = lambda i: f"CASE WHEN regexp_matches(stem, '{_LONG}') THEN TRY_CAST(regexp_extract(stem, '{_LONG}', {i + 1}) AS INTEGER) WHEN regexp_matches(stem, '{_SHORT}') THEN " + (f"TRY_CAST(regexp_extract(stem, '{_SHORT}', {i + 1}) AS INTEGER)" if i < 5 else "0") + " END"
    return f"SELECT id, {', '.join(f'{part(i)} AS {n}' for i, n in enumerate(_PARTS))} FROM {source}"


@query("f03_stem_time", _stem_sql("stems"))
def _(t):
    time = C.stem_time(F.col("stem"))
    return t.stems.select("id", *[time[n].alias(n) for n in _PARTS])


@query("f05_stem_precedence", _stem_sql(f"(SELECT id, raw AS stem FROM {_from(STEMS)})"))
def _(t):
    time = C.stem_time(F.col("raw"))
    return cases(t, STEMS).select("id", *[time[n].alias(n) for n in _PARTS])


@query("f06_exposure", f"""
SELECT id, CASE WHEN regexp_extract(raw, 'Exp-([^_]+)', 1) <> '' THEN regexp_extract(raw, 'Exp-([^_]+)', 1) ELSE list_filter(string_split(raw, '_'), lambda p: regexp_matches(p, '^[0-9]+(ms|s|m)$'))[-1] END AS label FROM {_from(STEMS)}""")
def _(t):
    return cases(t, STEMS).select("id", C.exposure(F.col("raw")).alias("label"))


_NAME = r"regexp_extract(url, '([^/]*)$', 1)"


@query("f07_paths", rf"SELECT page_id, {_NAME} AS name, CASE WHEN regexp_matches({_NAME}, '^.+\.[^.]*$') THEN regexp_extract({_NAME}, '^(.+)\.[^.]*$', 1) ELSE {_NAME} END AS stem, lower(regexp_extract({_NAME}, '^.+\.([^.]*)$', 1)) AS extension FROM pages")
def _(t):
    url = F.col("url")
    return t.read("pages").select("page_id", C.file_name(url).alias("name"), C.file_stem(url).alias("stem"), C.extension(url).alias("extension"))


FILES = ["a.PNG", "b.tif", "c.txt", "d", "e.jpeg", ".bmp", "x/y.Bmp"]


@query("p22_image_types", rf"SELECT id, lower(regexp_extract(regexp_extract(raw, '([^/]*)$', 1), '^.+\.([^.]*)$', 1)) IN ('png', 'jpg', 'jpeg', 'bmp', 'tif', 'tiff') AS image FROM {_from(FILES)}")
def _(t):
    return cases(t, FILES).select("id", C.extension(F.col("raw")).isin(*C.IMAGE_TYPES).alias("image"))


@query("f10_cache_name", "SELECT star_id, 'index-' || con || '-mag' || round(mag * 10)::INTEGER || '-v1.bin' AS name FROM stars")
def _(t):
    return t.stars.select("star_id", C.cache_name(F.col("con"), F.col("mag"), "v1").alias("name"))


_HOURS = "((ra_deg / 15.0::DOUBLE) % 24)"
_MINUTES = f"(({_HOURS} - floor({_HOURS})) * 60)"
_ARC = "((abs(dec_deg) - floor(abs(dec_deg))) * 60)"


@query("f11_hms_dms", f"""
SELECT star_id, floor({_HOURS})::BIGINT || 'h ' || floor({_MINUTES})::BIGINT || 'm ' || floor(({_MINUTES} - floor({_MINUTES})) * 60 + 0.5)::BIGINT || 's' AS ra,
  CASE WHEN dec_deg < 0 THEN '−' ELSE '+' END || floor(abs(dec_deg))::BIGINT || '° ' || floor({_ARC})::BIGINT || '′ ' || floor(({_ARC} - floor({_ARC})) * 60 + 0.5)::BIGINT || '″' AS dec FROM stars""")
def _(t):
    return t.stars.select("star_id", C.hms(F.col("ra_deg")).alias("ra"), C.dms(F.col("dec_deg")).alias("dec"))


@query("f12_confidence", "SELECT id, CASE WHEN k % 11 = 0 THEN '-' WHEN wall_ms % 50 >= 30 THEN 'high' WHEN wall_ms % 50 >= 18 THEN 'medium' ELSE 'low' END AS label FROM solve_log")
def _(t):
    odds = F.when(F.col("k") % 11 != 0, F.col("wall_ms") % 50)
    return t.solve_log.select("id", C.confidence_label(odds).alias("label"))


MESSAGES = ["too few stars: 3 stars found", "only 1 star", "no match", "timeout after 25 s"]


@query("f13_star_count", rf"SELECT id, TRY_CAST(regexp_extract(raw, '([0-9]+)\s+star', 1) AS INTEGER) AS stars FROM {_from(MESSAGES)}")
def _(t):
    return cases(t, MESSAGES).select("id", F.regexp_extract("raw", r"([0-9]+)\s+star", 1).try_cast("int").alias("stars"))


STAGES = ["Detecting stars", "matching quads", "Refine pose", "Overlay", "load image", "else"]


@query("f15_stage", f"SELECT id, CASE WHEN lower(raw) LIKE '%detect%' THEN 'detect' WHEN lower(raw) LIKE '%match%' THEN 'match' WHEN lower(raw) LIKE '%refine%' THEN 'refine' WHEN lower(raw) LIKE '%overlay%' THEN 'overlay' WHEN raw IS NOT NULL THEN 'other' END AS stage FROM {_from(STAGES)}")
def _(t):
    low = F.lower("raw")
    stage = F.lit(None).cast("string")
    for name in ("overlay", "refine", "match", "detect"):
        stage = F.when(low.contains(name), name).otherwise(stage)
    return cases(t, STAGES).select("id", F.when(F.col("raw").isNotNull(), F.coalesce(stage, F.lit("other"))).alias("stage"))


@query("f14_frame_name", "SELECT frame_id, 'frame-' || lpad(frame_id::VARCHAR, 6, '0') AS name FROM frames")
def _(t):
    return t.frames.select("frame_id", C.frame_name(F.col("frame_id")).alias("name"))


# -- time ------------------------------------------------------------------------------------
_FRACTION = "((epoch_ms(ts) % 86400000) / 86400000.0::DOUBLE)"


@query("f20_epoch_year", f"SELECT id, {r6(f'year(ts) + (dayofyear(ts) - 1 + {_FRACTION}) / CASE WHEN year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) THEN 366 ELSE 365 END')} AS epoch FROM solve_log")
def _(t):
    return t.stems.select("id", R(C.epoch_year(C.stem_time(F.col("stem")))).alias("epoch"))


_DAYS = f"(date_diff('day', DATE '2000-01-01', ts::DATE) + {_FRACTION})"


@query("f22_julian_day", f"SELECT id, {r6(_DAYS)} AS days, {r6(f'{_DAYS} - 5.5::DOUBLE / 24')} AS days_east, {r6(f'2000.0 + ({_DAYS} - 0.5) / 365.25')} AS epoch FROM solve_log")
def _(t):
    """Julian days since the year 2000 began; also of a clock five and a half hours east of
    Greenwich (F21), and the Julian epoch (F23)."""
    time, start = C.stem_time(F.col("stem")), 2451544.5
    jd = C.julian_day(time)
    return t.stems.select("id", R(jd - start).alias("days"), R(C.julian_day(time, 5.5) - start).alias("days_east"), R(C.julian_epoch(jd)).alias("epoch"))


@query("f25_calendar", "SELECT id, year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) AS leap, day(last_day(ts))::INTEGER AS month_days, (ts::DATE + 1)::VARCHAR AS next_day FROM solve_log")
def _(t):
    y = F.year("ts")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return t.solve_log.select("id", leap.alias("leap"), F.dayofmonth(F.last_day("ts")).alias("month_days"), F.date_add("ts", 1).cast("string").alias("next_day"))


@query("f26_synthetic_time", "SELECT id, strftime(make_timestamp((1700000000 + id + 1000 * (id % 3)) * 1000000), '%Y-%m-%d %H:%M:%S') AS ts FROM solve_log")
def _(t):
    """A second a record, and a thousand a split."""
    return t.solve_log.select("id", F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") + 1000 * (F.col("id") % 3)), "yyyy-MM-dd HH:mm:ss").alias("ts"))


DATES = ["2024:02:29 01:02:03", "2023:02:29 01:02:03", "2023:13:01 00:00:00", "2023:04:31 00:00:00", "2023:12:31 23:59:59", "2023:01:01 24:00:00", "junk"]


@query("p30_exif_calendar", f"SELECT id, TRY_STRPTIME(raw, '%Y:%m:%d %H:%M:%S') IS NOT NULL AS valid FROM {_from(DATES)}")
def _(t):
    """Whether there is such a day and time."""
    r = F.regexp_replace("raw", r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3 ")
    ok = F.when(r.rlike(r"^\d{4}-\d{2}-\d{2} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"), r.try_cast("timestamp_ntz").isNotNull())
    return cases(t, DATES).select("id", F.coalesce(ok, F.lit(False)).alias("valid"))


# -- numbers ---------------------------------------------------------------------------------
@query("f30_rounding", "SELECT id, round(axis * 7.3::DOUBLE * 100) / 100 + 0.0 AS two, round(axis * 7.3::DOUBLE * 10000) / 10000 + 0.0 AS four FROM eval_runs")
def _(t):
    x = F.col("axis") * 7.3
    return t.eval_runs.select("id", C.rounded(x, 2).alias("two"), C.rounded(x, 4).alias("four"))


_TURN = "((id * 37) % 2000 - 1000)::DOUBLE"


@query("f31_wraps", f"SELECT id, {r6(f'CASE WHEN {_TURN} % 360 < -180 THEN {_TURN} % 360 + 360 WHEN {_TURN} % 360 >= 180 THEN {_TURN} % 360 - 360 ELSE {_TURN} % 360 END')} AS wrapped, {r6(f'(({_TURN} - 33 + 180) % 360 + 360) % 360 - 180')} AS shortest, {r6(f'({_TURN} % 360 + 360) % 360')} AS ra FROM eval_runs")
def _(t):
    """Into -180 to 180 (F31), the shortest way (F32), into 0 to 360 (F33)."""
    a = ((F.col("id") * 37) % 2000 - 1000).cast("double")
    return t.eval_runs.select("id", R(S.wrap180(a)).alias("wrapped"), R(S.shortest(a, F.lit(33.0))).alias("shortest"), R(F.pmod(a, F.lit(360.0))).alias("ra"))


@query("f35_intensity", f"SELECT star_id, {r6('200 * pow(10::DOUBLE, -0.4::DOUBLE * (mag - 2.5::DOUBLE))')} AS intensity FROM stars")
def _(t):
    return t.stars.select("star_id", R(C.intensity(F.col("mag"), 2.5, 200.0)).alias("intensity"))


_FOV = "degrees(2 * atan(43.26661530556787::DOUBLE / (2 * (8 + id % 300) * (CASE WHEN 1 + (id % 5) * 0.5::DOUBLE > 1 THEN 1 + (id % 5) * 0.5::DOUBLE ELSE 1.0 END)) * 740 / sqrt(740.0::DOUBLE * 740 + 576.0::DOUBLE * 576)))"


@query("f37_exif_fov", f"SELECT id, CASE WHEN {_FOV} BETWEEN 3 AND 95 THEN {r6(_FOV)} END AS fov FROM eval_runs")
def _(t):
    """With the window of likely fields of view (P23)."""
    zoom = 1 + (F.col("id") % 5) * 0.5
    fov = C.exif_fov((8 + F.col("id") % 300).cast("double"), zoom, F.lit(740.0), F.lit(576.0))
    return t.eval_runs.select("id", R(fov).alias("fov"))


@query("f38_band_and_weight", f"""
SELECT id, least(floor(c * 0.75::DOUBLE), top - 1)::DOUBLE AS min_fov, top AS max_fov, {r6('10.0 - 7.5 * greatest(0.0, least(1.0, (fov - 30.0) / 40.0))')} AS weight, {r6('greatest(0.0, least(1.0, fov / 40.0))')} AS confidence
FROM (SELECT *, least(ceil(c * 1.35::DOUBLE), 90.0)::DOUBLE AS top FROM (SELECT id, 8 + (id % 870) / 10.0::DOUBLE AS fov, round(8 + (id % 870) / 10.0::DOUBLE) AS c FROM eval_runs))""")
def _(t):
    """Bounds of a dense band (F39), weight of the distortion's prior (F38), confidence (F41)."""
    fov = 8 + (F.col("id") % 870) / 10.0
    band = C.band(fov)
    return t.eval_runs.select("id", band["min_fov"].alias("min_fov"), band["max_fov"].alias("max_fov"), R(C.distortion_weight(fov)).alias("weight"), R(S.clamp(fov / 40.0, 0.0, 1.0)).alias("confidence"))


@query("f40_attempts", f"""
SELECT id, row_number() OVER (PARTITION BY id ORDER BY rung)::INTEGER AS nth, label, {r6('fov')} AS fov, {r6('fov_err')} AS fov_err FROM (
  SELECT id, rung, label, coalesce(fov, hint) AS fov, coalesce(fov_err, greatest(hint * 0.12::DOUBLE, 5)) AS fov_err
  FROM (SELECT id, CASE WHEN k % 3 <> 0 THEN fov END AS hint, k % 2 = 0 AS attitude FROM solve_log) JOIN (VALUES
    (0, 'hinted attitude', true, true, NULL::DOUBLE, NULL::DOUBLE), (1, 'hinted field', true, false, NULL, NULL), (2, 'usual field', false, false, 22.0, 5.0),
    (3, 'field 15', NULL, false, 15.0, 5.25), (4, 'field 25', NULL, false, 25.0, 8.75), (5, 'field 40', NULL, false, 40.0, 14.0), (6, 'field 60', NULL, false, 60.0, 21.0)
  ) AS r(rung, label, needs_hint, needs_attitude, fov, fov_err) ON (needs_hint IS NULL OR needs_hint = (hint IS NOT NULL)) AND (NOT needs_attitude OR attitude))""")
def _(t):
    hint = F.when(F.col("k") % 3 != 0, F.col("fov"))
    each = t.solve_log.select("id", F.posexplode(C.rungs(hint, F.col("k") % 2 == 0)).alias("nth", "a"))
    return each.select("id", (F.col("nth") + 1).alias("nth"), "a.label", R(F.col("a.fov")).alias("fov"), R(F.col("a.fov_err")).alias("fov_err"))


@query("p28_hint", "SELECT id, coalesce(CASE WHEN k % 5 = 0 THEN fov END, CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN wall_ms / 100.0::DOUBLE END) AS hint FROM solve_log")
def _(t):
    """What is given explicitly, else the picture's own if that is allowed, else none."""
    explicit, own = F.when(F.col("k") % 5 == 0, F.col("fov")), F.when(F.col("k") % 3 != 0, F.col("wall_ms") / 100.0)
    return t.solve_log.select("id", F.coalesce(explicit, F.when(F.col("k") % 2 == 0, own)).alias("hint"))


@query("w11_prefixes", "SELECT id, array_to_string(list_filter(list_distinct_sorted, lambda k: k >= 4), ',') AS prefixes FROM (SELECT id, list_sort(list_distinct(list_transform([8, 10, 12, 16, 20, 30], lambda p: least(p, n)))) AS list_distinct_sorted FROM (SELECT id, (id % 40)::INTEGER AS n FROM eval_runs))")
def _(t):
    return t.eval_runs.select("id", F.array_join(F.transform(C.prefixes((F.col("id") % 40).cast("int")), lambda k: k.cast("string")), ",").alias("prefixes"))


@query("f51_descriptor_distance", f"SELECT id, {r6('CASE WHEN n = 0 THEN -1 ELSE list_sum(list_transform(range(1, n + 1), lambda i: abs(a[i] - b[i]))) / n END')} AS distance FROM (SELECT id, least(len(a), len(b)) AS n, a, b FROM (SELECT id, list_transform(range(0, id % 4), lambda i: (i * 1.5::DOUBLE)) AS a, list_transform(range(0, id % 6), lambda i: (i * 1.25::DOUBLE + id % 3)) AS b FROM eval_runs))")
def _(t):
    """-1 here where the arrays share no place."""
    upto = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < n), f)
    a, b = upto(F.col("id") % 4, lambda i: i * 1.5), upto(F.col("id") % 6, lambda i: i * 1.25 + F.col("id") % 3)
    d = matching.descriptor_distance(a, b)
    return t.eval_runs.select("id", R(F.when(d < 1e300, d).otherwise(-1.0)).alias("distance"))


@query("f54_skip_nulls", """SELECT id, '{"id":' || id || CASE WHEN roll_err IS NOT NULL THEN ',"ok":true' ELSE '' END || CASE WHEN status = 'failed' THEN ',"code":"' || code || '"' ELSE '' END || '}' AS json FROM eval_runs""")
def _(t):
    """Missing values are left out."""
    s = F.struct("id", F.when(F.col("roll_err").isNotNull(), True).alias("ok"), F.when(F.col("status") == "failed", F.col("code")).alias("code"))
    return t.eval_runs.select("id", F.to_json(s).alias("json"))


WRAPPED = ['{"calibration": {"ra": 5.5}}', '{"ra": 7.25}', '{"calibration": null, "ra": 1}', '{"other": 2}']


@query("f55_unwrap", f"""SELECT id, CASE WHEN raw LIKE '%"calibration": null%' THEN NULL ELSE coalesce(CAST(json_extract(raw, '$.calibration.ra') AS DOUBLE), CAST(json_extract(raw, '$.ra') AS DOUBLE)) END AS ra FROM {_from(WRAPPED)}""")
def _(t):
    """A wrapped object or a bare one; an explicit null in the wrapper is not a bare object."""
    raw = F.col("raw")
    explicit = raw.rlike(r'"calibration"\s*:\s*null')
    ra = F.coalesce(F.get_json_object(raw, "$.calibration.ra"), F.get_json_object(raw, "$.ra")).cast("double")
    return cases(t, WRAPPED).select("id", F.when(~explicit, ra).alias("ra"))


@query("f61_quantize", "SELECT star_id, least(255, greatest(0, mag * 40.7::DOUBLE - 20))::INTEGER - CASE WHEN least(255, greatest(0, mag * 40.7::DOUBLE - 20))::INTEGER > least(255, greatest(0, mag * 40.7::DOUBLE - 20)) THEN 1 ELSE 0 END AS v FROM stars")
def _(t):
    return t.stars.select("star_id", C.quantize(F.col("mag") * 40.7 - 20, 1.0).alias("v"))
