"""Star catalogs from CSV files, gzipped or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as C


def _named(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, their names trimmed and in lower case, without a byte order mark."""
    raw = spark.read.csv(path, header=True)
    return raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])


def _first(df: DataFrame, names: tuple[str, ...], path: str) -> str:
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise ValueError(f"{path}: no column {' or '.join(names)}")
    return found


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _checked(value: Column, kind: str, message: str) -> Column:
    """value as a number; a text that is none ends the job."""
    return F.coalesce(value.try_cast(kind), F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(value, F.lit("null")))).cast(kind))


def star_catalog(spark: SparkSession, path: str, ra_unit: str = "hours") -> DataFrame:
    """star_id, hip, proper, ra_deg, dec_deg, mag, con, pm_ra, pm_dec (radians a year).

    id, ra, dec and mag must be columns. A row with id 0, or without a readable magnitude or
    place, is skipped; an id that is no number ends the job. Radians, where a row has both, go
    before ra (in ra_unit: hours or degrees) and dec. Nothing is sorted; sort where it counts."""
    df = _named(spark, path)
    for name in ("id", "ra", "dec", "mag"):
        _first(df, (name,), path)
    number = lambda n: C.number(_optional(df, n))
    radians = number("rarad").isNotNull() & number("decrad").isNotNull()
    scale = {"hours": 15.0, "degrees": 1.0}[ra_unit]
    ra = F.when(radians, F.degrees(number("rarad"))).otherwise(number("ra") * scale)
    dec = F.when(radians, F.degrees(number("decrad"))).otherwise(number("dec"))
    out = df.select(
        _checked(F.trim("id"), "long", f"{path}: bad id").alias("star_id"),
        C.number(_optional(df, "hip")).cast("long").alias("hip"),
        C.field(_optional(df, "proper")).alias("proper"),
        F.when(ra.isNotNull() & dec.isNotNull(), ra).alias("ra_deg"),
        dec.alias("dec_deg"),
        number("mag").alias("mag"),
        C.field(_optional(df, "con")).alias("con"),
        F.coalesce(number("pmrarad"), F.lit(0.0)).alias("pm_ra"),
        F.coalesce(number("pmdecrad"), F.lit(0.0)).alias("pm_dec"),
    )
    return out.where("star_id <> 0 and mag is not null and ra_deg is not null")


def simple_catalog(spark: SparkSession, path: str) -> DataFrame:
    """star_id (text), ra_deg, dec_deg, mag of the short layout, where places are degrees unless
    there are radians. Other names of the columns are known; a row without an id is skipped, and
    any other text that is no number ends the job."""
    df = _named(spark, path)
    own = C.field(F.col(_first(df, ("id", "star_id", "hip"), path)))
    star = F.coalesce(own, C.field(_optional(df, "hip")))
    number = lambda *names: _checked(F.trim(_first(df, names, path)), "double", f"{path}: bad {names[0]}")
    ra = F.degrees(number("rarad")) if "rarad" in df.columns else number("ra", "ra_deg")
    dec = F.degrees(number("decrad")) if {"rarad", "decrad"} <= set(df.columns) else number("dec", "dec_deg")
    kept = df.withColumn("star_id_", star).where("star_id_ is not null")
    return kept.select(F.col("star_id_").alias("star_id"), ra.alias("ra_deg"), dec.alias("dec_deg"), number("mag", "mag_v").alias("mag"))
