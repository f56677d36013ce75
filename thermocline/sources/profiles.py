"""Profile files as rows with arrays, turned into float, profile and measurement tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import n_rows, nan_to_null, packed_order

# --- fixed values: variable names of the profile files, with what stands in when the first is absent -------
LEVEL_VARIABLES = {
    "pressure": ("PRES",),
    "temperature": ("TEMP",),
    "salinity": ("PSAL",),
    "oxygen": ("DOXY",),
    "ph": ("PH_IN_SITU_TOTAL", "PH_IN_SITU_TOTAL_ADJUSTED"),
    "chlorophyll": ("CHLA", "CHLA_ADJUSTED"),
    "nitrate": ("NITRATE", "NITRATE_ADJUSTED"),
}
NEVER_MEASURED = ("backscatter", "cdom", "downwelling_par")
NEEDED = ("pressure", "temperature", "salinity")
FLOAT_PREFIX = "ARGO_"
UNKNOWN = "UNKNOWN"
# ----------------------------------------------------------------------------------------------------------


def clean_platform(raw: Column) -> Column:
    """Platform text without quotes and byte marks; nothing left means unknown.

    Trimming comes before the marks are taken out, so blanks inside the quotes stay.
    """
    text = F.translate(F.trim(raw), "'b", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(UNKNOWN))


def platform_float_id(platform: Column) -> Column:
    return F.concat(F.lit(FLOAT_PREFIX), platform)


def platform_wmo(platform: Column) -> Column:
    """The digits of the platform number, null without any."""
    return F.regexp_replace(platform, "[^0-9]", "").try_cast("bigint")


def with_platform(df: DataFrame, raw: str = "platform") -> DataFrame:
    clean = df.withColumn("platform_number", clean_platform(F.col(raw)))
    return clean.withColumns({
        "float_id": platform_float_id(F.col("platform_number")), "wmo_id": platform_wmo(F.col("platform_number")),
    })


def _source_column(columns, names) -> str | None:
    lower = {c.lower(): c for c in columns}
    return next((lower[n.lower()] for n in names if n.lower() in lower), None)


def level_columns(columns) -> dict[str, str | None]:
    """Which input column feeds each variable; the stand-in is chosen by presence, not value by value."""
    return {name: _source_column(columns, (*options, name)) for name, options in LEVEL_VARIABLES.items()}


def explode_profiles(profiles: DataFrame, carried=("profile_id", "float_id", "time", "lat", "lon")) -> DataFrame:
    """One row per level with pressure, temperature and salinity; depth is the pressure; absent variables are null.

    Levels are taken out of the arrays inside the scan stage: no shuffle, and no profile is gathered anywhere.
    """
    sources = level_columns(profiles.columns)
    if any(sources[name] is None for name in NEEDED):
        empty = profiles.limit(0).select(*carried, F.lit(0).alias("level"))
        return empty.select("*", *(F.lit(None).cast("double").alias(n)
                                   for n in ("depth", *LEVEL_VARIABLES, *NEVER_MEASURED)))
    kept = {name: column for name, column in sources.items() if column is not None}
    # a profile without one of the variables has no array for it; an empty one keeps the levels of the others
    zipped = F.arrays_zip(*(
        F.coalesce(F.col(column), F.array().cast(profiles.schema[column].dataType)).alias(name)
        for name, column in kept.items()
    ))
    rows = profiles.select(*carried, F.posexplode(zipped).alias("level", "_v"))

    def value(name: str) -> Column:
        found = nan_to_null(F.col(f"_v.{name}").cast("double")) if name in kept else F.lit(None).cast("double")
        return found.alias(name)

    values = rows.select(*carried, "level", *(value(n) for n in LEVEL_VARIABLES))
    present = F.col("pressure").isNotNull() & F.col("temperature").isNotNull() & F.col("salinity").isNotNull()
    return values.filter(present).select(
        *carried, "level", F.col("pressure").alias("depth"), *LEVEL_VARIABLES,
        *(F.lit(None).cast("double").alias(n) for n in NEVER_MEASURED),
    )


def profile_level_counts(profiles: DataFrame, key: str = "profile_id") -> DataFrame:
    """Valid levels per profile, counted inside the array."""
    pressure = _source_column(profiles.columns, (*LEVEL_VARIABLES["pressure"], "pressure"))
    if pressure is None:
        return profiles.select(key, F.lit(0).alias("n_levels"))
    there = lambda x: x.isNotNull() & ~F.isnan(x)
    return profiles.select(key, F.coalesce(F.size(F.filter(pressure, there)), F.lit(0)).alias("n_levels"))


def float_dimension(profiles: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per float: the first profile of the last file gives date and place.

    ``profiles`` has float_id, wmo_id, file_seq (of any type that can be ordered), profile_seq, time, lat, lon.  A
    missing time becomes ``as_of``.
    """
    day = F.coalesce(F.to_date("time"), F.lit(as_of.isoformat()).cast("date"))
    whole = profiles.schema["file_seq"].dataType.typeName() in ("byte", "short", "integer", "long")
    # numbers make a key of fixed width, over which the aggregate hashes; file names are compared as they are
    place = (packed_order(F.col("file_seq").cast("bigint"), -F.col("profile_seq")) if whole
             else F.struct(F.col("file_seq"), -F.col("profile_seq")))
    last = lambda value: F.max_by(value, "_place")
    return profiles.select("float_id", "wmo_id", day.alias("_day"), "lat", "lon", place.alias("_place")).groupBy("float_id").agg(
        last("wmo_id").alias("wmo_id"), last("_day").alias("deployment_date"), last("lat").alias("deployment_lat"),
        last("lon").alias("deployment_lon"),
    ).select("*", F.lit("ACTIVE").alias("status"), F.col("deployment_date").alias("last_contact"))


def merge_floats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Floats after a load: a new row replaces the old one of the same float."""
    return old.join(new.select("float_id"), "float_id", "left_anti").unionByName(new)


def rejected(profiles: DataFrame, path: str = "path") -> DataFrame:
    """Profiles that cannot be used, with the reason, instead of a message on the console."""
    sources = level_columns(profiles.columns)
    absent = [n for n in NEEDED if sources[n] is None]
    reason = F.lit(f"no {', '.join(absent)}") if absent else F.when(
        F.col(sources["pressure"]).isNull(), "no levels")
    return profiles.select(F.col(path), reason.alias("reason")).filter(F.col("reason").isNotNull())


def bgc_presence(df: DataFrame) -> DataFrame:
    """Whether all four chemistry columns exist and oxygen has a value."""
    if not {"oxygen", "ph", "chlorophyll", "nitrate"} <= set(df.columns):
        return df.agg(n_rows().alias("n")).select(F.lit(False).alias("has_bgc"))
    return df.agg(F.coalesce(F.bool_or(F.col("oxygen").isNotNull()), F.lit(False)).alias("has_bgc"))


def profile_tables(raw: DataFrame, as_of: dt.date, first_id: int = 1) -> dict[str, DataFrame]:
    """floats, profiles, measurements and rejects from rows that hold one profile each.

    ``raw`` has file_seq, profile_seq, platform, cycle, juld, latitude, longitude and the level arrays.  Profile ids
    run on from ``first_id`` in file and profile order.
    """
    from ..operators.order import with_rank

    named = with_platform(raw).withColumnsRenamed({"juld": "time", "latitude": "lat", "longitude": "lon"})
    ranked = with_rank(named, ["file_seq", "profile_seq"], "_n")
    numbered = ranked.withColumn("profile_id", F.col("_n") + first_id)
    levels = profile_level_counts(numbered)
    cycle = F.coalesce(F.col("cycle"), F.col("profile_seq")).cast("int")
    profiles = numbered.select(
        "profile_id", "float_id", cycle.alias("cycle_number"), F.col("time").alias("profile_date"),
        F.col("lat").alias("profile_lat"), F.col("lon").alias("profile_lon"),
    ).join(levels, "profile_id")
    return {
        "floats": float_dimension(numbered, as_of),
        "profiles": profiles,
        "measurements": explode_profiles(numbered),
        "rejects": rejected(numbered.withColumn("path", F.col("file_seq").cast("string"))),
    }
