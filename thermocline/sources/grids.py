"""Gridded fields turned into virtual floats, profiles and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import n_rows, nan_to_null
from ..operators.order import with_rank
from ..session import durable
from .profiles import FLOAT_PREFIX

# --- fixed values -----------------------------------------------------------------------------------------
AXES = {"TAXIS": "time", "ZAX": "depth", "YAXIS": "lat", "XAXIS": "lon"}
VARIABLES = {
    "TEMP": "temperature",
    "SAL": "salinity",
    "OXYGEN": "oxygen",
    "CHLOROPHYLL": "chlorophyll",
    "PH": "ph",
    "NITRATE": "nitrate",
}
TIME_STEPS, EAST, NORTH = 60, (50.0, 120.0), (-30.0, 30.0)
PRESSURE_PER_METRE = 1.025
FIRST_WMO = 5_900_000
CHEMISTRY = ("oxygen", "ph", "chlorophyll", "nitrate")
# ----------------------------------------------------------------------------------------------------------


def grid_subset(df: DataFrame, steps: int = TIME_STEPS, lon=EAST, lat=NORTH) -> DataFrame:
    """The first time steps within the box.

    The last wanted time is one value found among the distinct times, so the rows are cut by a plain comparison.
    """
    last = df.select("time").filter(F.col("time").isNotNull()).distinct().orderBy("time").limit(steps).agg(
        F.max("time")
    ).first()[0]
    if last is None:
        return df.limit(0)
    bound = F.lit(last).cast(df.schema["time"].dataType)
    return df.filter((F.col("time") <= bound) & F.col("lon").between(*lon) & F.col("lat").between(*lat))


def rename_axes(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({**AXES, **VARIABLES})


def grid_to_rows(slabs: DataFrame) -> DataFrame:
    """Cells of nested arrays as rows.

    A slab is one time step: TAXIS, coordinate vectors ZAX, YAXIS, XAXIS and per variable an array over depth,
    latitude, longitude.  All variables are zipped level by level, so the arrays are walked once.
    """
    names = [v for v in VARIABLES if v in slabs.columns]

    def step(frame: DataFrame, axis: str, value: str) -> DataFrame:
        others = [c for c in frame.columns if c not in (axis, "_v", *names)]
        source = [F.col(n) for n in names] if "_v" not in frame.columns else [F.col(f"_v.{n}").alias(n) for n in names]
        walked = frame.select(*others, F.inline(F.arrays_zip(F.col(axis).alias(value), *source)))
        return walked

    planes = step(slabs, "ZAX", "depth")
    rows = step(planes, "YAXIS", "lat")
    cells = step(rows, "XAXIS", "lon")
    return cells.select(
        F.col("TAXIS").alias("time"), "depth", "lat", "lon",
        *(nan_to_null(F.col(n).cast("double")).alias(VARIABLES[n]) for n in names),
    )


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def placed(readings: DataFrame, casts: DataFrame) -> DataFrame:
    """Places and times with their number of readings: counted per profile before these meet, and kept, as it is a small
    part of the readings and read several times."""
    counts = readings.groupBy("profile_id").agg(n_rows().alias("n"))
    both = casts.select("profile_id", F.col("profile_lat").alias("lat"), F.col("profile_lon").alias("lon"), F.col("profile_date").alias("time")).join(counts, "profile_id")
    return durable(both.groupBy("lat", "lon", "time").agg(F.sum("n").cast("long").alias("n_levels")))


def virtual_floats(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Each distinct place, in latitude and longitude order, is a float.

    The rows are aggregated to places first; only those are numbered.  ``limit`` keeps the first so many.
    """
    places = df.groupBy("lat", "lon").agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    ranked = with_rank(places, ["lat", "lon"], "_n").withColumn("_n", F.col("_n") + 1)
    if limit is not None:
        ranked = ranked.filter(F.col("_n") <= limit)
    number = F.when(F.col("_n") < 10_000, F.lpad(F.col("_n").cast("string"), 4, "0")).otherwise(
        F.col("_n").cast("string"))
    return ranked.select(
        F.concat(F.lit(FLOAT_PREFIX), number).alias("float_id"), (F.col("_n") + FIRST_WMO).alias("wmo_id"),
        F.to_date("_a").alias("deployment_date"), F.col("lat").alias("deployment_lat"),
        F.col("lon").alias("deployment_lon"), F.lit("ACTIVE").alias("status"), F.to_date("_b").alias("last_contact"),
    )


def virtual_profiles(df: DataFrame, floats: DataFrame) -> DataFrame:
    """Each distinct time of a float is a profile; ids run over all floats, cycles within one.

    ``df`` has rows of a place and time, or of ``placed``, which are counted already.  Rows are aggregated to (place, time) first.  Ranges of that table are numbered, so a place with very many times
    is spread over several tasks; the cycle is the distance from the place's first number.
    """
    own = floats.select("float_id", F.col("deployment_lat").alias("lat"), F.col("deployment_lon").alias("lon"))
    levels = F.sum("n_levels").cast("long") if "n_levels" in df.columns else n_rows()
    casts = df.groupBy("lat", "lon", "time").agg(levels.alias("n_levels")).join(own, ["lat", "lon"])
    ranked = with_rank(casts, ["lat", "lon", "time"], "_n").withColumn("profile_id", F.col("_n") + 1)
    first = ranked.groupBy("float_id").agg(F.min("profile_id").alias("_first"))
    return ranked.join(first, "float_id").select(
        "profile_id", "float_id", (F.col("profile_id") - F.col("_first") + 1).alias("cycle_number"),
        F.col("time").alias("profile_date"), F.col("lat").alias("profile_lat"), F.col("lon").alias("profile_lon"),
        "n_levels",
    )


def virtual_measurements(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """The rows with their profile and float keys and pressure; chemistry the source lacks is null."""
    keys = profiles.select("profile_id", "float_id", F.col("profile_lat").alias("lat"),
                           F.col("profile_lon").alias("lon"), F.col("profile_date").alias("time"))
    chemistry = [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in CHEMISTRY]
    return df.join(keys, ["lat", "lon", "time"]).select(
        "profile_id", "float_id", "time", "lat", "lon", "depth",
        (F.col("depth") * PRESSURE_PER_METRE).alias("pressure"), "temperature", "salinity", *chemistry,
    )
