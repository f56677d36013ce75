"""Lookups that bring measurements, profiles and floats together.

All are equi joins without hints: the optimizer broadcasts a side it knows to be small, otherwise it sorts and
merges, and adaptive execution splits a hot profile or float.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_by_ids(measurements: DataFrame, ids: DataFrame) -> DataFrame:
    """Measurements whose id is listed; the list is a table, so it may be long."""
    return measurements.join(ids.select("id").distinct(), "id", "left_semi")


def placed_readings(readings: DataFrame, casts: DataFrame) -> DataFrame:
    """Readings with the float, time and place of their profile: measurements.

    For a choice of readings or profiles that is made before the big tables meet.
    """
    places = casts.select("profile_id", "float_id", F.col("profile_date").alias("time"), F.col("profile_lat").alias("lat"),
                          F.col("profile_lon").alias("lon"))
    return readings.join(places, "profile_id")


def profiles_by_ids(measurements: DataFrame, profiles: DataFrame, floats: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed measurements with cycle number and WMO number, in float, cycle, depth order.

    The id list cuts the measurements down first; only what is left is joined.
    """
    return with_numbers(rows_by_ids(measurements, ids), profiles, floats)


def with_numbers(measurements: DataFrame, profiles: DataFrame, floats: DataFrame) -> DataFrame:
    """Measurements with cycle number and WMO number, in float, cycle, depth order."""
    return (
        measurements.join(profiles.select("profile_id", "cycle_number"), "profile_id")
        .join(floats.select("float_id", "wmo_id"), "float_id")
        .select("id", "time", "lat", "lon", "depth", "temperature", "salinity", "oxygen", "ph", "chlorophyll",
                "float_id", "profile_id", "cycle_number", "wmo_id")
        .orderBy("float_id", "cycle_number", "depth", "id")
    )


def float_summary(floats: DataFrame, profiles: DataFrame, measurements: DataFrame, top: int | None = 50) -> DataFrame:
    """Per float: profiles, measurements with a temperature, averages and depth span; the busiest first.

    Measurements are summed per profile before they meet the other tables, so the big table crosses the
    network once, already aggregated, and a float with very many profiles arrives as partial sums.
    """
    per_profile = (
        measurements.filter(F.col("temperature").isNotNull())
        .groupBy("profile_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("temperature").alias("t_sum"),
            F.sum("salinity").alias("s_sum"),
            F.count("salinity").alias("s_n"),
            F.min("depth").alias("shallow"),
            F.max("depth").alias("deep"),
        )
    )
    per_float = (
        per_profile.join(profiles.select("profile_id", "float_id"), "profile_id")
        .groupBy("float_id")
        .agg(
            F.count(F.lit(1)).alias("total_profiles"),
            F.sum("n").alias("total_measurements"),
            (F.sum("t_sum") / F.sum("n")).alias("avg_temperature"),
            F.try_divide(F.sum("s_sum"), F.sum("s_n")).alias("avg_salinity"),
            F.min("shallow").alias("min_depth"),
            F.max("deep").alias("max_depth"),
        )
    )
    joined = per_float.join(floats.select("float_id", "wmo_id", "deployment_date"), "float_id").select(
        "float_id", "wmo_id", "deployment_date", "total_profiles", "total_measurements", "avg_temperature",
        "avg_salinity", "min_depth", "max_depth",
    )
    ordered = joined.orderBy(F.desc("total_measurements"), "float_id")
    return ordered.limit(top) if top else ordered


def measurement_context(measurements: DataFrame, profiles: DataFrame, floats: DataFrame) -> DataFrame:
    """Every measurement with its profile and float fields: the input of the text documents."""
    return (
        measurements.select("id", "profile_id", "float_id", "time", "lat", "lon", "depth", "temperature", "salinity",
                            "oxygen", "ph", "chlorophyll")
        .join(profiles.select("profile_id", "cycle_number", "profile_date", "n_levels"), "profile_id")
        .join(floats.select("float_id", "wmo_id", "deployment_date"), "float_id")
    )


def readings_context(readings: DataFrame, profiles: DataFrame, floats: DataFrame) -> DataFrame:
    """The same from readings that carry no place or time of their own: these come with the profile.

    Profiles get their float's fields first, so the big table is joined once.
    """
    told = profiles.select("profile_id", "float_id", F.col("profile_date").alias("time"), F.col("profile_lat").alias("lat"),
                           F.col("profile_lon").alias("lon"), "cycle_number", "profile_date", "n_levels").join(
        floats.select("float_id", "wmo_id", "deployment_date"), "float_id")
    return readings.select("id", "profile_id", "depth", "temperature", "salinity", "oxygen", "ph", "chlorophyll").join(told, "profile_id")


def profile_summary(profiles: DataFrame, floats: DataFrame, measurements: DataFrame) -> DataFrame:
    """One row per profile with ranges and averages of its measurements.

    The aggregate runs on the profile key alone; the descriptive columns are joined on afterwards.
    """
    stats = measurements.groupBy("profile_id").agg(
        F.avg("temperature").alias("avg_temp"),
        F.min("temperature").alias("min_temp"),
        F.max("temperature").alias("max_temp"),
        F.avg("salinity").alias("avg_sal"),
        F.min("salinity").alias("min_sal"),
        F.max("salinity").alias("max_sal"),
        F.min("depth").alias("min_depth"),
        F.max("depth").alias("max_depth"),
        F.avg("oxygen").alias("avg_oxygen"),
        F.avg("ph").alias("avg_ph"),
        F.avg("chlorophyll").alias("avg_chlorophyll"),
    )
    return profiles.select(
        "profile_id", "float_id", "cycle_number", "profile_date", "profile_lat", "profile_lon", "n_levels"
    ).join(stats, "profile_id").join(floats.select("float_id", "wmo_id"), "float_id")


def profile_measurement_counts(profiles: DataFrame, measurements: DataFrame, top: int = 10) -> DataFrame:
    """The earliest float cycles with measurement count and averages, summed per profile before the join."""
    per_profile = measurements.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("temperature").alias("t_sum"),
        F.count("temperature").alias("t_n"),
        F.sum("salinity").alias("s_sum"),
        F.count("salinity").alias("s_n"),
    )
    return (
        profiles.select("profile_id", "float_id", "cycle_number", "profile_date")
        .join(per_profile, "profile_id")
        .groupBy("float_id", "cycle_number", "profile_date")
        .agg(
            F.sum("n").alias("measurement_count"),
            F.try_divide(F.sum("t_sum"), F.sum("t_n")).alias("avg_temp"),
            F.try_divide(F.sum("s_sum"), F.sum("s_n")).alias("avg_salinity"),
        )
        .orderBy("profile_date", "float_id", "cycle_number")
        .limit(top)
    )


def float_profiles(profiles: DataFrame, float_id) -> DataFrame:
    """All profiles of one float, oldest first."""
    return profiles.filter(F.col("float_id") == float_id).orderBy("profile_date", "profile_id")
