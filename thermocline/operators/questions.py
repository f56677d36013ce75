"""Ready queries for the sample questions that have no fixed template."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import predicates as p
from ..functions.columns import month_of, n_rows
from .analytics import avg, mean_of, partial_sums, total_rows
from .order import extreme_rows
from .quality import iqr_fences
from .quantiles import quantiles


def deepest_per_float(m: DataFrame) -> DataFrame:
    """The deepest measurement of each float; among equals the smallest id."""
    return extreme_rows(m.select("float_id", "depth", "id", "time", "temperature", "salinity"), ["float_id"], "depth", F.col("id").asc())


# The next four take measurements, or readings and their profiles: then readings are summed per profile first.
AVERAGED = ("temperature", "salinity")


def hemisphere_comparison(m: DataFrame, casts: DataFrame | None = None) -> DataFrame:
    side = F.when(F.col("lat") >= 0, "Northern").otherwise("Southern")
    return partial_sums(m, AVERAGED, casts).filter(F.col("lat").isNotNull()).groupBy(side.alias("hemisphere")).agg(
        mean_of("salinity"), mean_of("temperature"), total_rows())


def latitude_bands(m: DataFrame, casts: DataFrame | None = None, width: int = 10) -> DataFrame:
    band = (F.floor(F.col("lat") / width) * width).cast("int")
    return partial_sums(m, AVERAGED, casts).filter(F.col("lat").isNotNull()).groupBy(band.alias("band_south")).agg(
        mean_of("temperature"), mean_of("salinity"), total_rows())


def count_by_month(m: DataFrame, casts: DataFrame | None = None) -> DataFrame:
    return partial_sums(m, (), casts).groupBy(month_of(F.col("time")).alias("month")).agg(total_rows())


def seasonal_variation(m: DataFrame, casts: DataFrame | None = None) -> DataFrame:
    return partial_sums(m, AVERAGED, casts).groupBy(
        F.quarter("time").alias("quarter"), F.month("time").alias("month_of_year")).agg(
        mean_of("temperature"), mean_of("salinity"), total_rows())


def deployments_over_time(profiles: DataFrame) -> DataFrame:
    first = profiles.groupBy("float_id").agg(F.min("profile_date").alias("first_profile"))
    return first.groupBy(month_of(F.col("first_profile")).alias("month")).agg(n_rows().alias("deployments"))


def busiest_floats(profiles: DataFrame, m: DataFrame, top: int = 10) -> DataFrame:
    per_profile = m.groupBy("profile_id").agg(n_rows().alias("n"))
    return (
        profiles.select("profile_id", "float_id").join(per_profile, "profile_id")
        .groupBy("float_id").agg(F.sum("n").alias("measurement_count"))
        .orderBy(F.desc("measurement_count"), "float_id").limit(top)
    )


def float_duration(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("float_id").agg(
        F.min("profile_date").alias("first_profile"), F.max("profile_date").alias("last_profile"),
        F.datediff(F.max("profile_date"), F.min("profile_date")).alias("days"),
    )


def oxygen_below(m: DataFrame, depth: float = 500.0) -> DataFrame:
    return m.filter((F.col("depth") > depth) & F.col("oxygen").isNotNull()).agg(
        avg("oxygen"), F.min("oxygen").alias("min_oxygen"), F.max("oxygen").alias("max_oxygen"),
        n_rows().alias("measurement_count"),
    )


def surface_vs_deep(m: DataFrame, surface: float = 50.0, deep: float = 500.0) -> DataFrame:
    layer = F.when(F.col("depth") <= surface, "surface").when(F.col("depth") >= deep, "deep")
    return m.withColumn("layer", layer).filter(F.col("layer").isNotNull()).groupBy("layer").agg(
        avg("temperature"), avg("oxygen"), avg("ph"), avg("chlorophyll"), n_rows().alias("measurement_count")
    )


def ph_by_depth(m: DataFrame, width: int = 100) -> DataFrame:
    low = (F.floor(F.col("depth") / width) * width).cast("int")
    return m.filter(F.col("ph").isNotNull()).groupBy(low.alias("depth_from")).agg(
        avg("ph"), F.min("ph").alias("min_ph"), F.max("ph").alias("max_ph"), n_rows().alias("measurement_count")
    )


def chlorophyll_by_zone(m: DataFrame) -> DataFrame:
    zoned = m.filter(F.col("chlorophyll").isNotNull()).select(
        labels.ocean_zone(F.col("depth")).alias("ocean_zone"), "chlorophyll"
    )
    stats = zoned.groupBy("ocean_zone").agg(
        n_rows().alias("measurement_count"), avg("chlorophyll"),
        F.min("chlorophyll").alias("min_chlorophyll"), F.max("chlorophyll").alias("max_chlorophyll"),
    )
    q = quantiles(zoned, ["chlorophyll"], (0.25, 0.5, 0.75), ("q25", "median", "q75"), by=["ocean_zone"])
    return stats.join(q.drop("parameter"), "ocean_zone")


def temp_sal_correlation(m: DataFrame) -> DataFrame:
    both = m.filter(F.col("temperature").isNotNull() & F.col("salinity").isNotNull())
    return both.agg(F.corr("temperature", "salinity").alias("correlation"), n_rows().alias("measurement_count"))


def outlying_rows(m: DataFrame, column: str = "temperature") -> DataFrame:
    """Rows outside the quartile fences; the fences are two numbers, so they become literals of a plain filter."""
    fence = iqr_fences(m, [column]).first()
    if fence is None:
        return m.limit(0)
    value = F.col(column)
    return m.filter((value < fence["lower_bound"]) | (value > fence["upper_bound"]))


def depth_histogram(m: DataFrame, width: int = 100) -> DataFrame:
    low = (F.floor(F.col("depth") / width) * width).cast("int")
    return m.filter(F.col("depth").isNotNull()).groupBy(low.alias("depth_from")).agg(n_rows().alias("measurement_count"))


def missing_patterns(m: DataFrame, columns=("temperature", "salinity", "oxygen", "ph", "chlorophyll")) -> DataFrame:
    """Rows per combination of missing columns, written as the missing names joined by commas."""
    gaps = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in columns))
    return m.groupBy(gaps.alias("missing")).agg(n_rows().alias("measurement_count"))


def floats_in_region(m: DataFrame, region: str = "Arabian Sea") -> DataFrame:
    return m.filter(p.in_region(F.col("lat"), F.col("lon"), region)).groupBy("float_id").agg(
        n_rows().alias("measurement_count"), F.max("time").alias("last_seen")
    )


def near_equator(m: DataFrame, degrees: float = 5.0) -> DataFrame:
    return m.filter(F.col("lat").between(-degrees, degrees)).groupBy("float_id").agg(
        n_rows().alias("measurement_count"), F.max("time").alias("last_seen")
    )


def equator_month_profiles(profiles: DataFrame, year: int, month: int, degrees: float = 5.0) -> DataFrame:
    first = dt.date(year, month, 1)
    last = (first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
    return profiles.filter(
        p.within_dates(F.col("profile_date"), first, last) & F.col("profile_lat").between(-degrees, degrees)
    ).select("profile_id", "float_id", "profile_date", "profile_lat", "profile_lon")


def avg_temp_at_depth(m: DataFrame, depth: float = 500.0, tolerance: float = 25.0) -> DataFrame:
    near = F.col("depth").between(depth - tolerance, depth + tolerance) & F.col("temperature").isNotNull()
    return m.filter(near).agg(avg("temperature"), n_rows().alias("measurement_count"))


def warmest_surface(m: DataFrame, surface: float = 50.0, top: int = 20) -> DataFrame:
    return (
        m.filter((F.col("depth") <= surface) & F.col("temperature").isNotNull())
        .select("id", "float_id", "time", "lat", "lon", "depth", "temperature")
        .orderBy(F.desc("temperature"), "id").limit(top)
    )


def high_chlorophyll_cells(m: DataFrame, cell: float = 1.0, top: int = 20) -> DataFrame:
    lat, lon = ((F.floor(F.col(c) / cell) * cell).alias(f"{c}_cell") for c in ("lat", "lon"))
    return (
        m.filter(F.col("chlorophyll").isNotNull() & p.valid_place(F.col("lat"), F.col("lon")))
        .groupBy(lat, lon).agg(avg("chlorophyll"), n_rows().alias("measurement_count"))
        .orderBy(F.desc(F.round("avg_chlorophyll", 9)), "lat_cell", "lon_cell").limit(top)
    )


def region_coverage(m: DataFrame, casts: DataFrame | None = None, cell: float = 5.0) -> DataFrame:
    """Per named region: grid cells with data, all cells, and the share covered.

    Rows shrink to one per occupied cell and region before cells are counted.
    """
    from .filters import in_named_regions

    lat, lon = (F.floor(F.col(c) / cell).alias(f"{c}_cell") for c in ("lat", "lon"))
    placed = partial_sums(m, (), casts).select("lat", "lon", "n")
    tagged = in_named_regions(placed).groupBy("region", lat, lon).agg(F.sum("n").cast("long").alias("n"))
    sizes = [
        (name, int((n // cell) - (s // cell) + 1) * int((e // cell) - (w // cell) + 1))
        for name, (n, s, e, w) in labels.REGIONS.items()
    ]
    cells = m.sparkSession.createDataFrame(sizes, "region string, cells bigint")  # five rows
    covered = tagged.groupBy("region").agg(n_rows().alias("occupied_cells"), F.sum("n").alias("measurement_count"))
    return covered.join(F.broadcast(cells), "region").withColumn(
        "coverage", F.col("occupied_cells") / F.col("cells")
    )


def recent_region_bgc(m: DataFrame, region: str, as_of: dt.datetime, days: int = 180) -> DataFrame:
    recent = p.since_days(F.col("time"), as_of, days) & p.in_region(F.col("lat"), F.col("lon"), region)
    return m.filter(recent).agg(
        avg("oxygen"), avg("ph"), avg("chlorophyll"), n_rows().alias("measurement_count")
    )


def salinity_depth_ranges(m: DataFrame) -> DataFrame:
    return m.filter(F.col("salinity").isNotNull()).groupBy(
        labels.depth_band(F.col("depth")).alias("depth_range")
    ).agg(avg("salinity"), F.min("salinity").alias("min_salinity"), F.max("salinity").alias("max_salinity"),
          n_rows().alias("measurement_count"))
