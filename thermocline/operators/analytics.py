"""The fixed analytical questions: by depth, region, band, month, float, zone; totals and parameter statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels
from ..functions.columns import month_of, n_rows
from .quantiles import quantiles

QUALITY_SHARE = 95.0  # fixed value reported with the system totals
NOT_PARAMETERS = ("latitude", "longitude", "depth", "profile_id", "float_id")
SUMMARY_COLUMNS = ("temperature", "salinity", "depth", "oxygen", "ph")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def parameter_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither coordinates nor ids."""
    return [c for c in numeric_columns(df) if c not in NOT_PARAMETERS]


def avg(name: str) -> Column:
    return F.avg(name).alias(f"avg_{name}")


def partial_sums(m: DataFrame, columns, casts: DataFrame | None = None, by=()) -> DataFrame:
    """Rows with n, sum_* and count_* of the columns and min_depth, max_depth, beside place, time and ``by``.

    With ``casts`` the rows of ``m`` are readings without place and time: they are summed per profile (and ``by``) before
    they meet the profiles, so one row per profile is joined instead of every reading.  Without, every row stands for
    itself.
    """
    depth = [F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth")]
    if casts is None:
        return m.select("*", F.lit(1).alias("n"), F.col("depth").alias("min_depth"), F.col("depth").alias("max_depth"),
                        *(F.col(c).alias(f"sum_{c}") for c in columns),
                        *(F.col(c).isNotNull().cast("long").alias(f"count_{c}") for c in columns))
    sums = m.groupBy("profile_id", *by).agg(n_rows().alias("n"), *depth, *(F.sum(c).alias(f"sum_{c}") for c in columns),
                                            *(F.count(c).alias(f"count_{c}") for c in columns))
    places = casts.select("profile_id", "float_id", F.col("profile_date").alias("time"), F.col("profile_lat").alias("lat"),
                          F.col("profile_lon").alias("lon"))
    return sums.join(places, "profile_id")


def mean_of(c: str) -> Column:
    return F.try_divide(F.sum(f"sum_{c}"), F.sum(f"count_{c}")).alias(f"avg_{c}")


def total_rows() -> Column:
    return F.sum("n").cast("long").alias("measurement_count")


def _first(df: DataFrame, top: int | None) -> DataFrame:
    return df if top is None else df.limit(top)


def avg_by_depth(m: DataFrame, top: int | None = None) -> DataFrame:
    """Averages per depth, the shallowest first; ``top`` keeps the first so many."""
    both = F.col("temperature").isNotNull() & F.col("salinity").isNotNull()
    rows = m.filter(both).groupBy("depth").agg(avg("temperature"), avg("salinity"), n_rows().alias("measurement_count"))
    return _first(rows.orderBy("depth"), top)


def dataset_comparison(m: DataFrame, casts: DataFrame | None = None, by: str = "dataset_type") -> DataFrame:
    return (
        partial_sums(m, ("temperature", "salinity"), casts, (by,)).groupBy(by)
        .agg(F.sum("n").cast("long").alias("observation_count"), mean_of("temperature"), mean_of("salinity"),
             F.min("time").alias("start_date"), F.max("time").alias("end_date"))
        .orderBy(F.desc("observation_count"), by)
    )


def regional_comparison(m: DataFrame, casts: DataFrame | None = None) -> DataFrame:
    columns = ("temperature", "salinity", "oxygen")
    return (
        partial_sums(m.filter(F.col("temperature").isNotNull()), columns, casts)
        .groupBy(labels.basin(F.col("lat"), F.col("lon")).alias("region"))
        .agg(
            *(F.round(mean_of(c), 2).alias(f"avg_{c}") for c in columns),
            total_rows(),
            F.round(F.min("min_depth"), 0).alias("min_depth_m"),
            F.round(F.max("max_depth"), 0).alias("max_depth_m"),
        )
        .orderBy(F.desc("measurement_count"), "region")
    )


def depth_ranges(m: DataFrame) -> DataFrame:
    return (
        m.filter(F.col("temperature").isNotNull())
        .groupBy(labels.depth_band(F.col("depth")).alias("depth_range"))
        .agg(avg("temperature"), avg("salinity"), avg("oxygen"), n_rows().alias("measurement_count"),
             F.min("depth").alias("_d"))
        .orderBy("_d").drop("_d")
    )


def temporal_trends(m: DataFrame, top: int | None = None, casts: DataFrame | None = None) -> DataFrame:
    """Averages per month, the earliest first; ``top`` keeps the first so many."""
    sums = partial_sums(m.filter(F.col("temperature").isNotNull()), ("temperature", "salinity"), casts)
    rows = sums.groupBy(month_of(F.col("time")).alias("month")).agg(mean_of("temperature"), mean_of("salinity"), total_rows())
    return _first(rows.orderBy("month"), top)


def bgc_zones(m: DataFrame) -> DataFrame:
    return (
        m.filter(F.col("oxygen").isNotNull() & F.col("ph").isNotNull())
        .groupBy(labels.ocean_zone(F.col("depth")).alias("ocean_zone"))
        .agg(avg("oxygen"), avg("ph"), avg("chlorophyll"), n_rows().alias("measurement_count"), F.min("depth").alias("_d"))
        .orderBy("_d").drop("_d")
    )


def system_statistics(floats: DataFrame, profiles: DataFrame, m: DataFrame) -> DataFrame:
    """Counts and averages of the three tables in one row; each is its own scan, put together as scalars."""
    return floats.sparkSession.sql(
        f"""
        SELECT (SELECT count(DISTINCT float_id) FROM {{floats}}) AS active_floats,
               (SELECT count(*) FROM {{profiles}}) AS total_profiles,
               m.total_measurements, m.avg_temperature, m.avg_salinity,
               {QUALITY_SHARE}D AS data_quality
        FROM (SELECT count(*) AS total_measurements, round(avg(temperature), 2) AS avg_temperature,
                     round(avg(salinity), 2) AS avg_salinity FROM {{m}}) m
        """,
        floats=floats, profiles=profiles, m=m,
    )


def load_summary(floats: DataFrame, profiles: DataFrame, m: DataFrame) -> DataFrame:
    return floats.sparkSession.sql(
        """SELECT (SELECT count(*) FROM {floats}) AS floats, (SELECT count(*) FROM {profiles}) AS profiles,
                  (SELECT count(*) FROM {m}) AS measurements""",
        floats=floats, profiles=profiles, m=m,
    )


def float_card(floats: DataFrame, profiles: DataFrame, m: DataFrame, float_id=None) -> DataFrame:
    """Float row with profile and measurement summaries; one float, or every float at once.

    Measurements are summed per profile first, then per float together with the profiles.
    """
    if float_id is not None:
        own = F.col("float_id") == float_id
        floats, profiles = floats.filter(own), profiles.filter(own)
    per_profile = m.groupBy("profile_id").agg(
        n_rows().alias("n"), F.min("depth").alias("lo"), F.max("depth").alias("hi"),
        F.sum("temperature").alias("ts"), F.count("temperature").alias("tn"),
        F.sum("salinity").alias("ss"), F.count("salinity").alias("sn"),
    )
    per_float = (
        profiles.select("profile_id", "float_id", "profile_date")
        .join(per_profile, "profile_id", "left")
        .groupBy("float_id")
        .agg(
            n_rows().alias("total_profiles"),
            F.min("profile_date").alias("first_profile"), F.max("profile_date").alias("last_profile"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_measurements"),
            F.min("lo").alias("min_depth"), F.max("hi").alias("max_depth"),
            F.try_divide(F.sum("ts"), F.sum("tn")).alias("avg_temp"),
            F.try_divide(F.sum("ss"), F.sum("sn")).alias("avg_sal"),
        )
    )
    return floats.join(per_float, "float_id", "left").fillna(0, ["total_profiles", "total_measurements"])


def dataset_summary(df: DataFrame) -> DataFrame:
    """Coverage of a table in one row; what a missing column would give is null.  An empty table gives no row."""
    cols = df.columns

    def have(*names: str) -> bool:
        return all(n in cols for n in names)

    def span(column: str, lo: str, hi: str, width: str) -> list[Column]:
        if not have(column):
            return [F.lit(None).cast("double").alias(n) for n in (lo, hi, width)]
        return [F.min(column).alias(lo), F.max(column).alias(hi), (F.max(column) - F.min(column)).alias(width)]

    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    good = F.count_if(F.col("quality_flag").isin(1, 2)) * 100.0 / n_rows() if have("quality_flag") else nothing
    date = F.col("date") if have("date") else F.lit(None).cast("timestamp_ntz")
    return df.agg(
        (F.countDistinct("float_id") if have("float_id") else zero).alias("total_floats"),
        (F.countDistinct("profile_id") if have("profile_id") else n_rows()).alias("total_profiles"),
        n_rows().alias("total_measurements"),
        F.min(date).alias("start"),
        F.max(date).alias("end"),
        F.datediff(F.max(date), F.min(date)).alias("span_days"),
        *span("latitude", "lat_min", "lat_max", "lat_span"),
        *span("longitude", "lon_min", "lon_max", "lon_span"),
        *span("depth", "min_depth", "max_depth", "depth_span"),
        (F.avg("depth") if have("depth") else nothing).alias("mean_depth"),
        good.alias("good_data_percentage"),
    ).filter("total_measurements > 0")


def coverage_of_readings(readings: DataFrame, casts: DataFrame) -> DataFrame:
    """``dataset_summary`` of all measurements from readings summed per profile, which then meet their profiles."""
    per_profile = readings.groupBy("profile_id").agg(
        n_rows().alias("n"), F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.sum("depth").alias("sum"), F.count("depth").alias("deep"),
        F.count_if(F.col("quality_flag").isin(1, 2)).alias("good"))
    both = per_profile.join(casts.select("profile_id", "float_id", "profile_date", "profile_lat", "profile_lon"), "profile_id")
    low, high = lambda c, name: F.min(c).alias(name), lambda c, name: F.max(c).alias(name)
    rows = both.agg(F.count_distinct("float_id").alias("total_floats"), n_rows().alias("total_profiles"), F.sum("n").cast("long").alias("total_measurements"),
                    low("profile_date", "start"), high("profile_date", "end"), low("profile_lat", "lat_min"), high("profile_lat", "lat_max"),
                    low("profile_lon", "lon_min"), high("profile_lon", "lon_max"), low("lo", "min_depth"), high("hi", "max_depth"),
                    F.try_divide(F.sum("sum"), F.sum("deep")).alias("mean_depth"), F.sum("good").alias("good"))
    return rows.filter("total_profiles > 0").select(
        "total_floats", "total_profiles", "total_measurements", "start", "end", F.datediff("end", "start").alias("span_days"),
        "lat_min", "lat_max", (F.col("lat_max") - F.col("lat_min")).alias("lat_span"), "lon_min", "lon_max", (F.col("lon_max") - F.col("lon_min")).alias("lon_span"),
        "min_depth", "max_depth", (F.col("max_depth") - F.col("min_depth")).alias("depth_span"), "mean_depth",
        (F.col("good") * 100.0 / F.col("total_measurements")).alias("good_data_percentage"))


def _moments(df: DataFrame, columns, by=()) -> DataFrame:
    """count, mean, std, min and max of many columns in one pass, turned into one row per column."""
    wide = df.groupBy(*by).agg(
        *(
            F.struct(
                F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        )
    )
    cells = F.array(*(F.struct(F.lit(c).alias("parameter"), F.col(c).alias("s")) for c in columns))
    return wide.select(*by, F.inline(cells)).select(*by, "parameter", "s.*").filter(F.col("count") > 0)


#: What the quantile pass takes along of each column.
MOMENTS = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def parameter_statistics(df: DataFrame, columns=None) -> DataFrame:
    """count, mean, median, std, min, max, quartiles, range and variation of each column that has a value."""
    columns = [c for c in (columns or parameter_columns(df)) if c in df.columns]
    q = quantiles(df, columns, (0.25, 0.5, 0.75), ("q25", "median", "q75"), besides=MOMENTS)
    variation = F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0)
    return q.select(
        "parameter", "count", "mean", "median", "std", "min", "max", "q25", "q75",
        (F.col("max") - F.col("min")).alias("range"), variation.alias("coefficient_of_variation"),
    )


def summary_table(df: DataFrame, columns) -> DataFrame:
    """Mean, std, range and count of the chosen parameters."""
    return parameter_statistics(df, columns).select("parameter", "mean", "std", "range", "count")


def data_summary(df: DataFrame, columns=SUMMARY_COLUMNS) -> DataFrame:
    """Mean, median, std, min, max and count of the listed columns that exist."""
    columns = [c for c in columns if c in df.columns]
    return quantiles(df, columns, (0.5,), ("median",), besides=MOMENTS).select(
        "parameter", "mean", "median", "std", "min", "max", "count"
    )


def data_totals(df: DataFrame, time: str = "time") -> DataFrame:
    """Records, columns, numeric columns and the range of times (null without such a column); no row for an empty table."""
    ends = [F.min(time), F.max(time)] if time in df.columns else [F.lit(None).cast("timestamp_ntz")] * 2
    return df.agg(n_rows().alias("total_records"), F.lit(len(df.columns)).alias("total_columns"),
                  F.lit(len(numeric_columns(df))).alias("numeric_columns"), ends[0].alias("first_time"), ends[1].alias("last_time")
                  ).filter("total_records > 0")


def flag_distribution(df: DataFrame) -> DataFrame:
    """Rows per quality flag with its label."""
    counts = df.groupBy("quality_flag").agg(n_rows().alias("flag_count"))
    known = labels.flag_table(df.sparkSession)  # ten fixed rows
    return (
        counts.join(F.broadcast(known), "quality_flag", "left")
        .withColumn("flag_label", F.coalesce("flag_label", F.lit("Unknown")))
        .orderBy("quality_flag")
    )


def result_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, nulls, and mean / min / max / count of every numeric column."""
    numeric = numeric_columns(df)
    wide = df.agg(
        n_rows().alias("total_rows"),
        F.coalesce(F.bool_or(F.greatest(*(F.col(c).isNull().cast("int") for c in df.columns), F.lit(0)) == 1),
                   F.lit(False)).alias("has_nulls"),
        *(
            F.struct(F.avg(c).alias("mean"), F.min(c).cast("double").alias("min"),
                     F.max(c).cast("double").alias("max"), F.count(c).alias("count")).alias(f"_{c}")
            for c in numeric
        ),
    )
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("s")) for c in numeric))
    return wide.select(
        "total_rows", F.lit(len(df.columns)).alias("total_columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"), "has_nulls", F.inline(cells),
    ).select("total_rows", "total_columns", "numeric_columns", "has_nulls", "column", "s.*")


def describe_numeric(df: DataFrame, columns) -> DataFrame:
    """Min, max and mean of the listed columns that exist, one row each."""
    return _moments(df, [c for c in columns if c in df.columns]).select("parameter", "min", "max", "mean")


def profile_sigma_band(m: DataFrame, by: str = "float_id", columns=("temperature", "salinity")) -> DataFrame:
    """Mean line and one-sigma band per float."""
    stats = m.groupBy(by).agg(
        *(F.avg(c).alias(f"mean_{c}") for c in columns), *(F.stddev_samp(c).alias(f"std_{c}") for c in columns)
    )
    for c in columns:
        stats = stats.withColumn(f"{c}_low", F.col(f"mean_{c}") - F.col(f"std_{c}"))
        stats = stats.withColumn(f"{c}_high", F.col(f"mean_{c}") + F.col(f"std_{c}"))
    return stats


def sigma_band_of_readings(readings: DataFrame, casts: DataFrame, columns=("temperature", "salinity")) -> DataFrame:
    """The same band per float from readings and profiles: numbers, means and squared deviations per profile are put together."""
    def parts(c: str) -> list[Column]:
        return [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), (F.var_pop(c) * F.count(c)).alias(f"d_{c}")]

    per_profile = readings.groupBy("profile_id").agg(*(p for c in columns for p in parts(c)))
    weighted = lambda c, power: F.sum(F.col(f"n_{c}") * F.pow(f"m_{c}", F.lit(power)))
    stats = per_profile.join(casts.select("profile_id", "float_id"), "profile_id").groupBy("float_id").agg(*(
        p for c in columns for p in (F.sum(f"n_{c}").alias(f"n_{c}"), weighted(c, 1.0).alias(f"s_{c}"), weighted(c, 2.0).alias(f"q_{c}"),
                                     F.sum(f"d_{c}").alias(f"d_{c}"))))
    out = [F.col("float_id")]
    for c in columns:
        n, mean = F.col(f"n_{c}"), F.try_divide(F.col(f"s_{c}"), F.col(f"n_{c}"))
        between = F.greatest(F.col(f"q_{c}") - n * mean * mean, F.lit(0.0))
        spread = F.when(n > 1, F.sqrt((F.col(f"d_{c}") + between) / (n - 1)))
        out += [mean.alias(f"mean_{c}"), spread.alias(f"std_{c}"), (mean - spread).alias(f"{c}_low"), (mean + spread).alias(f"{c}_high")]
    return stats.select(*out)


def selection_metrics(m: DataFrame, casts: DataFrame | None = None) -> DataFrame:
    return partial_sums(m, (), casts).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_count"),
                                          F.countDistinct("float_id").alias("float_count"), F.max("max_depth").alias("max_depth"))


def key_audit(floats: DataFrame, profiles: DataFrame, m: DataFrame) -> DataFrame:
    """Duplicate keys and children without a parent, one row per rule."""
    def duplicates(df: DataFrame, key: str, rule: str) -> DataFrame:
        repeated = df.groupBy(key).agg(n_rows().alias("n")).filter("n > 1")
        return repeated.agg(F.lit(rule).alias("rule"), n_rows().alias("violations"))

    def orphans(child: DataFrame, parent: DataFrame, key: str, rule: str) -> DataFrame:
        # one row per distinct key crosses the network, not one per child
        lost = child.groupBy(key).agg(n_rows().alias("n")).join(parent.select(key), key, "left_anti")
        return lost.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))

    parts = (
        duplicates(floats, "float_id", "duplicate float_id"),
        duplicates(profiles, "profile_id", "duplicate profile_id"),
        duplicates(m, "id", "duplicate measurement id"),
        orphans(profiles, floats, "float_id", "profile without float"),
        orphans(m, profiles, "profile_id", "measurement without profile"),
    )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
