"""Data quality: flag scores, missing values, outliers, table checks.

Fences and counts are two passes over the table; nothing is unpivoted row by row except inside aggregates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fixed_text, n_rows
from .analytics import numeric_columns
from .quantiles import quantiles

PLACES = ("latitude", "longitude", "depth")
CHECKED = ("temperature", "salinity", "depth")
# --- fixed values: the messages of the assessment ---------------------------------------------------------------
NO_DATA, BAD_DATA = "No data available for quality assessment", "High percentage of bad data: {:.1f}%"
GONE_DATA, GAPS = "High percentage of missing values: {:.1f}%", "High missing data in {}: {:.1f}%"
OUTLIERS = "High outlier percentage in {}: {:.1f}%"
FILTER_FIRST, ALL_GOOD = "Consider filtering out bad quality data before analysis", "Data quality appears good for analysis"
# ----------------------------------------------------------------------------------------------------------
SCORES, LOWEST_SCORE = ((90, 5), (80, 4), (70, 3), (60, 2)), 1  # least share of good flags, score


def _percent(title, share: Column) -> Column:
    """``title: 12.3%``"""
    start = F.lit(title) if isinstance(title, str) else title
    return F.concat(start, F.lit(": "), fixed_text(share, 1), F.lit("%"))


def _score(good: Column) -> Column:
    chain = F
    for least, score in SCORES:
        chain = chain.when(good >= least, score)
    return chain.otherwise(LOWEST_SCORE)


def quality_by_float(readings: DataFrame, casts: DataFrame) -> DataFrame:
    """The score of each float; flags are counted per profile before these meet their floats."""
    flag = F.col("quality_flag")
    per_profile = readings.groupBy("profile_id").agg(
        n_rows().alias("n"), F.count_if(flag.isin(1, 2)).alias("good"), F.count_if(flag.isin(3, 4)).alias("bad"))
    sums = per_profile.join(casts.select("profile_id", "float_id"), "profile_id").groupBy("float_id").agg(
        *(F.sum(c).cast("long").alias(c) for c in ("n", "good", "bad")))
    share = lambda c: (F.col(c) * 100.0 / F.col("n")).alias(f"{c}_data_percentage")
    shares = sums.select("float_id", F.col("n").alias("total_records"), share("good"), share("bad"))
    return shares.withColumn("overall_score", _score(F.col("good_data_percentage")))


def quality_score(df: DataFrame, by=()) -> DataFrame:
    """Score 1 to 5 by the share of good flags; 0 without a flag column or without rows."""
    if "quality_flag" not in df.columns:
        nothing = F.lit(None).cast("double")
        return df.groupBy(*by).agg(
            n_rows().alias("total_records"), nothing.alias("good_data_percentage"), nothing.alias("bad_data_percentage")
        ).withColumn("overall_score", F.lit(0))
    shares = df.groupBy(*by).agg(
        n_rows().alias("total_records"),
        F.when(n_rows() > 0, F.try_divide(F.count_if(F.col("quality_flag").isin(1, 2)) * 100.0, n_rows())).alias(
            "good_data_percentage"),
        F.when(n_rows() > 0, F.try_divide(F.count_if(F.col("quality_flag").isin(3, 4)) * 100.0, n_rows())).alias(
            "bad_data_percentage"),
    )
    score = F.when(F.col("total_records") == 0, 0).otherwise(_score(F.col("good_data_percentage")))
    return shares.withColumn("overall_score", score)


def missing_by_column(df: DataFrame, columns=None) -> DataFrame:
    """Missing count and percentage per numeric column, in one pass."""
    columns = list(columns or numeric_columns(df))
    wide = df.agg(n_rows().alias("n"), *(F.count(c).alias(c) for c in columns))
    cells = F.array(
        *(F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(c)).alias("missing_count")) for c in columns)
    )
    return wide.filter("n > 0").select("n", F.inline(cells)).select(
        "column", "missing_count", (F.col("missing_count") * 100.0 / F.col("n")).alias("missing_percentage")
    )


def iqr_fences(df: DataFrame, columns) -> DataFrame:
    """Lower and upper bound per column: quartiles widened by one and a half quartile ranges."""
    q = quantiles(df, columns, (0.25, 0.75), ("q1", "q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return q.select("parameter", (F.col("q1") - reach).alias("lower_bound"), (F.col("q3") + reach).alias("upper_bound"))


def iqr_outliers(df: DataFrame, columns=None) -> DataFrame:
    """Values outside the fences per numeric column (places left out), as count and share of the non-null ones.

    The fences, two numbers per column, are read first; the count is then one pass of conditional sums.
    """
    columns = [c for c in (columns or numeric_columns(df)) if c not in PLACES]
    fences = {r["parameter"]: r for r in iqr_fences(df, columns).collect()}  # a row per column
    known = [c for c in columns if c in fences]
    if not known:
        return df.sparkSession.createDataFrame(
            [], "column string, outlier_count bigint, outlier_percentage double, lower_bound double, "
                "upper_bound double"
        )

    def outside(c: str) -> Column:
        return (F.col(c) < fences[c]["lower_bound"]) | (F.col(c) > fences[c]["upper_bound"])

    wide = df.agg(*(F.struct(F.count(c).alias("n"), F.count_if(outside(c)).alias("out")).alias(c) for c in known))
    cells = F.array(
        *(
            F.struct(
                F.lit(c).alias("column"), F.col(c)["out"].alias("outlier_count"),
                F.try_divide(F.col(c)["out"] * 100.0, F.col(c)["n"]).alias("outlier_percentage"),
                F.lit(fences[c]["lower_bound"]).alias("lower_bound"),
                F.lit(fences[c]["upper_bound"]).alias("upper_bound"),
            )
            for c in known
        )
    )
    return wide.select(F.inline(cells))


def quality_issues(df: DataFrame) -> DataFrame:
    """Issue and recommendation rows of the whole assessment (flags, missing values, outliers).

    One pass counts flags and missing values, the outlier check takes its own two.  What reaches the driver is one
    number per column and flag; the messages are made from those.
    """
    columns = numeric_columns(df)
    flagged = "quality_flag" in df.columns
    counts = [F.count(c).alias(f"_{c}") for c in columns]
    if flagged:
        counts += [F.count_if(F.col("quality_flag").isin(*flags)).alias(name)
                   for name, flags in (("good", (1, 2)), ("bad", (4,)), ("gone", (9,)))]
    row = df.agg(n_rows().alias("n"), *counts).first()
    total, issues, advice = row["n"], [], []
    score = 0
    if total == 0:
        issues.append(NO_DATA)
    else:
        share = lambda count: count / total * 100
        if flagged:
            score = next((s for least, s in SCORES if share(row["good"]) >= least), LOWEST_SCORE)
            if row["bad"] > total * 0.1:
                issues.append(BAD_DATA.format(share(row["bad"])))
            if row["gone"] > total * 0.2:
                issues.append(GONE_DATA.format(share(row["gone"])))
        for c in columns:
            if share(total - row[f"_{c}"]) > 50:
                issues.append(GAPS.format(c, share(total - row[f"_{c}"])))
        for r in iqr_outliers(df, columns).filter("outlier_percentage > 5").collect():  # a row per column
            issues.append(OUTLIERS.format(r["column"], r["outlier_percentage"]))
        if score < 3:
            advice.append(FILTER_FIRST)
        if not issues:
            advice.append(ALL_GOOD)
    rows = [("issue", text) for text in issues] + [("recommendation", text) for text in advice]
    return df.sparkSession.createDataFrame(rows, "kind string, message string")


def table_quality(df: DataFrame) -> DataFrame:
    """One row: missing share of all cells, issues found, score 0..1 and status."""
    columns = df.columns
    checked = [c for c in CHECKED if c in columns]
    fences = {r["parameter"]: r for r in iqr_fences(df, checked).collect()} if checked else {}
    known = [c for c in checked if c in fences]
    filled = sum((F.count(c) for c in columns[1:]), F.count(columns[0]))
    wide = df.agg(
        n_rows().alias("total_records"),
        filled.alias("_filled"),
        *(
            F.count_if((F.col(c) < fences[c]["lower_bound"]) | (F.col(c) > fences[c]["upper_bound"])).alias(f"_{c}")
            for c in known
        ),
    )
    cells = F.col("total_records") * F.lit(float(len(columns)))
    wide = wide.withColumn("missing_percentage", F.try_divide((cells - F.col("_filled")) * 100.0, cells))
    gaps = F.col("missing_percentage")
    issues = F.array_compact(F.array(
        F.when(gaps > 50, _percent("High missing data", gaps))
        .when(gaps > 20, _percent("Moderate missing data", gaps)),
        *(
            F.when(F.col(f"_{c}") > F.col("total_records") * 0.05,
                   F.format_string(f"Potential outliers in {c}: %d values", F.col(f"_{c}")))
            for c in known
        ),
    ))
    empty = F.col("total_records") == 0
    score = F.when(empty, 0.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - gaps / 100 - F.size("_issues") * 0.1))
    status = (
        F.when(empty, "no_data").when(F.col("score") >= 0.95, "excellent").when(F.col("score") >= 0.85, "good")
        .when(F.col("score") >= 0.70, "fair").otherwise("poor")
    )
    return (
        wide.withColumn("_issues", F.when(empty, F.array(F.lit("No data available"))).otherwise(issues))
        .withColumn("score", score)
        .select(status.alias("status"), "score", "missing_percentage", "total_records",
                F.array_join("_issues", "; ").alias("issues"))
    )


def extra_checks(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Repeated ids, times in the future, impossible places and temperatures, each if its columns exist."""
    found = []
    if "id" in df.columns:
        found.append((F.count("id") - F.countDistinct("id")).alias("duplicate_count"))
    if "time" in df.columns:
        now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
        found.append(F.count_if(F.col("time") > now).alias("future_dates"))
    if "lat" in df.columns and "lon" in df.columns:
        found.append(F.count_if((F.abs("lat") > 90) | (F.abs("lon") > 180)).alias("invalid_coordinates"))
    if "temperature" in df.columns:
        found.append(F.count_if((F.col("temperature") < -5) | (F.col("temperature") > 40)).alias(
            "extreme_temperatures"))
    return df.agg(*found)


def completeness(df: DataFrame) -> DataFrame:
    """Share of filled cells per column of any type, in percent."""
    wide = df.agg(n_rows().alias("n"), *(F.count(c).alias(f"_{c}") for c in df.columns)).filter("n > 0")
    cells = F.array(*(
        F.struct(F.lit(c).alias("column"), (F.col(f"_{c}") * 100.0 / F.col("n")).alias("complete_percentage"))
        for c in df.columns
    ))
    return wide.select(F.inline(cells)).withColumn("missing_percentage", 100.0 - F.col("complete_percentage"))


def quality_report(df: DataFrame, described=("temperature", "salinity", "depth", "lat", "lon")) -> DataFrame:
    """The report as long rows (section, name, measure, value): size, completeness, min / max / mean."""
    from .analytics import describe_numeric

    def rows(frame: DataFrame, section: str, name: Column, measures: dict[str, Column]) -> DataFrame:
        cells = F.array(*(
            F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in measures.items()))
        return frame.select(F.lit(section).alias("section"), name.alias("name"), F.inline(cells))

    size = rows(df.agg(n_rows().alias("n")), "dataset", F.lit("all"),
                {"records": F.col("n"), "columns": F.lit(len(df.columns))})
    filled = rows(completeness(df), "completeness", F.col("column"),
                  {"complete_percentage": F.col("complete_percentage"),
                   "missing_percentage": F.col("missing_percentage")})
    stats = rows(describe_numeric(df, described), "statistics", F.col("parameter"),
                 {"min": F.col("min"), "max": F.col("max"), "mean": F.col("mean")})
    return size.unionByName(filled).unionByName(stats)
