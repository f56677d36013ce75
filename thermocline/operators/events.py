"""Connection, error, metric, feedback and operation logs.

A log has a time ``ts``, a ``service`` and an ``event_type``.  ``as_of`` stands for "now" and is always given, so a
result can be repeated.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros, n_rows, packed_order, safe_divide
from .order import last_per_key

# --- fixed values -----------------------------------------------------------------------------------------
COMPONENT_CATEGORY = {
    "api_client": "api_connection",
    "data_fetcher": "api_connection",
    "map_visualization": "visualization",
    "profile_visualizer": "visualization",
    "statistics_manager": "visualization",
    "data_manager": "data_processing",
    "data_transformer": "data_processing",
    "chat_interface": "user_input",
}
ERROR_CATEGORY = {
    "ConnectionError": "network",
    "TimeoutError": "network",
    "ValueError": "data_processing",
    "TypeError": "data_processing",
}
CRITICAL_ERRORS = ("SystemError", "MemoryError")
BAD_VALUE_ERRORS = ("ValueError", "TypeError")
RECENT = dt.timedelta(minutes=5)
FEEDBACK_RECENT = dt.timedelta(hours=1)
ERROR_RATE_LIMIT = 5
LAST_ROWS = 10
# ----------------------------------------------------------------------------------------------------------


def _at(moment: dt.datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def latest_time(log: DataFrame, ts: str = "ts") -> dt.datetime:
    """The newest time of a log: one value, read so that it can prune the scans that follow."""
    return log.agg(F.max(ts)).first()[0]


def recent_events(log: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    return log.filter(F.col("ts") >= _at(as_of - dt.timedelta(hours=hours)))


def last_events(log: DataFrame, as_of: dt.datetime, hours: int = 24, n: int = LAST_ROWS) -> DataFrame:
    """The newest n recent events of each service and how many there were."""
    recent = recent_events(log, as_of, hours)
    counts = recent.groupBy("service").agg(n_rows().alias("event_count"))
    newest = last_per_key(recent, "service", [F.desc("ts"), F.desc("event_id")], n)
    return newest.join(counts, "service")


def _when() -> Column:
    """Order of a log's rows as one number."""
    return packed_order(micros(F.col("ts")), F.col("event_id").cast("bigint"))


def failure_runs(log: DataFrame, failed: Column) -> DataFrame:
    """Failures since the last success, per service.

    The last success of each service is one aggregate; what came after it is counted by another.  Both hash.  No window
    runs over a service, so a service with most of the events is no slower than others.
    """
    marked = log.select("service", "ts", failed.alias("_failed"), _when().alias("_at"))
    at = F.col("_at")
    success = marked.groupBy("service").agg(
        F.max(F.when(~F.col("_failed"), at)).alias("_ok"), F.max("ts").alias("last_event"),
        F.count_if("_failed").alias("failures"), n_rows().alias("events"),
    )
    later = F.col("_ok").isNull() | (at > F.col("_ok"))
    open_runs = (
        marked.filter("_failed").join(success.select("service", "_ok"), "service").filter(later)
        .groupBy("service").agg(n_rows().alias("consecutive_failures"), F.min("ts").alias("failing_since"))
    )
    return success.join(open_runs, "service", "left").select(
        "service", "events", "failures", "last_event",
        F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), "failing_since",
    )


def latest_status(log: DataFrame, status: Column) -> DataFrame:
    """The newest status of each service.

    Texts can't be held in a hash aggregate, so the newest row is found by the hash of its status, which the few different
    ones are looked up by.
    """
    marked = log.select("service", status.alias("status"), _when().alias("_at"))
    newest = marked.groupBy("service").agg(F.max_by(F.xxhash64("status"), "_at").alias("_code"))
    known = marked.groupBy("status").agg(n_rows().alias("_n")).select("status", F.xxhash64("status").alias("_code"))
    return newest.join(known, "_code").select("service", "status")


def overall_status(latest: DataFrame) -> DataFrame:
    """connected if all are, error if some are or if the failures differ, disconnected if all are, unknown if none."""
    counts = latest.agg(
        n_rows().alias("services"), F.count_if(F.col("status") == "connected").alias("connected"),
        F.count_if(F.col("status") == "disconnected").alias("disconnected"),
    )
    state = (
        F.when(F.col("services") == 0, "unknown").when(F.col("connected") == F.col("services"), "connected")
        .when(F.col("connected") > 0, "error").when(F.col("disconnected") == F.col("services"), "disconnected")
        .otherwise("error")
    )
    return counts.withColumn("overall_status", state)


def recent_metrics(log: DataFrame, as_of: dt.datetime, hit: Column, size: Column,
                   within: dt.timedelta = RECENT) -> DataFrame:
    """Average time, share of cache hits, volume and newest value of the last minutes; no row if there is none."""
    return (
        log.filter((F.col("ts") > _at(as_of - within)) & (F.col("ts") <= _at(as_of)))
        .agg(
            n_rows().alias("operations"), F.avg("value").alias("avg_time"),
            safe_divide(F.count_if(hit) * 100.0, n_rows()).alias("cache_hit_rate"), F.sum(size).alias("volume"),
            F.max_by("value", _when()).alias("latest_value"),
        )
        .filter("operations > 0")
    )


def error_summary(errors: DataFrame, as_of: dt.datetime, critical: Column) -> DataFrame:
    """All errors, those of the last five minutes, and the critical ones."""
    recent = (F.col("ts") > _at(as_of - RECENT)) & (F.col("ts") <= _at(as_of))
    return errors.agg(n_rows().alias("total_errors"), F.count_if(recent).alias("recent_errors"),
                      F.count_if(critical).alias("critical_errors"))


def newest(log: DataFrame, n: int = LAST_ROWS) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def feedback_summary(log: DataFrame, as_of: dt.datetime, is_rating: Column) -> DataFrame:
    """All feedback, that of the last hour, and the average rating."""
    recent = (F.col("ts") > _at(as_of - FEEDBACK_RECENT)) & (F.col("ts") <= _at(as_of))
    return log.agg(n_rows().alias("total_feedback"), F.count_if(recent).alias("recent_feedback"),
                   F.avg(F.when(is_rating, F.col("value"))).alias("avg_rating"))


def last_feedback(log: DataFrame, n: int = 5) -> DataFrame:
    """The newest n feedback entries with their place, 1 the newest."""
    rows = log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id"))))  # n rows


def error_category(component: Column, error_type: Column) -> Column:
    """By component, then by kind of error, else system."""
    chain = F
    for name, category in COMPONENT_CATEGORY.items():
        chain = chain.when(component == name, category)
    for name, category in ERROR_CATEGORY.items():
        chain = chain.when(error_type == name, category)
    return chain.otherwise("system")


def severity(category: Column, error_type: Column, message: Column) -> Column:
    timeout = F.lower(message).contains("timeout")
    return (
        F.when(error_type.isin(*CRITICAL_ERRORS), "critical")
        .when((category == "api_connection") & timeout, "warning")
        .when((category == "data_processing") & error_type.isin(*BAD_VALUE_ERRORS), "warning")
        .when(category.isin("visualization", "network"), "warning")
        .when(category == "user_input", "info")
        .otherwise("error")
    )


def severity_labels(errors: DataFrame) -> DataFrame:
    """Category and severity of every logged error (component, error_type, message)."""
    category = error_category(F.col("component"), F.col("error_type"))
    return errors.withColumn("category", category).withColumn(
        "severity", severity(F.col("category"), F.col("error_type"), F.col("message"))
    )


def daily_activity(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date")).agg(n_rows().alias("count"))


def health_rollup(log: DataFrame, as_of: dt.datetime, status: Column, failed: Column) -> DataFrame:
    """healthy or degraded, with the reasons: a service that is not connected, or many errors lately."""
    down = latest_status(log, status).agg(F.count_if(F.col("status") != "connected").alias("services_down"))
    recent = (F.col("ts") > _at(as_of - RECENT)) & (F.col("ts") <= _at(as_of))
    errors = log.agg(F.count_if(failed & recent).alias("recent_errors"))
    both = log.sparkSession.sql(
        "SELECT (SELECT services_down FROM {d}) AS services_down, (SELECT recent_errors FROM {e}) AS recent_errors",
        d=down, e=errors,
    )
    busy = F.col("recent_errors") > ERROR_RATE_LIMIT
    broken = F.col("services_down") > 0
    return both.select(
        F.when(broken | busy, "degraded").otherwise("healthy").alias("overall_status"), "services_down",
        "recent_errors",
        F.concat_ws("; ", F.when(broken, "Check API connection"), F.when(busy, "High error rate detected")).alias(
            "recommendations"),
    )


def operation_totals(log: DataFrame, size: Column) -> DataFrame:
    """Per operation: runs, average time and records processed."""
    return log.groupBy(F.col("event_type").alias("operation")).agg(
        n_rows().alias("runs"), F.avg("value").alias("avg_time"), F.sum(size).alias("records_processed")
    )
