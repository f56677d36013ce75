"""Windowed counts and metrics over an event stream.

Late rows beyond the watermark are dropped and state older than it is forgotten.  Windowed aggregates are combined
in every task before the shuffle, so a busy service costs no more than its number of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import micros, n_rows, packed_order, safe_divide


def _timed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks want a timestamp with zone; a zone-less one is read in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events without repeats of the same key within the watermark."""
    return _timed(events, ts, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, ts: str = "ts", delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Rows per day, emitted once a day can no longer change."""
    return (
        _timed(events, ts, delay).groupBy(F.window(ts, width))
        .agg(n_rows().alias("count")).select(F.col("window.start").alias("date"), "count")
    )


def monthly_counts(daily: DataFrame) -> DataFrame:
    """Months from finished days (a batch over the sink of ``daily_counts``: months have no fixed length)."""
    return daily.groupBy(F.date_trunc("month", "date").alias("month")).agg(F.sum("count").alias("count"))


def recent_metrics(events: DataFrame, hit: Column, size: Column, ts: str = "ts", delay: str = "5 minutes",
                   width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Average time, hit rate, volume and newest value of every five minutes, each minute."""
    return (
        _timed(events, ts, delay).groupBy(F.window(ts, width, slide))
        .agg(
            n_rows().alias("operations"), F.avg("value").alias("avg_time"),
            safe_divide(F.count_if(hit) * 100.0, n_rows()).alias("cache_hit_rate"), F.sum(size).alias("volume"),
            F.max_by("value", packed_order(micros(F.col(ts)), F.col("event_id"))).alias("latest_value"),
        )
        .select("window.start", "window.end", "operations", "avg_time", "cache_hit_rate", "volume", "latest_value")
    )
