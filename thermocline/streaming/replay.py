"""A finished table as a stream: time slices written one after the other, each read as one micro-batch or more."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch

SLICES = 4


def slice_span(df: DataFrame, ts: str = "ts", slices: int = SLICES) -> tuple[dt.datetime, dt.timedelta] | None:
    """Start of the first slice and length of each; none for a table without times."""
    low, high = df.agg(F.min(ts), F.max(ts)).first()
    return None if low is None else (low, (high - low) / slices + dt.timedelta(microseconds=1))


def replay(df: DataFrame, ts: str = "ts", slices: int = SLICES, again: str | None = None) -> DataFrame:
    """``df`` as a file stream in the order of time.

    The rows of a slice are written by one job into files that are as many as the session's tasks, so that a micro-batch holds
    about a slice and none holds rows before those of an earlier one.  ``again`` is a condition: such rows are delivered once
    more, with the next slice.  Rows without a time are left out.
    """
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    files = spark.sparkContext.defaultParallelism
    span = slice_span(df, ts, slices)
    start, step = span or (dt.datetime(2000, 1, 1), dt.timedelta(1))
    bound = lambda i: F.lit((start + i * step).isoformat(sep=" ")).cast(df.schema[ts].dataType)
    inside = lambda i: (F.col(ts) >= bound(i)) & (F.col(ts) < bound(i + 1))
    for i in range(slices if again is None else slices + 1):
        rows = df.filter(inside(i))
        if again is not None:
            rows = rows.unionAll(df.filter(inside(i - 1) & F.expr(again)))
        rows.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def drained(stream: DataFrame) -> DataFrame:
    """Everything the stream emits until its input is used up, read back from the shared folder."""
    spark = stream.sparkSession
    sink, checkpoint = scratch(spark), scratch(spark)
    finish(stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
           .outputMode("append").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(sink)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()
