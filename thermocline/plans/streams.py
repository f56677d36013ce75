"""Streams replayed from the given tables until they end; what they emitted is compared with SQL over the whole table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..session import scratch
from ..sources.binding import event_log, table
from ..streaming import activity, failures, intake, replay
from .logs import LOG, _failed, _sized
from .registry import query

AGAIN = "event_id % 3 = 0"  # delivered twice
INTAKE_ROWS = 20_000  # profiles in a file


def _delay(log) -> str:
    """Two slices: deliveries that come a slice late are in time."""
    span = replay.slice_span(log)
    return f"{int(2 * span[1].total_seconds()) + 1 if span else 1} seconds"


@query("stream_daily_counts", sql="""
SELECT date, count FROM (SELECT date_trunc('day', ts) AS date, count(*) AS count FROM events GROUP BY ALL)
WHERE date + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""", dates="date")
def stream_daily_counts(spark, folder):
    """Days that can no longer change when the stream ends."""
    counts = activity.daily_counts(replay.replay(event_log(spark, folder)))
    return replay.drained(counts).withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("stream_dedup", sql="SELECT event_id, ts, user_id AS service, event_type, value FROM events", dates="ts", doubles="value")
def stream_dedup(spark, folder):
    """Every event once, though a third are delivered twice."""
    log = event_log(spark, folder)
    once = activity.deduplicated(replay.replay(log, again=AGAIN), delay=_delay(log))
    return replay.drained(once).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_recent_metrics", sql=r"""
WITH w AS (SELECT *, date_trunc('minute', ts) - INTERVAL 1 MINUTE * unnest(range(5)) AS start,
                  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS size FROM events)
SELECT start, start + INTERVAL 5 MINUTE AS "end", count(*) AS operations, avg(value) AS avg_time,
       count(*) FILTER (WHERE event_type = 'view') * 100e0 / count(*) AS cache_hit_rate, CAST(sum(size) AS BIGINT) AS volume,
       arg_max(value, (ts, event_id)) AS latest_value
FROM w GROUP BY start HAVING start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE""",
       doubles="avg_time cache_hit_rate latest_value", dates="start end")
def stream_recent_metrics(spark, folder):
    """Five minutes, every minute, of the whole log."""
    metrics = activity.recent_metrics(replay.replay(_sized(spark, folder)), F.col("event_type") == "view", F.col("size"))
    return replay.drained(metrics).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_failure_runs", sql=f"""WITH {LOG},
w AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)
             OVER (PARTITION BY service ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS later FROM lg)
SELECT service, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS failures, max(ts) AS last_event,
       count(*) FILTER (WHERE later = 0) AS consecutive_failures, min(ts) FILTER (WHERE later = 0) AS failing_since
FROM w GROUP BY service""", dates="last_event failing_since")
def stream_failure_runs(spark, folder):
    """Where each service stands after the last micro-batch; a third of the events are delivered twice."""
    log = event_log(spark, folder)
    sink = scratch(spark)
    replay.finish(failures.run(replay.replay(log, again=AGAIN), _failed(), sink, scratch(spark), _delay(log)))
    return failures.current(spark, sink)


@query("stream_intake", sql=f"""
WITH n AS (SELECT greatest(3, CAST(ceil(count(*) / {INTAKE_ROWS}.0) AS BIGINT)) AS files, min(vec_id) AS low, max(vec_id) - min(vec_id) + 1 AS width FROM embeddings),
f AS (SELECT vec_id, label, embedding, (vec_id - low) * files // width AS file FROM embeddings, n),
last AS (SELECT label, max(file) AS file FROM f GROUP BY label),
first AS (SELECT label, min(vec_id) AS vec_id FROM f JOIN last USING (label, file) GROUP BY label),
sums AS (SELECT label, count(*) AS profiles, CAST(sum(len([v FOR v IN embedding IF v IS NOT NULL])) AS BIGINT) AS measurements FROM f GROUP BY label)
SELECT 'ARGO_' || label AS float_id, CAST(DATE '2020-01-01' + CAST(vec_id % 1000 AS INTEGER) AS DATE) AS deployment_date,
       CAST(vec_id % 90 AS DOUBLE) AS deployment_lat, profiles, measurements
FROM first JOIN sums USING (label)""", dates="deployment_date")
def stream_intake(spark, folder):
    """Vectors as profiles that arrive in files; floats are read with their newest row, before and after a compaction."""
    vectors = table(spark, folder, "embeddings")
    rows, low, high = vectors.agg(F.count("*"), F.min("vec_id"), F.max("vec_id")).first()
    files = max(3, -(-rows // INTAKE_ROWS))
    arrays = {"pres": "transform(embedding, (v, i) -> CASE WHEN v IS NOT NULL THEN CAST(i AS DOUBLE) END)",
              "temp": "transform(embedding, v -> CAST(v AS DOUBLE))", "psal": "transform(embedding, v -> CAST(v AS DOUBLE))"}
    profiles = vectors.select(
        F.col("vec_id").alias("profile_seq"), F.col("label").cast("string").alias("platform"), F.lit(None).cast("int").alias("cycle"),
        F.expr("CAST(date_add(DATE '2020-01-01', CAST(vec_id % 1000 AS INT)) AS TIMESTAMP_NTZ)").alias("juld"),
        (F.col("vec_id") % 90).cast("double").alias("latitude"), F.lit(0.0).alias("longitude"),
        *[(F.expr(arrays[a]) if a in arrays else F.lit(None).cast("array<double>")).alias(a) for a in intake.ARRAYS], "vec_id")
    inbox, tables, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    follow = lambda: replay.finish(intake.run(intake.read_profile_files(spark, inbox, files_per_batch=1), tables, checkpoint, dt.date(2024, 1, 1)))
    for number in range(files):
        if rows:
            part = profiles.filter(F.expr(f"floor((vec_id - {low}) * {files} / {high - low + 1}) = {number}")).drop("vec_id")
            part.repartition(1).write.mode("append").parquet(inbox)
        if number == files // 2:
            follow()
            intake.compact(spark, tables, 0)
    follow()
    floats = intake.current_floats(spark, tables).select("float_id", "deployment_date", "deployment_lat")
    measured = spark.read.parquet(f"{tables}/measurements").groupBy("profile_id").agg(F.count("*").alias("measurements"))
    sums = spark.read.parquet(f"{tables}/profiles").select("profile_id", "float_id").join(measured, "profile_id", "left").groupBy("float_id").agg(
        F.count("*").alias("profiles"), F.coalesce(F.sum("measurements"), F.lit(0)).alias("measurements"))
    return floats.join(sums, "float_id")
