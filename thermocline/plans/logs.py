"""Event logs: connections, failures, metrics, errors, feedback, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as e
from ..sources.binding import event_log, table
from .registry import query

LOG = "lg AS (SELECT event_id, ts, user_id AS service, event_type, value, props FROM events)"
NOW = "now AS (SELECT max(ts) AS t FROM events)"
STATUS_SQL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'disconnected' ELSE 'connected' END"


def _status():
    return F.when(F.col("event_type") == "error", "error").when(
        F.col("event_type") == "signup", "disconnected").otherwise("connected")


def _failed():
    return F.col("event_type") == "error"


def _sized(spark, folder):
    """The log with the number carried in its JSON field as the size of the operation."""
    return table(spark, folder, "events").select(
        "event_id", "ts", F.col("user_id").alias("service"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("size"))


@query("recent_events", sql=f"WITH {LOG}, {NOW}\nSELECT event_id, ts, service, event_type, value FROM lg, now "
                            "WHERE ts >= t - INTERVAL 24 HOUR")
def recent_events(spark, folder):
    log = event_log(spark, folder)
    return e.recent_events(log, e.latest_time(log))


@query("service_history", sql=f"""WITH {LOG}, {NOW},
r AS (SELECT lg.* EXCLUDE (props), count(*) OVER (PARTITION BY service) AS event_count,
             CAST(row_number() OVER (PARTITION BY service ORDER BY ts DESC, event_id DESC) AS INT) AS position
      FROM lg, now WHERE ts >= t - INTERVAL 240 HOUR)
SELECT * FROM r WHERE position <= 10""")
def service_history(spark, folder):
    log = event_log(spark, folder)
    return e.last_events(log, e.latest_time(log), hours=240)


@query("failure_runs", sql=f"""WITH {LOG},
w AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)
             OVER (PARTITION BY service ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS later FROM lg)
SELECT service, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS failures, max(ts) AS last_event,
       count(*) FILTER (WHERE later = 0) AS consecutive_failures, min(ts) FILTER (WHERE later = 0) AS failing_since
FROM w GROUP BY service""")
def failure_runs(spark, folder):
    return e.failure_runs(event_log(spark, folder), _failed())


@query("overall_status", sql=f"""WITH {LOG},
s AS (SELECT service, arg_max({STATUS_SQL}, (ts, event_id)) AS status FROM lg GROUP BY service),
c AS (SELECT count(*) AS services, count(*) FILTER (WHERE status = 'connected') AS connected,
             count(*) FILTER (WHERE status = 'disconnected') AS disconnected FROM s)
SELECT *, CASE WHEN services = 0 THEN 'unknown' WHEN connected = services THEN 'connected' WHEN connected > 0 THEN 'error'
               WHEN disconnected = services THEN 'disconnected' ELSE 'error' END AS overall_status FROM c""")
def overall_status(spark, folder):
    return e.overall_status(e.latest_status(event_log(spark, folder), _status()))


@query("recent_metrics", sql=f"""WITH {LOG}, {NOW}
SELECT count(*) AS operations, avg(value) AS avg_time,
       count(*) FILTER (WHERE event_type = 'view') * 100e0 / count(*) AS cache_hit_rate,
       CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS volume,
       arg_max(value, (ts, event_id)) AS latest_value
FROM lg, now WHERE ts > t - INTERVAL 5 MINUTE AND ts <= t HAVING count(*) > 0""",
       doubles="avg_time cache_hit_rate latest_value")
def recent_metrics(spark, folder):
    log = _sized(spark, folder)
    return e.recent_metrics(log, e.latest_time(log), F.col("event_type") == "view", F.col("size"))


@query("error_summary", sql=f"""WITH {LOG}, {NOW}
SELECT count(*) AS total_errors, count(*) FILTER (WHERE ts > t - INTERVAL 5 MINUTE AND ts <= t) AS recent_errors,
       count(*) FILTER (WHERE value > 100) AS critical_errors FROM lg, now WHERE event_type = 'error'""")
def error_summary(spark, folder):
    log = event_log(spark, folder)
    return e.error_summary(log.filter(_failed()), e.latest_time(log), F.col("value") > 100)


@query("newest_errors", sql="""
SELECT event_id, ts, user_id AS service, event_type, value FROM events WHERE event_type = 'error'
ORDER BY ts DESC, event_id DESC LIMIT 10""")
def newest_errors(spark, folder):
    return e.newest(event_log(spark, folder).filter(_failed()))


@query("feedback_summary", sql=f"""WITH {LOG}, {NOW}
SELECT count(*) AS total_feedback, count(*) FILTER (WHERE ts > t - INTERVAL 1 HOUR AND ts <= t) AS recent_feedback,
       avg(value) FILTER (WHERE event_type = 'purchase') AS avg_rating FROM lg, now""", doubles="avg_rating")
def feedback_summary(spark, folder):
    log = event_log(spark, folder)
    return e.feedback_summary(log, e.latest_time(log), F.col("event_type") == "purchase")


@query("last_feedback", sql=f"""WITH {LOG}
SELECT event_id, ts, service, event_type, value, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INT) AS place
FROM lg QUALIFY place <= 5""", doubles="value", dates="ts")
def last_feedback(spark, folder):
    """The newest five entries of the whole log."""
    return e.last_feedback(event_log(spark, folder))


COMPONENTS = ("api_client", "data_fetcher", "map_visualization", "statistics_manager", "data_manager", "chat_interface",
              "other")
ERRORS = ("ConnectionError", "ValueError", "MemoryError", "KeyError", "TimeoutError")


def _lookup(number: str, values) -> str:
    """The same number-to-name CASE for both engines."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


NAMED = (
    "event_id",
    f"{_lookup('user_id', COMPONENTS)} AS component",
    f"{_lookup('event_id', ERRORS)} AS error_type",
    "CASE WHEN value > 20 THEN 'Request Timeout' ELSE 'failed' END AS message",
)


@query("severity_labels", sql=f"""
WITH n AS (SELECT {', '.join(NAMED)} FROM events),
c AS (SELECT *, CASE WHEN component IN ('api_client', 'data_fetcher') THEN 'api_connection'
    WHEN component IN ('map_visualization', 'profile_visualizer', 'statistics_manager') THEN 'visualization'
    WHEN component IN ('data_manager', 'data_transformer') THEN 'data_processing'
    WHEN component = 'chat_interface' THEN 'user_input'
    WHEN error_type IN ('ConnectionError', 'TimeoutError') THEN 'network'
    WHEN error_type IN ('ValueError', 'TypeError') THEN 'data_processing' ELSE 'system' END AS category FROM n)
SELECT *, CASE WHEN error_type IN ('SystemError', 'MemoryError') THEN 'critical'
    WHEN category = 'api_connection' THEN CASE WHEN contains(lower(message), 'timeout') THEN 'warning' ELSE 'error' END
    WHEN category = 'data_processing' THEN
      CASE WHEN error_type IN ('ValueError', 'TypeError') THEN 'warning' ELSE 'error' END
    WHEN category IN ('visualization', 'network') THEN 'warning' WHEN category = 'user_input' THEN 'info'
    ELSE 'error' END AS severity FROM c""")
def severity_labels(spark, folder):
    """Every event read as a logged error; component and kind follow from its numbers."""
    return e.severity_labels(table(spark, folder, "events").selectExpr(*NAMED))


@query("daily_activity", sql="""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS date, count(*) AS count FROM events GROUP BY 1""")
def daily_activity(spark, folder):
    return e.daily_activity(event_log(spark, folder))


@query("health_rollup", sql=f"""WITH {LOG}, {NOW},
s AS (SELECT service, arg_max({STATUS_SQL}, (ts, event_id)) AS status FROM lg GROUP BY service),
c AS (SELECT (SELECT count(*) FROM s WHERE status <> 'connected') AS services_down,
             (SELECT count(*) FROM lg, now WHERE event_type = 'error' AND ts > t - INTERVAL 5 MINUTE AND ts <= t)
             AS recent_errors)
SELECT CASE WHEN services_down > 0 OR recent_errors > 5 THEN 'degraded' ELSE 'healthy' END AS overall_status,
       services_down, recent_errors, concat_ws('; ', CASE WHEN services_down > 0 THEN 'Check API connection' END,
       CASE WHEN recent_errors > 5 THEN 'High error rate detected' END) AS recommendations FROM c""")
def health_rollup(spark, folder):
    log = event_log(spark, folder)
    return e.health_rollup(log, e.latest_time(log), _status(), _failed())


@query("operation_totals", sql=f"""WITH {LOG}
SELECT event_type AS operation, count(*) AS runs, avg(value) AS avg_time,
       CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS records_processed
FROM lg GROUP BY event_type""", doubles="avg_time")
def operation_totals(spark, folder):
    return e.operation_totals(_sized(spark, folder), F.col("size"))
