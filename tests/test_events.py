import datetime as dt
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermocline.operators import events as e
from thermocline.streaming import activity, failures, intake, replay

NOW = dt.datetime(2024, 6, 30, 12)
SCHEMA = "event_id bigint, ts timestamp_ntz, service string, event_type string, value double"


def log_rows(*events):
    """(minutes before NOW, service, type) in order of arrival."""
    return [(i, NOW - dt.timedelta(minutes=m), s, t, float(i)) for i, (m, s, t) in enumerate(events)]


EVENTS = log_rows((500, "a", "error"), (400, "a", "ok"), (300, "a", "error"), (200, "a", "error"), (100, "b", "error"),
                  (50, "b", "ok"), (3, "c", "error"), (2, "c", "error"), (1, "c", "error"))


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(EVENTS, SCHEMA)


def failed():
    return F.col("event_type") == "error"


def runs(df):
    return {r["service"]: r["consecutive_failures"] for r in df.collect()}


def test_failure_runs(log):
    assert runs(e.failure_runs(log, failed())) == {"a": 2, "b": 0, "c": 3}


def test_status(log, spark):
    status = F.when(failed(), "error").otherwise("connected")
    overall = lambda df: e.overall_status(e.latest_status(df, status)).first()["overall_status"]
    assert overall(log) == "error"
    assert overall(log.filter("service = 'b'")) == "connected"
    assert overall(log.limit(0)) == "unknown"
    down = spark.createDataFrame([("x", "disconnected"), ("y", "disconnected")], "service string, status string")
    assert e.overall_status(down).first()["overall_status"] == "disconnected"
    mixed = down.union(spark.createDataFrame([("z", "error")], "service string, status string"))
    assert e.overall_status(mixed).first()["overall_status"] == "error"


def test_recent(log):
    assert e.recent_events(log, NOW, 2).count() == 5
    r = e.recent_metrics(log, NOW, F.col("event_type") == "ok", F.lit(2)).first()
    assert tuple(r) == (3, 7.0, 0.0, 6, 8.0)
    assert e.recent_metrics(log, NOW + dt.timedelta(days=1), F.lit(True), F.lit(1)).count() == 0
    assert tuple(e.error_summary(log.filter(failed()), NOW, F.col("value") > 6)
                 .first()) == (7, 3, 2)
    assert tuple(e.feedback_summary(log, NOW, F.col("event_type") == "ok").first()) == (9, 4, 3.0)
    assert [r["event_id"] for r in e.newest(log, 2).collect()] == [8, 7]
    h = e.last_events(log, NOW, 24, 2).filter("service = 'a'").orderBy("position").collect()
    assert [(r["event_id"], r["event_count"]) for r in h] == [(3, 4), (2, 4)]


def test_health(log):
    status = F.when(failed(), "error").otherwise("connected")
    r = e.health_rollup(log, NOW, status, failed()).first()
    assert tuple(r) == ("degraded", 2, 3, "Check API connection")
    assert e.health_rollup(log.filter("service = 'b'"), NOW, status, failed()).first()["overall_status"] == "healthy"


@pytest.mark.parametrize("component, kind, message, category, severity", [
    ("api_client", "KeyError", "Read TIMEOUT", "api_connection", "warning"),
    ("data_fetcher", "KeyError", "refused", "api_connection", "error"),
    ("data_manager", "ValueError", "", "data_processing", "warning"),
    ("data_manager", "KeyError", "", "data_processing", "error"),
    ("profile_visualizer", "KeyError", "", "visualization", "warning"),
    ("chat_interface", "KeyError", "", "user_input", "info"),
    ("x", "TimeoutError", "", "network", "warning"), ("x", "TypeError", "", "data_processing", "warning"),
    ("x", "OSError", "", "system", "error"), ("chat_interface", "MemoryError", "", "user_input", "critical")])
def test_severity(spark, component, kind, message, category, severity):
    df = spark.createDataFrame([(component, kind, message)], "component string, error_type string, message string")
    r = e.severity_labels(df).first()
    assert (r["category"], r["severity"]) == (category, severity)


def write(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def follow(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(df, path, name):
    q = df.writeStream.format("parquet").option("checkpointLocation", str(path / f"{name}-cp")).option(
        "path", str(path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(str(path / name))


def test_stream_daily_counts_drop_late_rows(spark, tmp_path):
    day = lambda n, h=1: dt.datetime(2024, 6, n, h)
    write(spark, [(1, day(1), "a", "ok", 1.0), (2, day(2), "a", "ok", 1.0)], tmp_path / "in")
    write(spark, [(3, day(6), "a", "ok", 1.0)], tmp_path / "in")
    drain(activity.daily_counts(follow(spark, tmp_path / "in")), tmp_path, "out")
    write(spark, [(4, day(1), "a", "ok", 1.0), (5, day(9), "a", "ok", 1.0)], tmp_path / "in")  # 4 is too late
    got = drain(activity.daily_counts(follow(spark, tmp_path / "in")), tmp_path, "out")
    rows = {r["date"].day: r["count"] for r in got.collect()}
    assert rows[1] == 1 and rows[2] == 1 and rows[6] == 1 and 9 not in rows
    assert activity.monthly_counts(got).first()["count"] == 3


def test_stream_dedup(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 6, 1, 0, m)
    write(spark, [(1, at(0), "a", "ok", 1.0), (2, at(1), "a", "ok", 1.0), (1, at(2), "a", "ok", 1.0)], tmp_path / "in")
    write(spark, [(2, at(5), "a", "ok", 1.0), (3, at(6), "a", "ok", 1.0)], tmp_path / "in")
    got = drain(activity.deduplicated(follow(spark, tmp_path / "in")), tmp_path, "out")
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3]


def test_stream_recent_metrics(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 6, 1, 0, m)
    write(spark, [(1, at(0), "a", "hit", 2.0), (2, at(3), "a", "miss", 4.0)], tmp_path / "in")
    write(spark, [(3, at(40), "a", "hit", 1.0)], tmp_path / "in")
    metrics = activity.recent_metrics(follow(spark, tmp_path / "in"), F.col("event_type") == "hit", F.lit(1))
    rows = {r["start"]: r for r in drain(metrics, tmp_path, "out").collect()}
    both = rows[at(0)]
    assert (both["operations"], both["avg_time"], both["cache_hit_rate"], both["latest_value"]) == (2, 3.0, 50.0, 4.0)
    assert len([r for r in rows.values() if r["operations"] == 1]) == 6


def follow_failures(spark, path, delay):
    q = failures.run(follow(spark, path / "in"), failed(), str(path / "sink"), str(path / "cp"), delay)
    replay.finish(q)
    return failures.current(spark, str(path / "sink"))


def test_stream_failure_runs(spark, tmp_path, log):
    for i in range(0, len(EVENTS), 2):
        write(spark, EVENTS[i:i + 2], tmp_path / "in")
    got = follow_failures(spark, tmp_path, "365 days")
    assert runs(got) == {"a": 2, "b": 0, "c": 3}
    want = {r["service"]: (r["events"], r["failures"], r["last_event"], r["failing_since"])
            for r in e.failure_runs(log, failed()).collect()}
    assert {r["service"]: (r["events"], r["failures"], r["last_event"], r["failing_since"]) for r in got.collect()} == want


def test_stream_failures_late_and_repeated(spark, tmp_path):
    """Out of order within the delay, delivered twice, and too late; one drain per delivery, so the state goes through the checkpoint."""
    at = lambda m: dt.datetime(2024, 6, 1) + dt.timedelta(minutes=m)
    deliveries = [
        [(1, at(0), "a", "error", 1.0), (2, at(10), "a", "error", 1.0), (3, at(5), "b", "error", 1.0)],
        [(2, at(10), "a", "error", 1.0), (4, at(200), "a", "error", 1.0)],  # 2 again
        [(5, at(500), "c", "ok", 1.0)],  # moves the watermark: a's failures are settled
        [(6, at(20), "a", "ok", 1.0), (7, at(510), "a", "error", 1.0)],  # 6 is too late
        [(8, at(505), "b", "error", 1.0), (9, at(502), "b", "ok", 1.0), (10, at(900), "c", "error", 1.0)],  # 9 comes before 8
        [(11, at(2000), "a", "ok", 1.0), (12, at(2001), "a", "error", 1.0)],
    ]
    seen = []
    for rows in deliveries:
        write(spark, rows, tmp_path / "in")
        got = follow_failures(spark, tmp_path, "60 minutes")
        seen.append({r["service"]: (r["events"], r["consecutive_failures"], r["failing_since"]) for r in got.collect()})
    assert seen[0] == {"a": (2, 2, at(0)), "b": (1, 1, at(5))}
    assert seen[1]["a"] == (3, 3, at(0))
    assert seen[3] == {"a": (4, 4, at(0)), "b": (1, 1, at(5)), "c": (1, 0, None)}
    assert seen[4]["b"] == (3, 1, at(505)) and seen[4]["c"] == (2, 1, at(900))
    assert seen[5]["a"] == (6, 1, at(2001))


def test_failure_state_does_not_grow():
    """Many batches of a service that fails all the time: the state holds what is newer than the watermark."""
    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    runs_ = failures.Runs()
    runs_.state = held = Held()
    for batch in range(200):
        at = [batch * 60_000_000 + i for i in range(50)]
        part = next(failures._reduced(iter([pd.DataFrame({"service": "a", "at": at, "event_id": range(50), "failed": True})])))
        timer = types.SimpleNamespace(getCurrentWatermarkInMs=lambda b=batch: (b - 3) * 60_000)
        row = next(runs_.handleInputRows(("a",), iter([part]), timer)).iloc[0]
        assert row["consecutive_failures"] == 50 * (batch + 1) and row["failing_since"] == 0 and len(held.value[8]) <= 200


def test_stream_intake(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    fields = len(intake.PROFILE_FILE)
    one = lambda seq, cycle, days, lat: (seq, "b'77'", cycle, t0 + dt.timedelta(days=days), lat, 1.0, [1.0, 2.0],
                                         [9.0, None], [35.0, 35.0], None, None, None, None)[:fields]
    write(spark, [one(1, 1, 0, 5.0), one(2, 2, 10, 6.0)], tmp_path / "in", intake.PROFILE_FILE)
    stream = lambda: intake.run(intake.read_profile_files(spark, str(tmp_path / "in")), str(tmp_path / "t"),
                                str(tmp_path / "cp"), dt.date(2024, 6, 30))
    stream().awaitTermination(120)
    write(spark, [one(1, 3, 20, 7.0)], tmp_path / "in", intake.PROFILE_FILE)
    stream().awaitTermination(120)
    m = spark.read.parquet(str(tmp_path / "t/measurements"))
    assert sorted(r["profile_id"] for r in m.collect()) == [1, 2, intake.IDS_OF_A_BATCH + 1]
    want = [("ARGO_77", dt.date(2024, 1, 21), 7.0)]
    rows = lambda: [(r["float_id"], r["deployment_date"], r["deployment_lat"]) for r in intake.current_floats(spark, str(tmp_path / "t")).collect()]
    assert rows() == want
    intake.compact(spark, str(tmp_path / "t"), 1)
    assert rows() == want
    write(spark, [(*one(1, 4, 30, 8.0)[:1], "b'78'", *one(1, 4, 30, 8.0)[2:])], tmp_path / "in", intake.PROFILE_FILE)
    stream().awaitTermination(120)
    assert sorted(rows()) == [*want, ("ARGO_78", dt.date(2024, 1, 31), 8.0)]
    assert spark.read.parquet(str(tmp_path / "t/floats/batch=2")).count() == 1  # what is written follows the batch


def test_services_share_a_state():
    """A call of the state takes all services of a bucket, a missing one among them, through settled failures and late successes."""
    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    g = np.random.default_rng(6)
    runs_ = failures.Runs("bigint")
    runs_.state = Held()
    seen, stands = [], {}
    for batch in range(12):
        rows = pd.DataFrame({"service": pd.array(g.choice([1, 2, 3, None, 5, 6], 9).tolist(), "Int64").astype(object), "at": batch * 100 + g.integers(-90, 100, 9),
                             "event_id": batch * 9 + np.arange(9), "failed": g.random(9) < 0.8})
        rows["service"] = rows["service"].map(lambda x: None if x is pd.NA else x)
        seen.append(rows)
        parts = pd.concat(failures._reduced(iter([rows[:4], rows[4:]])))
        timer = types.SimpleNamespace(getCurrentWatermarkInMs=lambda b=batch: (b * 100 - 150) / 1000)
        (out,) = runs_.handleInputRows((0,), iter([parts]), timer)
        assert len(out) == rows["service"].nunique(dropna=False)
        stands.update({r.service: r for r in out.itertuples()})
    every = pd.concat(seen)
    for service, row in stands.items():
        mine = every[every["service"].isna() if service is None else every["service"] == service].sort_values(["at", "event_id"])
        run = mine[mine["failed"][::-1].cummin()[::-1].to_numpy()]
        assert (row.events, row.failures, row.last_event, row.consecutive_failures) == (len(mine), mine["failed"].sum(), mine["at"].max(), len(run))
        assert row.failing_since is pd.NA if run.empty else row.failing_since == run["at"].min()
    assert len(stands) == 6
