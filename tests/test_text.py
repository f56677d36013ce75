import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermocline.functions import columns as c
from thermocline.operators import retrieval as r
from thermocline.operators import routing as ro
from thermocline.sources import sinks as x

QUESTIONS = [
    ("hello!", "chat", False, "custom"),
    ("What is the average temperature at different depths?", "data", True, "avg_by_depth"),
    ("Compare salinity between northern and southern regions", "data", True, "regional_comparison"),
    ("Show temperature trends over time", "data", True, "temporal_trends"),
    ("Show summary statistics for each float", "data", True, "float_summary"),
    ("pH levels near the surface", "data", True, "depth_ranges"),
    ("Count measurements by month", "data", True, "temporal_trends"),
    ("my phone", "chat", False, "bgc_analysis"),
    ("  Thanks!!  ", "chat", False, "custom"),
    ("", "chat", False, "custom"),
    ("tell me a long story", "data", False, "custom"),
]


def test_routing(spark):
    df = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUESTIONS)], "qid int, text string")
    got = ro.detect_intent(ro.analytical_flag(ro.classify_questions(df))).orderBy("qid").collect()
    assert [(g["text"], g["label"], g["is_analytical"], g["intent"]) for g in got] == QUESTIONS
    assert sum(g["questions"] for g in ro.route_counts(df).collect()) == len(QUESTIONS)


def test_ask(spark, filter_rows):
    tables = {"measurements": filter_rows.withColumn("oxygen", F.lit(1.0))}
    intent, answer = ro.ask(spark, "What is the average temperature at different depths?", tables)
    assert intent == "avg_by_depth" and answer.count() == 5
    assert ro.ask(spark, "hello", tables) == ("custom", None)
    intent, answer = ro.ask(spark, "Show temperature trends over time", tables)
    assert [g["measurement_count"] for g in answer.collect()] == [1, 4]


def test_sql_guard(spark, filter_rows):
    texts = ["SELECT 1", " select a from b", "SELECT created_at FROM t", "DELETE FROM t", "WITH a AS (SELECT 1) SELECT 1"]
    got = ro.sql_guard(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [g["allowed"] for g in got] == [True, True, False, False, False]
    wide = spark.range(1500)
    assert ro.run_sql(spark, "SELECT id FROM wide", {"wide": wide}).count() == 1500
    assert ro.run_sql(spark, "SELECT id FROM wide LIMIT 1200", {"wide": wide}).count() == 1200
    with pytest.raises(ValueError):
        ro.run_sql(spark, "drop table wide", {"wide": wide})


def test_chat_statistics(spark):
    log = spark.createDataFrame([("user", "a"), ("assistant", "b"), ("assistant", "Error"), ("system", "c")],
                                "role string, content string")
    g = ro.chat_statistics(log, F.col("content") == "Error").first()
    assert tuple(g) == (4, 1, 2, 1, 50.0)
    assert ro.chat_statistics(log.limit(0), F.lit(False)).count() == 0


def test_number_text_equals_python(spark):
    random.seed(4)
    for digits in (0, 1, 2, 3):
        values = [random.uniform(-1e4, 1e4) for _ in range(300)]
        values += [(2 * random.randint(-9**6, 9**6) + 1) / (2 * 10**digits) for _ in range(1500)]
        values += [0.0, 0.5, 1.5, 2.5, -0.4, 1e12 + 0.3, 123456789012345680.0, 0.05, 0.005]
        df = spark.createDataFrame([(v, f"{v:9.{digits}f}") for v in values], "v double, want string")
        wrong = df.withColumn("got", c.fixed_text(F.col("v"), digits, 9)).filter("got <> want OR got IS NULL").take(3)
        assert not wrong
    null = spark.range(1).select(c.fixed_text(F.lit(None).cast("double"), 2)).first()[0]
    assert null is None


def test_formats(spark):
    df = spark.createDataFrame([(0.001, "x" * 101), (999.994, "short"), (1234.5, "y"), (None, None)], "v double, t string")
    got = df.select(c.scientific(F.col("v")), c.with_unit(F.col("v"), "depth"), c.with_unit(F.col("v"), "pH"),
                    c.with_unit(F.col("v"), "other"), c.truncated(F.col("t"))).collect()
    assert [g[0] for g in got] == ["1.00e-03", "999.99", "1.23e+03", "N/A"]
    assert [g[1] for g in got] == ["0 m", "1000 m", "1234 m", "N/A"]
    assert [g[2] for g in got] == ["0.00", "999.99", "1234.50", "N/A"]
    assert got[2][3] == "1234.50 "
    assert got[0][4] == "x" * 97 + "..." and got[1][4] == "short"
    parts = spark.createDataFrame([("1", 2.0, 0.0), ("a", None, 1.0)], "s string, a double, b double")
    got = parts.select(c.safe_float(F.col("s")), c.safe_divide(F.col("a"), F.col("b"))).collect()
    assert [tuple(g) for g in got] == [(1.0, 0.0), (None, 0.0)]


@pytest.fixture(scope="module")
def context(spark):
    rows = [("1", 10, "7", dt.datetime(2024, 3, 1, 5), 1.0005, 2.0, 10.0, 15.125, None, 4.0, None, 0.005, 3,
             dt.datetime(2024, 3, 1), 4, 5900007, dt.date(2023, 1, 2))]
    return spark.createDataFrame(
        rows, "id string, profile_id int, float_id string, time timestamp_ntz, lat double, lon double, depth double, "
              "temperature double, salinity double, oxygen double, ph double, chlorophyll double, cycle_number int, "
              "profile_date timestamp_ntz, n_levels int, wmo_id int, deployment_date date")


def test_documents(context):
    text = r.measurement_documents(context).first()["document"]
    assert text == (
        "ARGO float 7 (WMO ID: 5900007) recorded measurements on 2024-03-01 during cycle 3. The float was located at "
        f"latitude {1.0005:.3f}° and longitude 2.000°. At a depth of 10.0 meters, the temperature was {15.125:.2f}°C and "
        "the salinity was not available. The dissolved oxygen was 4.00 ml/L. This measurement was part of a profile with "
        "4 depth levels. The float was deployed on 2023-01-02.")
    meta = json.loads(r.metadata_json(r.measurement_metadata(context)).first()["metadata"])
    assert len(meta) == 18 and "salinity" not in meta
    assert (meta["has_bgc"], meta["date"], meta["latitude"]) == (True, "2024-03-01", 1.0005)


def test_write_documents(context, tmp_path, spark):
    r.write_documents(r.measurement_documents(context), str(tmp_path / "docs"))
    assert [d["id"] for d in spark.read.parquet(str(tmp_path / "docs")).collect()] == ["1"]


@pytest.mark.parametrize("length", [4, 200])
def test_nearest(spark, length):
    g = np.random.default_rng(2)
    v = g.normal(size=(300, length)).round(1)
    v[100:200] = v[5]  # a third are copies
    docs = spark.createDataFrame(pd.DataFrame({"vec_id": range(300), "embedding": [[float(z) for z in row] for row in v]})).repartition(5)
    q = v[5]
    d = ((v - q) ** 2).sum(axis=1)
    want = sorted(range(300), key=lambda i: (round(d[i], 9), i))[:20]
    assert [h["vec_id"] for h in r.vector_topk(docs, list(q)).orderBy("rank").collect()] == want
    asked = spark.createDataFrame([("a", [float(z) for z in q]), ("b", [float(z) for z in v[0]])], "query_id string, vector array<double>")
    batch = r.vector_topk_batch(docs, asked, 20)
    assert [h["vec_id"] for h in batch.filter("query_id = 'a'").orderBy("rank").collect()] == want
    assert batch.filter("query_id = 'b'").count() == 20
    assert r.vector_topk_batch(docs, asked.limit(0)).count() == 0


def test_incomplete_vectors_are_never_neighbours(spark):
    nan = float("nan")
    docs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.5]), (5, [0.0, None]), (6, [nan, 0.0])],
                                 "vec_id long, embedding array<double>")
    assert [h["vec_id"] for h in r.vector_topk(docs, [0.0, 0.0], 2).orderBy("rank").collect()] == [1, 2]
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.4]), (3, None), (4, [None, 1.0])], "query_id long, vector array<double>")
    got = sorted((h["query_id"], h["rank"], h["vec_id"]) for h in r.vector_topk_batch(docs, asked, 2).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 4)]
    assert {(h["vec_id"], h["reason"]) for h in r.rejected_vectors(docs, 2).collect()} == {
        (3, "no vector"), (4, "wrong length"), (5, "missing component"), (6, "missing component")}


def test_many_query_vectors(spark):
    docs = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    asked = spark.range(1500).select(F.col("id").alias("query_id"), F.array((F.col("id") % 60).cast("double")).alias("vector"))
    best = r.vector_topk_batch(docs, asked, 1, block_bytes=4000)
    assert best.count() == 1500 and best.filter("vec_id <> query_id % 60").count() == 0


def test_hits(spark):
    hits = spark.createDataFrame(
        [(1, "7", "2024-01-01", 1.0, 2.0, 10.4, 15.0, None, None), (2, None, None, None, 2.0, None, 17.0, None, 3.0)],
        "rank int, float_id string, date string, latitude double, longitude double, depth double, temperature double, "
        "salinity double, oxygen double")
    lines = [h["line"] for h in r.context_lines(hits).orderBy("rank").collect()]
    assert lines == ["[1] Float=7 | Date=2024-01-01 | Lat=1.00 | Lon=2.00 | Depth=10m | Temp=15.00°C",
                     "[2] | Lon=2.00 | Temp=17.00°C | O2=3.00 ml/L"]
    text = r.statistics_text(r.hit_statistics(hits)).first()[0]
    assert text == "Temperature — avg: 16.00°C, min: 15.00°C, max: 17.00°C (2 readings)"
    assert r.statistics_text(r.hit_statistics(hits.limit(0))).first()[0] == "No numeric data in retrieved results."
    listed = hits.select(F.lit(9).alias("question_id"), "rank", F.col("rank").alias("id"), "float_id")
    assert tuple(ro.retrieval_metadata(listed).first()) == (9, "1,2", "7", 1, 2, False)


def test_ascii_export(filter_rows, spark, tmp_path):
    rows = filter_rows.withColumn("salinity", F.when(F.col("id") != 3, F.col("salinity")))
    ids = spark.createDataFrame([(3,), (1,)], "id bigint")
    lines = [l["value"] for l in x.export_ascii(rows, dt.datetime(2024, 6, 30), ids).collect()]
    assert lines[2] == "# Number of profiles: 2" and lines[5] == "#" + "=" * 70
    assert lines[6:] == ["2024-06-15 00:00:00   15.200   80.100    100.0   22.100      NaN",
                         "2024-06-20 00:00:00   10.500   75.300     10.0   28.500   35.200"]
    x.write_ascii(x.export_ascii(rows, dt.datetime(2024, 6, 30), ids), str(tmp_path / "a"), "gzip")
    assert spark.read.text(str(tmp_path / "a")).count() == 8


def test_other_exports(filter_rows, spark, tmp_path):
    ids = spark.createDataFrame([(2,), (5,), (99,)], "id bigint")
    assert [e["depth"] for e in x.export_rows(filter_rows, ids).collect()] == [500.0, 50.0]
    x.write_csv(x.export_rows(filter_rows), str(tmp_path / "csv"), "gzip")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(x.CSV_COLUMNS)
    x.write_json(filter_rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 5
    x.export_columnar(filter_rows, str(tmp_path / "col"))
    back = spark.read.parquet(str(tmp_path / "col"))
    assert back.schema["temperature"].metadata["units"] == "degree_Celsius" and back.schema["salinity"].metadata["valid_max"] == 50.0
    wide = filter_rows.withColumn("extra", F.lit(1))
    assert x.export_selection(wide).columns == list(x.ESSENTIAL) and x.export_selection(filter_rows) is filter_rows


def test_package(filter_rows, spark, tmp_path):
    x.export_package(filter_rows, filter_rows.filter("id < 3"), str(tmp_path), dt.datetime(2024, 6, 30))
    assert spark.read.option("header", True).csv(str(tmp_path / "data/raw_data")).count() == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "data/filtered_data")).count() == 2
    meta = json.loads(spark.read.text(str(tmp_path / "metadata")).first()[0])
    assert meta["export_details"]["record_count"] == 2
    report = spark.read.option("header", True).csv(str(tmp_path / "reports/quality_report"))
    assert report.filter("section = 'dataset' AND measure = 'records'").first()["value"] == "2.0"
    from thermocline.operators.quality import quality_report
    assert "- id: complete_percentage 100.0%" in [l["value"] for l in x.report_text(quality_report(filter_rows)).collect()]


def test_chat_history(spark):
    log = spark.createDataFrame([("2024", "user", "user", "hi")], "timestamp string, type string, role string, content string")
    assert json.loads(x.chat_history(log).first()["record"])["content"] == "hi"
