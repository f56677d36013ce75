import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermocline.operators import analytics as a
from thermocline.operators import quality as k
from thermocline.operators.quantiles import quantiles

AS_OF = dt.datetime(2024, 6, 30)


@pytest.fixture(scope="module")
def table():
    r = np.random.default_rng(7)
    n = 100
    return pd.DataFrame({
        "float_id": [f"ARGO_{i % 3:03d}" for i in range(n)], "profile_id": np.arange(1, n + 1),
        "latitude": r.uniform(-60, 60, n), "longitude": r.uniform(-180, 180, n), "depth": r.uniform(0, 2000, n),
        "temperature": r.normal(15, 5, n), "salinity": r.normal(35, 2, n), "pressure": r.uniform(0, 2000, n),
        "quality_flag": r.choice([1, 2, 3, 4, 9], n, p=[.6, .2, .1, .05, .05]),
        "date": [pd.Timestamp(AS_OF) - pd.Timedelta(days=i) for i in range(n)]})


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def flags(spark, **counts):
    rows = [(int(f[1:]),) for f, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "quality_flag int")


def test_dataset_summary(spark, table):
    r = one(a.dataset_summary(spark.createDataFrame(table)))
    assert (r["total_floats"], r["total_profiles"], r["total_measurements"], r["span_days"]) == (3, 100, 100, 99)
    assert r["lat_span"] == pytest.approx(table.latitude.max() - table.latitude.min())
    assert r["good_data_percentage"] == pytest.approx(table.quality_flag.isin([1, 2]).mean() * 100)


def test_dataset_summary_of_little(spark):
    r = one(a.dataset_summary(spark.createDataFrame([(1.0,)], "temperature double")))
    assert (r["total_floats"], r["total_profiles"], r["lat_min"], r["start"]) == (0, 1, None, None)
    assert a.dataset_summary(spark.createDataFrame([], "temperature double")).count() == 0


def test_parameter_statistics(spark, table):
    rows = a.parameter_statistics(spark.createDataFrame(table), ["temperature", "salinity", "gone"]).collect()
    assert sorted(r["parameter"] for r in rows) == ["salinity", "temperature"]
    for r in rows:
        v = table[r["parameter"]]
        assert r["count"] == 100
        for name, want in (("mean", v.mean()), ("median", v.median()), ("std", v.std()), ("q25", v.quantile(.25)),
                           ("q75", v.quantile(.75)), ("range", v.max() - v.min()),
                           ("coefficient_of_variation", v.std() / v.mean())):
            assert r[name] == pytest.approx(want), name


def test_statistics_without_values(spark):
    df = spark.createDataFrame([(None, 0.0), (None, 0.0)], "a double, b double")
    rows = a.parameter_statistics(df, ["a", "b"]).collect()
    assert [(r["parameter"], r["coefficient_of_variation"]) for r in rows] == [("b", 0.0)]


@pytest.mark.parametrize("case", ["even", "hot", "tail", "few"])
def test_bracketed_quantiles(spark, case):
    r = np.random.default_rng(3)
    v = {"even": r.uniform(0, 1, 5001), "hot": np.where(np.arange(6000) % 3 == 0, 5.0, r.normal(5, 3, 6000)),
         "tail": r.exponential(1, 4000) ** 6, "few": r.integers(0, 4, 3000).astype(float)}[case]
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(v)) % 2, "v": v}))
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    names = [f"p{i}" for i in range(len(probs))]
    for row in quantiles(df, ["v"], probs, names, by=["g"], accuracy=200).collect():
        want = np.quantile(v[np.arange(len(v)) % 2 == row["g"]], probs)
        assert [row[n] for n in names] == pytest.approx(list(want))
    narrowed = quantiles(df, ["v"], probs, names, accuracy=50, inside=20).first()
    assert [narrowed[n] for n in names] == pytest.approx(list(np.quantile(v, probs)))


def test_missing(spark):
    df = spark.createDataFrame(
        [(15.0, 35.0, 10.0), (None, 36.0, 11.0), (16.0, None, 12.0), (None, None, 13.0), (17.0, 37.0, 14.0)],
        "temperature double, salinity double, pressure double")
    got = {r["column"]: (r["missing_count"], r["missing_percentage"]) for r in k.missing_by_column(df).collect()}
    assert got == {"temperature": (2, 40.0), "salinity": (2, 40.0), "pressure": (0, 0.0)}
    assert {r["column"]: r["complete_percentage"] for r in k.completeness(df).collect()}["salinity"] == 60.0


def test_outliers(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"temperature": np.r_[r.normal(15, 1, 95), 50, -10, 100, -50, 200], "salinity": r.normal(35, 1, 100),
                        "depth": np.r_[np.zeros(99), 10000]})
    got = {x["column"]: x for x in k.iqr_outliers(spark.createDataFrame(pdf)).collect()}
    assert "depth" not in got
    q1, q3 = pdf.temperature.quantile([.25, .75])
    out = ((pdf.temperature < q1 - 1.5 * (q3 - q1)) | (pdf.temperature > q3 + 1.5 * (q3 - q1))).sum()
    assert got["temperature"]["outlier_count"] == out >= 5
    assert got["temperature"]["outlier_percentage"] >= 5


@pytest.mark.parametrize("counts, score", [
    ({"f1": 90, "f4": 10}, 5), ({"f1": 75, "f4": 25}, 3), ({"f1": 50, "f4": 50}, 1), ({"f2": 60, "f9": 40}, 2)])
def test_score(spark, counts, score):
    assert one(k.quality_score(flags(spark, **counts)))["overall_score"] == score


def test_score_without_flags(spark):
    assert one(k.quality_score(spark.createDataFrame([(1,)], "x int")))["overall_score"] == 0
    assert one(k.quality_score(spark.createDataFrame([], "quality_flag int")))["overall_score"] == 0


def test_issues(spark):
    rows = {tuple(r) for r in k.quality_issues(flags(spark, f1=50, f4=25, f9=25)).collect()}
    assert rows == {
        ("issue", "High percentage of bad data: 25.0%"), ("issue", "High percentage of missing values: 25.0%"),
        ("recommendation", "Consider filtering out bad quality data before analysis")}
    fine = k.quality_issues(flags(spark, f1=100)).collect()
    assert [tuple(r) for r in fine] == [("recommendation", "Data quality appears good for analysis")]


def test_table_quality(spark, table):
    r = one(k.table_quality(spark.createDataFrame(table)))
    assert (r["status"], r["missing_percentage"], r["total_records"]) == ("excellent", 0.0, 100)
    empty = one(k.table_quality(spark.createDataFrame([], "temperature double")))
    assert (empty["status"], empty["score"]) == ("no_data", 0.0)
    half = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    r = one(k.table_quality(half))
    assert (r["status"], r["issues"]) == ("poor", "Moderate missing data: 50.0%")
    assert r["score"] == pytest.approx(0.4)


def test_extra_checks(spark, filter_rows):
    worse = filter_rows.union(filter_rows.filter("id = 1")).withColumn(
        "lat", F.when(F.col("id") == 2, 95.0).otherwise(F.col("lat"))).withColumn(
        "temperature", F.when(F.col("id") == 3, 41.0).otherwise(F.col("temperature")))
    assert tuple(one(k.extra_checks(worse, AS_OF.replace(month=6, day=24)))) == (1, 1, 1, 1)


def test_flag_distribution_and_result_summary(spark):
    df = flags(spark, f1=3, f9=1).union(spark.createDataFrame([(77,)], "quality_flag int"))
    got = [tuple(r) for r in a.flag_distribution(df).orderBy("quality_flag").collect()]
    assert got == [(1, 3, "Good data"), (9, 1, "Missing value"), (77, 1, "Unknown")]
    r = a.result_summary(spark.createDataFrame([(1, None, "x"), (3, None, "y")], "a int, b double, c string")).collect()
    assert [(x["column"], x["mean"], x["count"], x["has_nulls"]) for x in r] == [("a", 2.0, 2, True), ("b", None, 0, True)]


def test_nothing_is_cut_by_default(spark):
    months = spark.range(150).select(F.add_months(F.lit("2000-01-15"), F.col("id").cast("int")).cast("timestamp").alias("time"),
                                     F.col("id").cast("double").alias("depth"), F.lit(1.0).alias("temperature"), F.lit(2.0).alias("salinity"))
    assert a.temporal_trends(months).count() == a.avg_by_depth(months).count() == 150 and a.temporal_trends(months, 3).count() == 3
    wide = spark.range(2).select(*(F.col("id").alias(f"c{i}") for i in range(7)))
    assert a.result_summary(wide).count() == 7


def test_parameter_columns(spark, table):
    assert a.parameter_columns(spark.createDataFrame(table)) == ["temperature", "salinity", "pressure", "quality_flag"]


def test_system_statistics_and_audit(spark, filter_rows):
    floats = spark.createDataFrame([("ARGO_001",), ("ARGO_002",), ("ARGO_002",)], "float_id string")
    profiles = spark.createDataFrame([(1, "ARGO_001"), (2, "ARGO_009")], "profile_id bigint, float_id string")
    m = filter_rows.withColumn("profile_id", F.col("id"))
    r = one(a.system_statistics(floats, profiles, m))
    assert (r["active_floats"], r["total_profiles"], r["total_measurements"], r["avg_temperature"], r["data_quality"]) == (
        2, 2, 5, 21.52, 95.0)
    audit = {x["rule"]: x["violations"] for x in a.key_audit(floats, profiles, m).collect()}
    assert audit == {"duplicate float_id": 1, "duplicate profile_id": 0, "duplicate measurement id": 0,
                     "profile without float": 1, "measurement without profile": 3}
