import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermocline.operators import order as o


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, in no order."""
    n = 3000
    g = np.where(np.arange(n) % 3 < 2, 0, np.arange(n) % 17)
    return spark.createDataFrame(pd.DataFrame({"g": g, "v": (np.arange(n) * 7919) % 31, "id": np.arange(n)}).sample(
        frac=1, random_state=1))


def test_rank_is_the_global_position(skewed):
    got = o.with_rank(skewed, ["v", "id"]).toPandas().sort_values(["v", "id"])
    assert list(got["rank"]) == list(range(3000))


def test_group_rank_with_a_hot_group(skewed):
    got = o.with_group_rank(skewed, ["g"], ["v", "id"]).toPandas()
    want = got.sort_values(["g", "v", "id"]).groupby("g").cumcount()
    assert (got["rank"].reindex(want.index) == want).all()


def test_descending_rank(skewed):
    got = o.with_rank(skewed, [F.desc("id")]).toPandas()
    assert (got["rank"] == 2999 - got["id"]).all()


@pytest.mark.parametrize("n, k", [(10, 3), (100, 7), (101, 100), (57, 1), (50, 50), (20, 50)])
def test_decimation_matches_even_spacing(spark, n, k):
    df = spark.range(n)
    want = sorted(set(np.linspace(0, n - 1, k, dtype=int))) if n > k else list(range(n))
    assert sorted(r["id"] for r in o.decimate_even(df, ["id"], k).collect()) == want


def test_pages(spark):
    df = spark.range(25)
    for page, rows, more in ((0, 10, True), (2, 5, False), (3, 0, None)):
        got = o.page_of_rows(df, ["id"], page, 10).collect()
        assert len(got) == rows and {r["has_more"] for r in got} == ({more} if rows else set())
    full = o.page_of_rows(df.filter("id < 20"), ["id"], 1, 10).collect()
    assert {r["has_more"] for r in full} == {True}
    assert {r["has_more"] for r in o.page_of_rows(df.filter("id < 20"), ["id"], 1, 10, total=20).collect()} == {False}
    assert [r["id"] for r in o.page_after(df, "id", 9, 3).collect()] == [10, 11, 12]


def test_pages_and_heads(spark):
    df = spark.range(100)
    assert sorted(r["id"] for r in o.page_of_rows(df, ["id"], 3, 10).collect()) == list(range(30, 40))
    assert sorted(r["id"] for r in o.head_rows(df, ["id"], 8).collect()) == list(range(8))


def test_every_nth(skewed, spark):
    got = [r["id"] for r in o.every_nth(spark.range(103), ["id"], 10).collect()]
    assert sorted(got) == [i * 10 for i in range(10)]
    per = o.every_nth(skewed, ["id"], 50, ["g"]).toPandas()
    whole = skewed.toPandas()
    for g, rows in whole.groupby("g"):
        ids = sorted(rows["id"])
        step = max(1, len(ids) // 50)
        want = ids if len(ids) <= 50 else ids[::step][:50]
        assert sorted(per[per.g == g]["id"]) == want


def test_latest_position(spark):
    t = dt.datetime
    rows = spark.createDataFrame(
        [("a", 1, t(2024, 1, 1), 1.0, 1.0), ("a", 2, t(2024, 2, 1), 2.0, 2.0), ("a", 3, None, 3.0, 3.0),
         ("b", 4, None, 4.0, 4.0), ("c", 5, t(2024, 1, 1), None, 5.0)],
        "float_id string, id bigint, time timestamp_ntz, lat double, lon double")
    got = {r["float_id"]: (r["lat"], r["wmo_id"]) for r in o.latest_positions(rows, "id").collect()}
    assert got == {"a": (2.0, None), "b": (4.0, None)}


def test_trajectories(spark):
    t = dt.datetime
    rows = spark.createDataFrame(
        [("A", 10.0, 75.0, t(2024, 6, 10)), ("A", 10.2, 75.1, t(2024, 6, 20)), ("A", 10.5, 75.3, t(2024, 6, 29)),
         ("B", 15.0, 80.0, t(2024, 6, 15)), ("B", 15.2, 80.1, t(2024, 6, 25)), ("C", 1.0, 1.0, t(2024, 6, 1)),
         ("D", 95.0, 1.0, t(2024, 6, 1)), ("D", 9.0, 1.0, t(2024, 6, 2))],
        "float_id string, lat double, lon double, time timestamp_ntz")
    paths = o.trajectories(rows)
    assert {r["float_id"] for r in paths.collect()} == {"A", "B"}
    ends = {r["float_id"]: (r["start_lat"], r["end_lat"]) for r in o.trajectory_endpoints(paths, ["time"]).collect()}
    assert ends == {"A": (10.0, 10.5), "B": (15.0, 15.2)}
    assert {r["float_id"] for r in o.trajectories(rows, ["B", "C"]).collect()} == {"B"}
    assert o.float_trajectory(rows, ["time"]).count() == 8


def test_first_non_null_per_profile(spark):
    rows = spark.createDataFrame(
        [("A", 1, 1, None, 5.0, 1.0), ("A", 1, 2, 3.0, 6.0, 1.0), ("A", 2, 3, None, 7.0, None)],
        "float_id string, profile_id int, id int, temperature double, lat double, lon double")
    got = o.float_trajectory(rows, ["id"], ("lat", "lon", "temperature")).collect()
    assert [tuple(r) for r in got] == [("A", 1, 5.0, 1.0, 3.0)]


def test_last_per_key_limits_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    got = o.last_per_key(rows, "k", [F.desc("id")], 2)
    assert sorted((r["k"], r["id"]) for r in got.collect()) == [(0, 96), (0, 99), (1, 94), (1, 97), (2, 95), (2, 98)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
