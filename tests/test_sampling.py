import datetime as dt
import hashlib
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermocline.operators import sampling as s
from thermocline.operators.sampling import SamplingConfig, Strategy

AS_OF = dt.datetime(2024, 6, 30)


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    n = 20_000
    depth = np.where(np.arange(n) % 3 == 0, 7.0, r.uniform(0, 2000, n))  # a third of the rows in one stratum
    return spark.createDataFrame(pd.DataFrame({
        "id": np.arange(n), "latitude": r.uniform(-60, 60, n), "longitude": r.uniform(-180, 180, n), "depth": depth,
        "temperature": r.normal(15, 5, n), "salinity": r.normal(35, 2, n), "kind": np.where(np.arange(n) % 50, "a", "b"),
        "date": [pd.Timestamp(AS_OF) - pd.Timedelta(days=int(d)) for d in r.integers(0, 365, n)]})).cache()


def keys(df):
    return sorted(r["id"] for r in df.select("id").collect())


CASES = [
    SamplingConfig(Strategy.RANDOM, 5000), SamplingConfig(Strategy.SYSTEMATIC, 4000),
    SamplingConfig(Strategy.STRATIFIED, 6000), SamplingConfig(Strategy.TEMPORAL, 3000),
    SamplingConfig(Strategy.SPATIAL, 4000, spatial_bins=16), SamplingConfig(Strategy.ADAPTIVE, 5000),
    SamplingConfig(Strategy.IMPORTANCE, 3000, importance_column="temperature"),
]


@pytest.mark.parametrize("c", CASES, ids=lambda c: c.strategy.value)
def test_strategies(table, c):
    got = s.sample(table, c)
    assert got.columns == table.columns
    ids = keys(got)
    assert len(ids) == len(set(ids)) <= c.target_size
    assert set(s.extreme_keys(table, c)) <= set(ids)
    assert keys(s.sample(table.repartition(1), c)) == ids
    score = s.sample_quality(table, got).first()[0]
    assert 0.3 < score <= 1.0
    if c.strategy in (Strategy.RANDOM, Strategy.SYSTEMATIC, Strategy.IMPORTANCE):
        assert len(ids) == c.target_size


def test_strata_quotas(table):
    got = s.sample_stratified(table, SamplingConfig(target_size=2000)).toPandas()
    whole = table.toPandas()
    lo, hi = whole.depth.min(), whole.depth.max()
    number = lambda d: np.maximum(0, np.ceil((d - lo) / ((hi - lo) / 10)) - 1)
    size, drawn = number(whole.depth).value_counts(), number(got.depth).value_counts()
    assert all(drawn[i] == min(200, size[i]) for i in size.index)


@pytest.mark.parametrize("n", [1, 37, 5000, 19_999, 20_000, 30_000])
def test_hash_order_takes_exactly_n(table, n):
    got = table.withColumn("h", s.hash_text("id")).toPandas().sort_values(["h", "id"])["id"][:n]
    assert keys(s.take_by_hash(table, n, "id")) == sorted(got)


def of_strata(whole, divisions):
    """Keys among the smallest hashes of their stratum in any division, in plain pandas."""
    chosen = set()
    for column, quota in divisions:
        for _, rows in whole.dropna(subset=[column]).groupby(column):
            chosen |= set(rows.sort_values(["h", "id"])["id"][:quota])
    return sorted(chosen)


@pytest.mark.parametrize("band", [s.BAND, 0.0, 0.05])
def test_strata_are_cut_exactly(monkeypatch, table, band):
    """With the usual band, and with bands so narrow that they must be widened."""
    monkeypatch.setattr(s, "BAND", band or 1e-9)
    marked = table.withColumns({"a": F.when(F.col("id") % 50 > 0, F.floor(F.col("latitude") / 15).cast("int")), "b": (F.col("id") % 3 == 0).cast("int")})
    whole = marked.withColumn("h", s.hash_text("id")).toPandas()
    for quotas in ((37, 900), (1, 20_000), (5000, 0)):
        got = s.take_by_strata(marked, [(F.col("a"), lambda _: quotas[0]), (F.col("b"), lambda n: quotas[1] // n)], "id")
        assert keys(got) == of_strata(whole, [("a", quotas[0]), ("b", quotas[1] // 2)])
    assert s.take_by_strata(marked.limit(0), [(F.col("a"), lambda _: 5)], "id").count() == 0


def test_importance_prefers_far_values_and_skips_weight_zero(spark, table):
    c = SamplingConfig(Strategy.IMPORTANCE, 3000, importance_column="temperature")
    got, whole = s.sample_importance(table, c).toPandas(), table.toPandas()
    far = lambda t: (t.temperature - whole.temperature.mean()).abs().mean()
    assert len(got) == 3000 and far(got) > 1.3 * far(whole)
    few = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 2.0), (4, 8.0)], "id int, v double")
    assert keys(s.sample_importance(few, SamplingConfig(target_size=3, importance_column="v"))) == [3, 4]
    rare = s.sample_importance(table, SamplingConfig(target_size=800, importance_column="kind")).toPandas()
    assert (rare.kind == "b").mean() > 0.2


def test_small_tables_come_back_whole(spark):
    df = spark.createDataFrame([(i, i * 2, "c") for i in range(5)], "id int, y int, category string")
    assert keys(s.sample(df, SamplingConfig(target_size=10_000))) == [0, 1, 2, 3, 4]
    r = s.sample_report(df, df, SamplingConfig()).first()
    assert (r["sampling_ratio"], r["quality_score"]) == (1.0, pytest.approx(1.0))


def test_extremes_survive_the_cut(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 100, -100])], "id int, value double")
    got = {r["value"] for r in s.sample(df, SamplingConfig(target_size=3)).collect()}
    assert len(got) == 3 and {100.0, -100.0} <= got


def test_recent_rows_survive(spark):
    rows = [(i, i, AS_OF - dt.timedelta(days=i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, value int, date timestamp_ntz")
    got = s.sample(df, SamplingConfig(target_size=20, preserve_recent=True)).toPandas()
    assert len(got) == 20 and (got.value < 10).any()


def test_quality_of_nothing(spark, table):
    assert s.sample_quality(table, table.limit(0)).first()[0] == 0.0
    text = spark.createDataFrame([("a",)], "x string")
    assert s.sample_quality(text, text).first()[0] == 0.5


def test_recommendation(table, spark):
    assert s.recommend(table, 15_000).strategy is Strategy.RANDOM
    c = s.recommend(table, 1000)
    assert (c.strategy, c.spatial_bins, c.temporal_bins, c.preserve_recent) == (Strategy.ADAPTIVE, 14, 20, True)
    pick = lambda *cols: s.recommend(table.select("id", *cols), 1000).strategy
    assert pick("depth", "date") is Strategy.STRATIFIED
    assert pick("date") is Strategy.TEMPORAL
    assert pick("latitude", "longitude") is Strategy.SPATIAL
    assert pick("salinity") is Strategy.SYSTEMATIC
    assert s.recommend(spark.range(500).withColumn("date", F.lit(AS_OF)), 10).temporal_bins == 1


def test_load_sampled(table):
    assert s.load_sampled(table, 50_000).count() == 20_000
    assert s.load_sampled(table, 1000, Strategy.RANDOM).count() == 1000
    assert 0 < s.load_sampled(table, 1000).count() <= 1000


def test_without_the_needed_column(table):
    bare = table.select("id", "salinity")
    c = SamplingConfig(target_size=100)
    want = keys(s.sample_random(bare, c))
    for strategy in (s.sample_stratified, s.sample_temporal, s.sample_spatial, s.sample_adaptive, s.sample_importance):
        assert keys(strategy(bare, c)) == want


def test_thin_lines(table):
    got = s.thin_lines(table, "depth", "temperature", "kind", 300).toPandas()
    whole = table.toPandas()
    for kind, rows in whole.groupby("kind"):
        line = got[got.kind == kind]
        assert len(line) == 300 and line.depth.is_monotonic_increasing
        assert line.temperature.max() == rows.temperature.max() and line.temperature.min() == rows.temperature.min()
    assert s.thin_scatter(table, "depth", "temperature", max_points=500).count() == 500


def test_temporal_bins_of_one(table):
    c = SamplingConfig(target_size=100, temporal_bins=0)
    assert s.sample_temporal(table, c).count() == 100
    assert replace(c, seed=7) != c
    assert keys(s.sample_random(table, replace(c, seed=7))) != keys(s.sample_random(table, c))


def test_frequencies_of_few_categories_are_broadcast(spark, monkeypatch):
    """Joined by category, each would go to one task; with very many the join is shuffled, and the sample is the same."""
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'a' ELSE 'b' END AS kind")
    config = SamplingConfig(target_size=50, importance_column="kind")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drawn = s.sample_importance(rows, config)
        assert "BroadcastHashJoin" in drawn._jdf.queryExecution().toString()
        monkeypatch.setattr(s, "BROADCAST_CATEGORIES", 1)
        shuffled = s.sample_importance(rows, config)
        assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().toString()
        assert sorted(drawn.collect()) == sorted(shuffled.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_procedure_reads_the_table_in_few_passes(spark):
    """Rows and time span in one pass, extremes and recent rows in one job, drawn rows and those of the extremes in one pass."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(3000).select("id", (F.col("id") % 97).cast("double").alias("depth"), F.expr("timestamp_seconds(id * 7919 % 3000)").alias("date"))
    table = rows.mapInArrow(counted, rows.schema)
    c = s.SamplingConfig(target_size=100, preserve_recent=True)
    got = {r["id"] for r in s.sample(table, c).collect()}
    assert read.value == 4 * 3000  # before: 6
    digest = lambda i: (hashlib.md5(f"{i}|42".encode()).hexdigest(), i)
    recent = [i for i in range(3000) if i * 7919 % 3000 >= 2999 - 299.9][:5]
    want = list(dict.fromkeys(sorted({0, 96, 2999, *recent}, key=digest) + sorted(range(3000), key=digest)))[:100]
    assert got == set(want)


def test_hashes_of_many_equal_keys(spark):
    """Keys that repeat share a hash: the band can hold too few rows and is widened."""
    rows = spark.range(50_000).select((F.col("id") % 4).alias("id"), F.col("id").cast("double").alias("depth"))
    near, low = s._near_hash(rows, 60, 50_000, "id", 42, [])
    assert near.filter(low).count() >= 60
    assert s.sample(rows, s.SamplingConfig(target_size=60, preserve_extremes=False)).count() == 1
