import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from thermocline.functions import predicates as p
from thermocline.functions.labels import quality_level
from thermocline.operators import filters as f
from thermocline.operators import regions
from thermocline.operators.filters import Filters

AS_OF = dt.datetime(2024, 6, 30)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("chosen, expected", [
    (Filters(box={"north": 20, "south": 5, "east": 85, "west": 70}), [1, 2, 3, 4]),
    (Filters(depths=(0, 100), temperature=(20, 30), salinity=(34.5, 35.5)), [1, 2, 3]),
    (Filters(float_ids=("ARGO_001", "ARGO_002"), cycles=(40, 70)), [1, 2, 3, 4]),
    (Filters(dates=(dt.date(2024, 6, 15), dt.date(2024, 6, 25))), [1, 2, 3]),
    (Filters(relative_days=15, as_of=AS_OF), [1, 2, 3]),
    (Filters(max_age_days=7, as_of=AS_OF), [2]),
    (Filters(months=(5,), years=(2024,)), [5]),
    (Filters(region="Arabian Sea"), []),
    (Filters(region="Bay of Bengal"), [3, 4]),
    (Filters(circle=(10.5, 75.3, 40.0)), [1, 2]),
    (Filters(depth_text="10, 200"), [1, 4]),
    (Filters(depth_text="10; 200"), [1, 2, 3, 4, 5]),
    (Filters(temperature=(100, 200)), []),
    (Filters(box={"north": 20, "south": 5}), [1, 2, 3, 4, 5]),
    (Filters(), [1, 2, 3, 4, 5]),
])
def test_filters(filter_rows, chosen, expected):
    got = f.apply_filters(filter_rows, chosen)
    assert got.columns == filter_rows.columns
    assert ids(got) == expected


def test_time_of_day_runs_over_midnight(spark):
    rows = spark.createDataFrame([(h, dt.datetime(2024, 1, 1, h)) for h in range(24)], "id bigint, ts timestamp_ntz")
    night = rows.filter(p.time_of_day(F.col("ts"), dt.time(22), dt.time(2)))
    assert ids(night) == [0, 1, 2, 22, 23]
    ahead = rows.filter(p.time_of_day(F.col("ts"), dt.time(0), dt.time(1), "IST"))
    assert ids(ahead) == [19]


def test_funnel_counts_each_step(filter_rows):
    chosen = Filters(box={"north": 20, "south": 5, "east": 85, "west": 70}, depths=(0, 100), temperature=(20, 27))
    rows = f.filter_funnel(filter_rows, chosen).orderBy("step").collect()
    assert [(r["filter"], r["before"], r["after"]) for r in rows] == [
        ("box", 5, 4), ("depth", 4, 3), ("temperature", 3, 2)]


def test_active_groups():
    assert Filters().active_groups() == 0
    assert Filters(relative_days=7, region="Arabian Sea", ph=(7, 8), cycles=(1, 2)).active_groups() == 4
    assert Filters(temperature=(1, 2), salinity=(1, 2)).active_groups() == 1


def test_null_never_passes(spark):
    rows = spark.createDataFrame([(1, None), (2, 15.0)], "id bigint, temperature double")
    assert ids(f.apply_filters(rows, Filters(temperature=(10, 20)))) == [2]


def test_regions_overlap(filter_rows):
    got = f.in_named_regions(filter_rows).groupBy("region").count().collect()
    assert {r["region"]: r["count"] for r in got} == {
        "Indian Ocean": 5, "Bay of Bengal": 2, "Equatorial Indian Ocean": 1}


def test_fleet_and_quality(spark, filter_rows):
    floats = spark.createDataFrame(
        [("ARGO_001", 1, "ACTIVE", dt.date(2024, 6, 25)), ("ARGO_002", 2, "INACTIVE", dt.date(2024, 6, 20)),
         ("ARGO_003", 3, "ACTIVE", dt.date(2023, 1, 1))],
        "float_id string, wmo_id int, status string, last_contact date")
    assert ids(f.by_fleet(filter_rows, floats, active_only=True, recent_days=30, as_of=AS_OF)) == [1, 2]
    wanted = spark.createDataFrame([(2,), (3,)], "wmo_id int")
    assert ids(f.by_fleet(filter_rows, floats, wanted)) == [3, 4, 5]
    holes = filter_rows.withColumn("temperature", F.when(F.col("float_id") != "ARGO_002", F.col("temperature")))
    assert ids(f.by_quality_level(holes, ["Excellent"], ("temperature", "salinity"))) == [1, 2, 5]
    assert ids(f.by_quality_level(holes, ["Poor"], ("temperature", "salinity"))) == [3, 4]
    levels = spark.createDataFrame([(s,) for s in (0.95, 0.85, 0.7, 0.5, 0.49, None)], "s double")
    got = [r[0] for r in levels.select(quality_level(F.col("s"))).collect()]
    assert got == ["Excellent", "Good", "Fair", "Poor", "Unknown", "Unknown"]


def test_pushed_to_the_scan(spark, folder):
    from thermocline.sources.binding import view

    df = f.apply_filters(view(spark, folder, "casts"), Filters(dates=(dt.date(1998, 1, 1), dt.date(1998, 2, 1))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_boxes_of_all_sizes(spark):
    r = random.Random(3)
    boxes = [(i, s + h, s, w + b, w) for i in range(300) for s, w, h, b in [(r.uniform(-80, 60), r.uniform(-170, 150), r.choice([0, 1e-7, 0.5, 9, 60]), r.choice([0, 1e-3, 2, 40, 340]))]]
    boxes += [(900, None, 1.0, 2.0, 3.0), (901, 1.0, 5.0, 2.0, 1.0), (902, 90.0, -90.0, 180.0, -180.0), (903, 10.0, 10.0, 20.0, 20.0)]
    points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(500)] + [(1000, 10.0, 20.0), (1001, None, 3.0), (1002, -80.0, -180.0)]
    points += [(2000 + i, b[2], b[4]) for i, b in enumerate(boxes[:40])]
    got = regions.in_regions(spark.createDataFrame(points, "id long, lat double, lon double"),
                             spark.createDataFrame(boxes, "region long, north double, south double, east double, west double"))
    want = sorted((i, n) for i, lat, lon in points for n, north, south, east, west in boxes
                  if lat is not None and north is not None and south <= lat <= north and west <= lon <= east)
    assert sorted((x["id"], x["region"]) for x in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert regions.in_regions(got.select("id", "lat", "lon"), spark.createDataFrame([], "region long, north double, south double, east double, west double")).count() == 0
