import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from thermocline.sources import files, grids, profiles
from thermocline.streaming.intake import PROFILE_FILE

NAN = float("nan")
T0 = dt.datetime(2024, 1, 1)


def raw(spark, rows):
    schema = "file_seq string, profile_seq bigint, platform string, cycle int, juld timestamp_ntz, latitude double, " \
             "longitude double, pres array<double>, temp array<double>, psal array<double>, doxy array<double>"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def files_of_profiles(spark):
    return raw(spark, [
        ("f1", 1, " b'2901' ", 7, T0, 1.0, 2.0, [1.0, 2.0, NAN], [20.0, None, 18.0], [35.0, 35.1, 35.2], [5.0, 5.0, 5.0]),
        ("f1", 2, " b'2901' ", 8, T0 + dt.timedelta(days=10), 1.5, 2.5, [3.0], [19.0], [34.0], [NAN]),
        ("f2", 1, "b'2901'", 9, T0 + dt.timedelta(days=20), 3.0, 4.0, [5.0], [10.0], [34.5], [None]),
        ("f2", 2, "", 1, None, None, None, [1.0], [1.0], [1.0], [1.0]),
        ("f2", 3, "bb'", None, None, 0.0, 0.0, None, None, None, None),
        ("f2", 4, "XYZ", 2, T0, 0.0, 0.0, [], [], [], []),
    ])


def test_profile_tables(files_of_profiles):
    t = profiles.profile_tables(files_of_profiles, dt.date(2024, 6, 30), first_id=100)
    floats = {r["float_id"]: r for r in t["floats"].collect()}
    assert set(floats) == {"ARGO_2901", "ARGO_UNKNOWN", "ARGO_XYZ"}
    f = floats["ARGO_2901"]  # the last file wins, in it the first profile
    assert (f["wmo_id"], f["deployment_date"], f["deployment_lat"]) == (2901, dt.date(2024, 1, 21), 3.0)
    assert floats["ARGO_UNKNOWN"]["deployment_date"] == dt.date(2024, 6, 30)
    assert floats["ARGO_XYZ"]["wmo_id"] is None
    casts = {r["profile_id"]: (r["cycle_number"], r["n_levels"]) for r in t["profiles"].collect()}
    assert casts == {100: (7, 2), 101: (8, 1), 102: (9, 1), 103: (1, 1), 104: (3, 0), 105: (2, 0)}
    m = [(r["profile_id"], r["level"], r["depth"], r["oxygen"], r["ph"]) for r in
         t["measurements"].orderBy("profile_id", "level").collect()]
    assert m == [(100, 0, 1.0, 5.0, None), (101, 0, 3.0, None, None), (102, 0, 5.0, None, None), (103, 0, 1.0, 1.0, None)]
    assert [r["reason"] for r in t["rejects"].collect()] == ["no levels"]


def test_stand_in_is_chosen_by_presence(spark):
    base = "profile_id int, PRES array<double>, TEMP array<double>, PSAL array<double>"
    carried = ("profile_id",)
    row = [(1, [1.0], [2.0], [3.0], [0.5])]
    adjusted = spark.createDataFrame(row, base + ", CHLA_ADJUSTED array<double>")
    assert profiles.explode_profiles(adjusted, carried).first()["chlorophyll"] == 0.5
    both = adjusted.withColumn("CHLA", F.array(F.lit(None).cast("double")))
    assert profiles.explode_profiles(both, carried).first()["chlorophyll"] is None
    assert profiles.explode_profiles(adjusted.drop("TEMP"), carried).count() == 0


def test_index_and_listing(spark, tmp_path):
    index = tmp_path / "index.txt"
    index.write_text("# title\n# more\nfile,date\n\n a/1_Sprof.nc ,2020\nb/2.txt,2020\nb/3_Sprof.nc,2021\n")
    found = files.profile_index(spark, str(index))
    assert sorted(r["path"] for r in found.collect()) == ["a/1_Sprof.nc", "b/3_Sprof.nc"]
    index.write_text("# nothing\nfile\n")
    with pytest.raises(ValueError):
        files.profile_index(spark, str(index))
    for name in ("x/a_Sprof.nc", "x/y/b_Sprof.nc", "x/c.nc"):
        path = tmp_path / "snap" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12")
    listed = [r["path"].rsplit("/", 1)[1] for r in files.snapshot_listing(spark, str(tmp_path / "snap")).collect()]
    assert listed == ["a_Sprof.nc", "b_Sprof.nc"]
    with pytest.raises(ValueError):
        files.snapshot_listing(spark, str(tmp_path / "snap"), "*.zip")


def test_staged_copies_are_removed(spark):
    from thermocline.session import release, shared_folder, staged

    folder = f"{shared_folder(spark)}/staged"
    assert staged(spark.range(10)).count() == 10 and os.listdir(folder.removeprefix("file:"))
    release(spark)
    assert not os.path.exists(folder.removeprefix("file:")) or not os.listdir(folder.removeprefix("file:"))


def test_seeded_files(spark):
    many = spark.range(500).select(F.format_string("f%03d.nc", "id").alias("path"))
    pick = lambda df, n: sorted(r["path"] for r in files.seeded_files(df, n).collect())
    assert len(pick(many, 250)) == 250 and pick(many, 20) == pick(many.repartition(7), 20)
    assert len(pick(many, 0)) == 500 and len(pick(many.limit(10), 250)) == 10


def test_normalise(spark):
    df = spark.createDataFrame([("1.5", "x", "2024-01-02", NAN)], "lat string, lon string, time string, depth double")
    r = files.normalise_columns(df).first()
    assert (r["lat"], r["latitude"], r["longitude"], r["depth"]) == (1.5, 1.5, None, None)
    assert r["date"] == r["time"] == dt.datetime(2024, 1, 2)
    kept = spark.createDataFrame([(1.0, 2.0)], "lat double, latitude double")
    assert files.normalise_columns(kept).first()["latitude"] == 2.0


def test_schema_listing(spark):
    got = files.schema_listing({"b": spark.range(1), "a": spark.createDataFrame([], "x string, y double")}).collect()
    assert [(r["table_name"], r["column_name"], r["ordinal"]) for r in got] == [("a", "x", 1), ("a", "y", 2), ("b", "id", 1)]


def test_rebuild_and_append(spark, filter_rows, tmp_path):
    tables = {"floats": spark.createDataFrame([("a",)], "float_id string"), "measurements": filter_rows}
    files.rebuild_tables(tables, str(tmp_path))
    files.rebuild_tables(tables, str(tmp_path))
    files.append_tables({"measurements": filter_rows.filter("id = 1")}, str(tmp_path))
    back = files.read_table(spark, str(tmp_path / "measurements"))
    assert back.count() == 6 and {r["month"] for r in back.select("month").distinct().collect()} == {"2024-05", "2024-06"}
    assert files.read_table(spark, str(tmp_path / "floats")).count() == 1


def test_months_are_sized_by_the_engine(spark, tmp_path):
    """A month with nearly all rows becomes several files; a repeated load replaces its months only."""
    at = F.when(F.col("id") % 100 < 97, F.lit("2024-03-05")).otherwise(F.concat(F.lit("2024-0"), F.col("id") % 100 - 92, F.lit("-01")))
    rows = spark.range(200_000).select("id", at.cast("timestamp_ntz").alias("time"), F.md5(F.col("id").cast("string")).alias("noise"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        files.write_table(rows, str(tmp_path / "t"), by_month="time", sort=("id",))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    number = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").glob("month=*")}
    assert number["month=2024-03"] > 3 and len(number) == 4
    files.write_table(rows.filter("time = '2024-05-01'").limit(7), str(tmp_path / "t"), "replace", by_month="time")
    back = {r["month"]: r["count"] for r in files.read_table(spark, str(tmp_path / "t")).groupBy("month").count().collect()}
    assert back == {"2024-03": 194_000, "2024-05": 7, "2024-06": 2000, "2024-07": 2000}


def grid(spark):
    slab = lambda base: [[[base, base + 1], [base + 2, base + 3]], [[base + 4, None], [base + 6, base + 7]]]
    return spark.createDataFrame(
        [(T0, [0.0, 10.0], [-5.0, 5.0], [60.0, 61.0], slab(0.0), slab(100.0)),
         (T0 + dt.timedelta(days=30), [0.0, 10.0], [-5.0, 5.0], [60.0, 61.0], slab(10.0), slab(200.0))],
        "TAXIS timestamp_ntz, ZAX array<double>, YAXIS array<double>, XAXIS array<double>, "
        "TEMP array<array<array<double>>>, SAL array<array<array<double>>>")


def test_grid_to_tables(spark):
    cells = grids.grid_to_rows(grid(spark))
    assert cells.count() == 16
    r = cells.filter("depth = 10 AND lat = 5 AND lon = 61").orderBy("time").collect()
    assert [(x["temperature"], x["salinity"]) for x in r] == [(7.0, 107.0), (17.0, 207.0)]
    rows = grids.drop_incomplete(cells)
    assert rows.count() == 14
    floats = grids.virtual_floats(rows)
    got = [(r["float_id"], r["wmo_id"], r["deployment_lat"], r["deployment_lon"]) for r in floats.orderBy("float_id").collect()]
    assert got == [("ARGO_0001", 5900001, -5.0, 60.0), ("ARGO_0002", 5900002, -5.0, 61.0),
                   ("ARGO_0003", 5900003, 5.0, 60.0), ("ARGO_0004", 5900004, 5.0, 61.0)]
    casts = grids.virtual_profiles(rows, floats)
    got = [(r["profile_id"], r["float_id"], r["cycle_number"], r["n_levels"]) for r in casts.orderBy("profile_id").collect()]
    assert got == [(1, "ARGO_0001", 1, 2), (2, "ARGO_0001", 2, 2), (3, "ARGO_0002", 1, 1), (4, "ARGO_0002", 2, 1),
                   (5, "ARGO_0003", 1, 2), (6, "ARGO_0003", 2, 2), (7, "ARGO_0004", 1, 2), (8, "ARGO_0004", 2, 2)]
    m = grids.virtual_measurements(rows, casts)
    assert m.count() == 14 and m.filter("pressure <> depth * 1.025 OR nitrate IS NOT NULL").count() == 0
    first = grids.virtual_floats(rows, 2)
    assert grids.virtual_measurements(rows, grids.virtual_profiles(rows, first)).count() == 6


def test_grid_subset(spark):
    rows = spark.range(100).select(
        F.expr("timestamp_ntz'2020-01-01' + make_interval(0,0,0,id)").alias("time"), F.lit(55.0).alias("lon"),
        F.when(F.col("id") % 2 == 0, 0.0).otherwise(31.0).alias("lat"))
    assert grids.grid_subset(rows).count() == 30
    assert grids.grid_subset(rows.limit(0)).count() == 0


def test_bgc_presence(spark):
    four = spark.createDataFrame([(None, 1.0, 1.0, 1.0)], "oxygen double, ph double, chlorophyll double, nitrate double")
    assert profiles.bgc_presence(four).first()[0] is False
    assert profiles.bgc_presence(four.withColumn("oxygen", F.lit(1.0))).first()[0] is True
    assert profiles.bgc_presence(four.drop("nitrate")).first()[0] is False
    assert PROFILE_FILE["pres"].dataType.simpleString() == "array<double>"
