"""Loads, listings, questions answered and exports read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import routing as ro
from ..operators import sampling as s
from ..session import scratch
from ..sources import files as fl
from ..sources import sinks as x
from ..sources.binding import table, view
from .registry import SQL, query
from .samples import ENDS, HASH, R, READ, TARGET, _placed, _readings
from . import templates  # noqa: F401  its SQL is used below

LISTED = ("customer", "lineitem", "orders")


@query("schema_listing", sql=f"""
SELECT table_name, column_name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
         WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS data_type,
       is_nullable = 'YES' AS is_nullable, CAST(ordinal_position AS INTEGER) AS ordinal
FROM information_schema.columns WHERE table_name IN {LISTED}""")
def schema_listing(spark, folder):
    return fl.schema_listing({name: table(spark, folder, name) for name in LISTED})


@query("profile_index", sql="""
SELECT 'dac/' || c_nationkey || '/' || c_custkey || '_prof.nc' AS path FROM customer WHERE c_custkey % 5 > 2""")
def profile_index(spark, folder):
    """An index file with comments, blank lines, headers and other files between the profiles."""
    lines = table(spark, folder, "customer").select(F.expr("""
        CASE c_custkey % 5 WHEN 0 THEN concat('# file of ', c_name) WHEN 1 THEN '' WHEN 2 THEN 'file,date,latitude'
             ELSE concat('dac/', c_nationkey, '/', c_custkey, '_prof.nc,20200101,', c_acctbal) END""").alias("value"))
    path = scratch(spark)
    lines.write.text(path)
    return fl.profile_index(spark, path)


@query("sample_recommendation", sql=f"""
SELECT CASE WHEN {TARGET} / count(*) > 0.5 THEN 'random' ELSE 'adaptive' END AS strategy, TRUE AS preserve_recent,
       CAST(greatest(1, least(20, floor(sqrt(count(*) / 100)))) AS INTEGER) AS spatial_bins,
       CAST(greatest(1, least(24, count(*) // 1000)) AS INTEGER) AS temporal_bins, CAST(0.5 AS DOUBLE) AS quality_threshold
FROM measurements""", views="measurements")
def sample_recommendation(spark, folder):
    """What is advised for all measurements."""
    c = s.recommend(_placed(spark, folder), TARGET)
    return spark.createDataFrame([(c.strategy.value, c.preserve_recent, c.spatial_bins, c.temporal_bins, c.quality_threshold)],
                                 "strategy string, preserve_recent boolean, spatial_bins int, temporal_bins int, quality_threshold double")


@query("load_sampled", views="readings", sql=f"""
{R} ORDER BY CASE WHEN id IN ({ENDS}) THEN 0 ELSE 1 END, {HASH}, id LIMIT {TARGET}""", doubles=READ)
def load_sampled(spark, folder):
    """A table that is larger than asked for comes as a sample with its extremes."""
    return s.load_sampled(_readings(spark, folder), TARGET, s.Strategy.RANDOM)


ASKED = "How do temperature and salinity compare across ocean regions?"


@query("ask_regions", sql=SQL["regional_comparison"],
       doubles="avg_temperature avg_salinity avg_oxygen min_depth_m max_depth_m")
def ask_regions(spark, folder):
    """A question in plain words, answered by the query of its intent."""
    intent, answer = ro.ask(spark, ASKED, {"measurements": view(spark, folder, "measurements")})
    assert intent == "regional_comparison"
    return answer


@query("csv_round_trip", views="readings", sql="SELECT id, depth, temperature, salinity, dataset_type FROM readings", doubles=READ)
def csv_round_trip(spark, folder):
    """All readings as compressed text and back."""
    rows, path = _readings(spark, folder), scratch(spark)
    x.write_csv(rows, path, "gzip")
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query("package_rows", views="readings", sql="""
SELECT 'raw' AS part, count(*) AS n, sum(depth) AS depth FROM readings
UNION ALL SELECT 'filtered', count(*), sum(depth) FROM readings WHERE quality_flag = 1""", doubles="depth")
def package_rows(spark, folder):
    """Raw and filtered rows of an export package, read back from its folders."""
    path, rows = scratch(spark), view(spark, folder, "readings").drop("id")
    x.export_package(rows, rows.filter("quality_flag = 1"), path, dt.datetime(2024, 6, 30))
    back = lambda name: spark.read.option("header", True).schema(rows.schema).csv(f"{path}/data/{name}_data").agg(
        F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("depth").alias("depth"))
    return back("raw").unionAll(back("filtered"))


@query("export_metadata", views="readings", sql="""
SELECT 'readings' AS export_type, '2024-06-30T00:00:00' AS export_timestamp, 'CSV' AS format, count(*) AS record_count, 11 AS columns
FROM readings""")
def export_metadata(spark, folder):
    """The record of an export, taken apart again."""
    text = x.export_metadata(view(spark, folder, "readings"), "readings", "CSV", dt.datetime(2024, 6, 30))
    record = F.from_json("value", "export_type string, export_timestamp string, export_details struct<format string, record_count bigint, columns array<string>>")
    return text.select(record.alias("r")).select("r.export_type", "r.export_timestamp", "r.export_details.format", "r.export_details.record_count",
                                                 F.size("r.export_details.columns").alias("columns"))


@query("chat_history", sql="""
SELECT to_json({'timestamp': turn, 'type': 'chat', 'role': role, 'content': text}) AS record FROM conversations""")
def chat_history(spark, folder):
    """Every message as a JSON text."""
    log = table(spark, folder, "conversations").select(F.col("turn").alias("timestamp"), F.lit("chat").alias("type"), "role", F.col("text").alias("content"))
    return x.chat_history(log)
