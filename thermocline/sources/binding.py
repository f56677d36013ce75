"""Floats, profiles and measurements as views over the given star-schema tables.

customer is a float, orders a profile, lineitem a measurement.  One SQL text per view serves Spark and the
SQL check alike; only the table names and the day-number function differ.  None of the views needs a window:
keys are made of the row's own columns, so column pruning and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK_DAY = "datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01')"
_DUCK_DAY = "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))"

_LAT = "CAST((o_custkey * 37) % 121 - 70 AS DOUBLE) + CAST(o_orderkey % 10 AS DOUBLE) / 10e0"
_LON = "CAST((o_custkey * 53) % 361 - 180 AS DOUBLE) + CAST(o_orderkey % 10 AS DOUBLE) / 10e0"

_READINGS = """
       concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
       l_orderkey AS profile_id,
       l_quantity * 40 AS depth,
       l_quantity * 40 * 1.025e0 AS pressure,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 3500e0 - 2 END AS temperature,
       30e0 + l_discount * 100 AS salinity,
       CASE WHEN l_linestatus = 'F' THEN l_tax * 100 END AS oxygen,
       7.5e0 + l_tax * 10 AS ph,
       l_discount * 10 AS chlorophyll,
       CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 4 END AS quality_flag,
       l_linestatus AS dataset_type"""

VIEWS = {
    # a float without its dates: one narrow scan
    "float_cards": """
SELECT c_custkey AS float_id, 5900000 + c_custkey AS wmo_id,
       CASE WHEN c_acctbal >= 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status,
       CAST((c_custkey * 37) % 121 - 70 AS DOUBLE) AS deployment_lat,
       CAST((c_custkey * 53) % 361 - 180 AS DOUBLE) AS deployment_lon
FROM {customer}""",
    "floats": """
SELECT c_custkey AS float_id, 5900000 + c_custkey AS wmo_id,
       CAST(first_date AS DATE) AS deployment_date,
       CAST((c_custkey * 37) % 121 - 70 AS DOUBLE) AS deployment_lat,
       CAST((c_custkey * 53) % 361 - 180 AS DOUBLE) AS deployment_lon,
       CASE WHEN c_acctbal >= 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status,
       CAST(last_date AS DATE) AS last_contact
FROM {customer} LEFT JOIN (
  SELECT o_custkey, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
  FROM {orders} GROUP BY o_custkey) d ON c_custkey = o_custkey""",
    # a profile without its level count: one narrow scan
    "casts": """
SELECT o_orderkey AS profile_id, o_custkey AS float_id,
       CAST(floor({day} / 10e0) AS INT) + 1 AS cycle_number,
       o_orderdate AS profile_date, {lat} AS profile_lat, {lon} AS profile_lon
FROM {orders}""",
    "profiles": """
SELECT o_orderkey AS profile_id, o_custkey AS float_id,
       CAST(floor({day} / 10e0) AS INT) + 1 AS cycle_number,
       o_orderdate AS profile_date, {lat} AS profile_lat, {lon} AS profile_lon,
       CAST(coalesce(levels, 0) AS BIGINT) AS n_levels
FROM {orders} LEFT JOIN (
  SELECT l_orderkey, count(*) AS levels FROM {lineitem} GROUP BY l_orderkey) n ON o_orderkey = l_orderkey""",
    # readings only: everything about a measurement that needs no profile
    "readings": """
SELECT {readings}
FROM {lineitem}""",
    "measurements": """
SELECT {readings},
       o_custkey AS float_id, o_orderdate AS time, {lat} AS lat, {lon} AS lon
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
}

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, straight from Parquet."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of ``VIEWS`` as a DataFrame over the Parquet files in ``folder``."""
    sources = {t: table(spark, folder, t) for t in ("customer", "orders", "lineitem") if "{%s}" % t in VIEWS[name]}
    text = VIEWS[name].replace("{readings}", _READINGS).replace("{lat}", _LAT).replace("{lon}", _LON)
    return spark.sql(text.replace("{day}", _SPARK_DAY), **sources)


def view_sql(name: str) -> str:
    """The same view as text for the SQL check."""
    text = VIEWS[name].replace("{readings}", _READINGS).replace("{lat}", _LAT).replace("{lon}", _LON)
    text = text.replace("{day}", _DUCK_DAY)
    for base in ("customer", "orders", "lineitem"):
        text = text.replace("{%s}" % base, base)
    return text.strip()


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a service log: each user is a service, an ``error`` event a failure."""
    return table(spark, folder, "events").selectExpr(
        "event_id", "ts", "user_id AS service", "event_type", "value"
    )


def chat_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")
