"""Samples by every strategy, what is kept on purpose, thinning for plots, fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import order as o
from ..operators import sampling as s
from ..sources.binding import view
from .registry import query

TARGET = 5000
HASH = "md5(concat_ws('|', id, '42'))"
READ = "depth temperature salinity"


def _readings(spark, folder):
    return view(spark, folder, "readings").select("id", "depth", "temperature", "salinity", "dataset_type")


def _placed(spark, folder):
    """Measurements with place and time; each pass of a sample reads the columns it needs."""
    return view(spark, folder, "measurements").select(
        "id", "depth", "temperature", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.col("time").alias("date"))


R = "SELECT id, depth, temperature, salinity, dataset_type FROM readings"
M = "SELECT id, depth, temperature, lat AS latitude, lon AS longitude, time AS date FROM measurements"
PLACED = "depth temperature latitude longitude"


@query("sample_random", views="readings", sql=f"{R} ORDER BY {HASH}, id LIMIT {TARGET}", doubles=READ)
def sample_random(spark, folder):
    return s.sample_random(_readings(spark, folder), s.SamplingConfig(target_size=TARGET))


@query("sample_systematic", views="readings", sql=f"""
SELECT id, depth, temperature, salinity, dataset_type FROM (
  SELECT *, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () // {TARGET} AS step FROM readings)
WHERE r % step = 0 AND r < step * {TARGET}""", doubles=READ)
def sample_systematic(spark, folder):
    return s.sample_systematic(_readings(spark, folder), s.SamplingConfig(target_size=TARGET))


STRATUM = """greatest(0, least(9, CAST(ceil((depth - lo) / ((hi - lo) / 10e0)) AS INT) - 1))"""


@query("sample_stratified", views="readings", sql=f"""
SELECT id, depth, temperature, salinity, dataset_type
FROM readings, (SELECT min(depth) AS lo, max(depth) AS hi FROM readings)
QUALIFY row_number() OVER (PARTITION BY {STRATUM} ORDER BY {HASH}, id) <= {TARGET // 10}""", doubles=READ)
def sample_stratified(spark, folder):
    return s.sample_stratified(_readings(spark, folder), s.SamplingConfig(target_size=TARGET))


TIME_BIN = """greatest(0, least(11, CAST(floor((epoch(time) - lo) / ((hi - lo) / 12e0)) AS INT)))"""
TIMES = "(SELECT min(epoch(time)) AS lo, max(epoch(time)) AS hi FROM measurements)"


@query("sample_temporal", views="measurements", sql=f"""
SELECT id, depth, temperature, lat AS latitude, lon AS longitude, time AS date FROM measurements, {TIMES}
QUALIFY row_number() OVER (PARTITION BY {TIME_BIN} ORDER BY {HASH}, id) <= {TARGET // 12}""", doubles=PLACED)
def sample_temporal(spark, folder):
    return s.sample_temporal(_placed(spark, folder), s.SamplingConfig(target_size=TARGET))


BOX = "(SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM measurements)"
CELL = """greatest(0, least(3, CAST(ceil((lat - s) / ((n - s) / 4e0)) AS INT) - 1)) * 4
  + greatest(0, least(3, CAST(ceil((lon - w) / ((e - w) / 4e0)) AS INT) - 1))"""


def _spatial_sql(target: int) -> str:
    return f"""SELECT id, depth, temperature, lat AS latitude, lon AS longitude, time AS date
FROM (SELECT *, {CELL} AS cell FROM measurements, {BOX}),
     (SELECT count(DISTINCT cell) AS cells FROM (SELECT {CELL} AS cell FROM measurements, {BOX}))
QUALIFY row_number() OVER (PARTITION BY cell ORDER BY {HASH}, id) <= greatest(1, {target} // cells)"""


@query("sample_spatial", views="measurements", sql=_spatial_sql(TARGET), doubles=PLACED)
def sample_spatial(spark, folder):
    return s.sample_spatial(_placed(spark, folder), s.SamplingConfig(target_size=TARGET, spatial_bins=16))


@query("sample_adaptive", views="measurements", sql=f"""
SELECT * FROM (({_spatial_sql(TARGET // 2)}) UNION
(SELECT id, depth, temperature, lat AS latitude, lon AS longitude, time AS date FROM measurements, {TIMES}
 QUALIFY row_number() OVER (PARTITION BY {TIME_BIN} ORDER BY {HASH}, id) <= {TARGET // 2 // 12}))
ORDER BY {HASH}, id LIMIT {TARGET}""", doubles=PLACED)
def sample_adaptive(spark, folder):
    return s.sample_adaptive(_placed(spark, folder), s.SamplingConfig(target_size=TARGET, spatial_bins=16))


@query("sample_importance", views="readings", sql=f"""
SELECT id, depth, temperature, salinity, dataset_type FROM (
  SELECT *, abs(temperature - (SELECT avg(temperature) FROM readings)) AS w,
         (CAST('0x' || substr({HASH}, 1, 13) AS BIGINT) + 1) / 4503599627370496e0 AS u FROM readings)
WHERE w > 0 ORDER BY -ln(u) / w, id LIMIT {TARGET}""", doubles=READ)
def sample_importance(spark, folder):
    return s.sample_importance(_readings(spark, folder),
                               s.SamplingConfig(target_size=TARGET, importance_column="temperature"))


@query("sample_importance_category", views="readings", sql=f"""
SELECT id, depth, temperature, salinity, dataset_type FROM (
  SELECT *, 1e0 / count(*) OVER (PARTITION BY dataset_type) AS w,
         (CAST('0x' || substr({HASH}, 1, 13) AS BIGINT) + 1) / 4503599627370496e0 AS u FROM readings)
ORDER BY -ln(u) / w, id LIMIT {TARGET}""", doubles=READ)
def sample_importance_category(spark, folder):
    return s.sample_importance(_readings(spark, folder),
                               s.SamplingConfig(target_size=TARGET, importance_column="dataset_type"))


ENDS = "\nUNION ".join(
    f"(SELECT id FROM readings WHERE {c} IS NOT NULL ORDER BY {c} {way}, id LIMIT 1)"
    for c in ("depth", "temperature", "salinity") for way in ("ASC", "DESC"))


@query("preserve_extremes", views="readings", sql=f"{R} WHERE id IN ({ENDS})", doubles=READ)
def preserve_extremes(spark, folder):
    return s.preserve_extremes(_readings(spark, folder), s.SamplingConfig(target_size=TARGET))


@query("preserve_recent", views="measurements", sql=f"""
SELECT id, depth, temperature, lat AS latitude, lon AS longitude, time AS date FROM measurements, {TIMES}
WHERE epoch(time) >= hi - (hi - lo) * 0.1e0 ORDER BY id LIMIT {TARGET // 20}""", doubles=PLACED)
def preserve_recent(spark, folder):
    return s.preserve_recent(_placed(spark, folder), s.SamplingConfig(target_size=TARGET))


@query("sample_whole", views="measurements", sql=f"""
WITH t AS ({M}),
ends AS ({ENDS.replace('readings', 'measurements').replace('salinity', 'lat')}
UNION (SELECT id FROM measurements ORDER BY lon, id LIMIT 1) UNION (SELECT id FROM measurements ORDER BY lon DESC, id LIMIT 1)),
recent AS (SELECT id FROM measurements, {TIMES} WHERE epoch(time) >= hi - (hi - lo) * 0.1e0 ORDER BY id
           LIMIT {TARGET // 20})
SELECT * FROM t ORDER BY CASE WHEN id IN (SELECT id FROM ends) OR id IN (SELECT id FROM recent) THEN 0 ELSE 1 END,
  {HASH}, id LIMIT {TARGET}""", doubles=PLACED)
def sample_whole(spark, folder):
    """The whole procedure: drawn rows, extremes and recent rows, cut to the target."""
    return s.sample(_placed(spark, folder), s.SamplingConfig(target_size=TARGET, preserve_recent=True))


@query("sample_union", views="readings", sql=f"""
SELECT * FROM ({R} ORDER BY {HASH}, id LIMIT {TARGET}) UNION (
SELECT id, depth, temperature, salinity, dataset_type
FROM readings, (SELECT min(depth) AS lo, max(depth) AS hi FROM readings)
QUALIFY row_number() OVER (PARTITION BY {STRATUM} ORDER BY {HASH}, id) <= {TARGET // 10})""", doubles=READ)
def sample_union(spark, folder):
    rows, c = _readings(spark, folder), s.SamplingConfig(target_size=TARGET)
    return o.union_distinct(s.sample_random(rows, c), s.sample_stratified(rows, c), "id")


def _score(c: str) -> str:
    return f"""greatest(0e0, least(1e0, ((1e0 - abs(a.{c}m - b.{c}m) / (abs(a.{c}m) + 1e-10))
  + (1e0 - abs(a.{c}s - b.{c}s) / (abs(a.{c}s) + 1e-10)) + least(a.{c}r, b.{c}r) / (greatest(a.{c}r, b.{c}r) + 1e-10))
  / 3e0))"""


def _facts(c: str) -> str:
    return f"avg({c}) AS {c}m, stddev_samp({c}) AS {c}s, max({c}) - min({c}) AS {c}r"


@query("sample_quality", views="readings", sql=f"""
WITH a AS (SELECT {_facts('depth')}, {_facts('temperature')}, {_facts('salinity')} FROM readings),
b AS (SELECT {_facts('depth')}, {_facts('temperature')}, {_facts('salinity')}
      FROM (SELECT * FROM readings ORDER BY {HASH}, id LIMIT {TARGET}))
SELECT ({_score('depth')} + {_score('temperature')} + {_score('salinity')}) / 3e0 AS quality_score FROM a, b""",
       doubles="quality_score")
def sample_quality(spark, folder):
    rows = _readings(spark, folder)
    drawn = s.sample_random(rows, s.SamplingConfig(target_size=TARGET))
    return s.sample_quality(rows, drawn, ["depth", "temperature", "salinity"])


@query("thin_scatter", views="readings", sql=f"""
SELECT id, temperature, salinity, dataset_type FROM readings ORDER BY
  CASE WHEN id IN ({ENDS.replace('depth', 'salinity')}) THEN 0 ELSE 1 END, {HASH}, id LIMIT {TARGET}""",
       doubles="temperature salinity")
def thin_scatter(spark, folder):
    return s.thin_scatter(view(spark, folder, "readings"), "temperature", "salinity", "dataset_type", TARGET)


@query("thin_lines", views="readings", sql=f"""
WITH r AS (SELECT dataset_type, id, depth, temperature,
                  row_number() OVER (PARTITION BY dataset_type ORDER BY id) - 1 AS spot,
                  count(*) OVER (PARTITION BY dataset_type) AS n FROM readings),
ends AS (""" + "\nUNION ".join(
    f"(SELECT id FROM readings WHERE dataset_type = '{t}' AND {c} IS NOT NULL ORDER BY {c} {way}, id {way} LIMIT 1)"
    for t in "FO" for c in ("depth", "temperature") for way in ("ASC", "DESC")) + f""")
SELECT dataset_type, id, depth, temperature FROM (
  SELECT *, CASE WHEN n > {TARGET} AND id IN (SELECT id FROM ends) THEN 0
                 WHEN n <= {TARGET} OR (spot % (n // {TARGET}) = 0 AND spot < (n // {TARGET}) * {TARGET}) THEN 1 END AS kept
  FROM r) WHERE kept IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY dataset_type ORDER BY kept, {HASH}, id) <= {TARGET}""",
       doubles="depth temperature")
def thin_lines(spark, folder):
    return s.thin_lines(view(spark, folder, "readings"), "depth", "temperature", "dataset_type", TARGET)
