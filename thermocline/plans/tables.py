"""Scans, table building from profile arrays and grids, exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..session import scratch
from ..sources import grids as g
from ..sources import profiles as p
from ..sources import sinks as x
from ..sources.binding import table, view
from ..sources.files import normalise_columns
from .registry import query

EVERY = "lat lon depth pressure temperature salinity oxygen ph chlorophyll"


@query("scan_floats", views="floats", sql="SELECT * FROM floats", doubles="deployment_lat deployment_lon",
       dates="deployment_date last_contact")
def scan_floats(spark, folder):
    return view(spark, folder, "floats")


@query("scan_profiles", views="profiles", sql="SELECT * FROM profiles", doubles="profile_lat profile_lon")
def scan_profiles(spark, folder):
    return view(spark, folder, "profiles")


@query("scan_tables", views="measurements", sql="SELECT * FROM measurements", doubles=EVERY)
def scan_tables(spark, folder):
    return view(spark, folder, "measurements")


def _arrays(spark, folder):
    """Each vector of the embedding table as a profile of 64 levels, some of them missing."""
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id AS profile_id", "concat('ARGO_', label) AS float_id",
        "transform(embedding, (v, i) -> CASE WHEN v >= -0.25e0 THEN CAST(i * 10 AS DOUBLE) END) AS PRES",
        "transform(embedding, v -> CAST(v AS DOUBLE) * 100) AS TEMP",
        "transform(embedding, v -> CASE WHEN v > 0.25e0 THEN double('NaN') ELSE 35 + CAST(v AS DOUBLE) END) AS PSAL",
        "transform(embedding, v -> CASE WHEN v > 0 THEN CAST(v AS DOUBLE) END) AS CHLA_ADJUSTED",
    )


@query("explode_profiles", sql="""
SELECT vec_id AS profile_id, concat('ARGO_', label) AS float_id, CAST(i - 1 AS INT) AS level,
       CAST((i - 1) * 10 AS DOUBLE) AS depth, CAST((i - 1) * 10 AS DOUBLE) AS pressure,
       CAST(v AS DOUBLE) * 100 AS temperature, 35 + CAST(v AS DOUBLE) AS salinity, CAST(NULL AS DOUBLE) AS oxygen,
       CAST(NULL AS DOUBLE) AS ph, CASE WHEN v > 0 THEN CAST(v AS DOUBLE) END AS chlorophyll,
       CAST(NULL AS DOUBLE) AS nitrate, CAST(NULL AS DOUBLE) AS backscatter, CAST(NULL AS DOUBLE) AS cdom,
       CAST(NULL AS DOUBLE) AS downwelling_par
FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
WHERE v >= -0.25e0 AND NOT v > 0.25e0""", doubles="depth pressure temperature salinity chlorophyll")
def explode_profiles(spark, folder):
    return p.explode_profiles(_arrays(spark, folder), ("profile_id", "float_id"))


@query("profile_level_counts", sql="""
SELECT vec_id AS profile_id, CAST(len([v FOR v IN embedding IF v >= -0.25e0]) AS INT) AS n_levels FROM embeddings""")
def profile_level_counts(spark, folder):
    return p.profile_level_counts(_arrays(spark, folder))


@query("platform_ids", sql="""
SELECT c_custkey, platform_number, concat('ARGO_', platform_number) AS float_id,
       try_cast(regexp_replace(platform_number, '[^0-9]', '', 'g') AS BIGINT) AS wmo_id
FROM (SELECT c_custkey, coalesce(nullif(replace(replace(trim(raw), '''', ''), 'b', ''), ''), 'UNKNOWN')
      AS platform_number
  FROM (SELECT c_custkey, CASE c_nationkey WHEN 0 THEN NULL WHEN 1 THEN ' b'''' ' WHEN 2 THEN c_mktsegment
                               ELSE concat(' b''', c_name, ''' ') END AS raw FROM customer))""")
def platform_ids(spark, folder):
    raw = table(spark, folder, "customer").selectExpr("c_custkey", """
        CASE c_nationkey WHEN 0 THEN NULL WHEN 1 THEN " b'' " WHEN 2 THEN c_mktsegment
             ELSE concat(" b'", c_name, "' ") END AS raw""")
    return p.with_platform(raw, "raw").drop("raw")


@query("float_dimension", views="casts", sql="""
SELECT float_id, 5900000 + float_id AS wmo_id, CAST(profile_date AS DATE) AS deployment_date,
       profile_lat AS deployment_lat, profile_lon AS deployment_lon, 'ACTIVE' AS status,
       CAST(profile_date AS DATE) AS last_contact
FROM casts
QUALIFY row_number() OVER (PARTITION BY float_id ORDER BY year(profile_date) DESC, profile_id) = 1""",
       doubles="deployment_lat deployment_lon", dates="deployment_date last_contact")
def float_dimension(spark, folder):
    """Each year of profiles stands for a file."""
    files = view(spark, folder, "casts").select(
        "float_id", (F.col("float_id") + 5900000).alias("wmo_id"), F.year("profile_date").alias("file_seq"),
        F.col("profile_id").alias("profile_seq"), F.col("profile_date").alias("time"),
        F.col("profile_lat").alias("lat"), F.col("profile_lon").alias("lon"),
    )
    return p.float_dimension(files, dt.date(2024, 6, 30))


@query("grid_subset", views="measurements", sql="""
SELECT * FROM measurements WHERE time <= (SELECT max(time) FROM (SELECT DISTINCT time FROM measurements
  ORDER BY time LIMIT 60)) AND lon BETWEEN 50 AND 120 AND lat BETWEEN -30 AND 30""", doubles=EVERY)
def grid_subset(spark, folder):
    return g.grid_subset(view(spark, folder, "measurements"))


@query("drop_incomplete", views="measurements", sql="""
SELECT * FROM measurements WHERE temperature IS NOT NULL AND oxygen IS NOT NULL AND salinity IS NOT NULL
  AND ph IS NOT NULL AND chlorophyll IS NOT NULL""", doubles=EVERY)
def drop_incomplete(spark, folder):
    return g.drop_incomplete(view(spark, folder, "measurements"))


VIRTUAL_FLOATS = """
vf AS (SELECT lat, lon, row_number() OVER (ORDER BY lat, lon) AS n, min(time) AS a, max(time) AS b
       FROM measurements GROUP BY lat, lon)"""
VIRTUAL_PROFILES = VIRTUAL_FLOATS + """,
vp AS (SELECT row_number() OVER (ORDER BY c.lat, c.lon, c.time) AS profile_id,
              concat('ARGO_', CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END)
              AS float_id, row_number() OVER (PARTITION BY c.lat, c.lon ORDER BY c.time) AS cycle_number,
              c.time AS profile_date, c.lat AS profile_lat, c.lon AS profile_lon, n_levels
       FROM (SELECT lat, lon, time, count(*) AS n_levels FROM measurements GROUP BY lat, lon, time) c
       JOIN vf ON c.lat = vf.lat AND c.lon = vf.lon)"""


@query("virtual_floats", views="measurements", sql=f"""WITH {VIRTUAL_FLOATS}
SELECT concat('ARGO_', CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END)
       AS float_id, 5900000 + n AS wmo_id, CAST(a AS DATE) AS deployment_date, lat AS deployment_lat,
       lon AS deployment_lon, 'ACTIVE' AS status, CAST(b AS DATE) AS last_contact FROM vf""",
       doubles="deployment_lat deployment_lon", dates="deployment_date last_contact")
def virtual_floats(spark, folder):
    return g.virtual_floats(g.placed(view(spark, folder, "readings"), view(spark, folder, "casts")), None)


@query("virtual_profiles", views="measurements", sql=f"WITH {VIRTUAL_PROFILES}\nSELECT * FROM vp",
       doubles="profile_lat profile_lon")
def virtual_profiles(spark, folder):
    rows = g.placed(view(spark, folder, "readings"), view(spark, folder, "casts"))
    return g.virtual_profiles(rows, g.virtual_floats(rows, None))


@query("virtual_measurements", views="measurements", sql=f"""WITH {VIRTUAL_PROFILES}
SELECT vp.profile_id, vp.float_id, time, lat, lon, depth, depth * 1.025e0 AS pressure, temperature, salinity, oxygen,
       ph, chlorophyll, CAST(NULL AS DOUBLE) AS nitrate
FROM measurements m JOIN vp ON m.lat = profile_lat AND m.lon = profile_lon AND m.time = profile_date""", doubles=EVERY)
def virtual_measurements(spark, folder):
    places = g.placed(view(spark, folder, "readings"), view(spark, folder, "casts"))
    rows = view(spark, folder, "measurements").drop("id", "profile_id", "float_id")
    return g.virtual_measurements(rows, g.virtual_profiles(places, g.virtual_floats(places, None)))


@query("bgc_presence", views="readings", sql="SELECT bool_or(oxygen IS NOT NULL) AS has_bgc FROM readings")
def bgc_presence(spark, folder):
    return p.bgc_presence(view(spark, folder, "readings").withColumn("nitrate", F.lit(None).cast("double")))


@query("normalise_columns", sql="""
SELECT o_orderkey AS profile_id, o_totalprice AS temperature, CAST(NULL AS DOUBLE) AS salinity,
       CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS depth, o_orderdate AS time, CAST(o_custkey AS DOUBLE) AS lat,
       try_cast(o_orderstatus AS DOUBLE) AS lon, CAST(o_custkey AS DOUBLE) AS latitude,
       try_cast(o_orderstatus AS DOUBLE) AS longitude, o_orderdate AS date FROM orders""", doubles="temperature")
def normalise(spark, folder):
    """Numbers and dates that arrive as text, some of it not a number."""
    return normalise_columns(table(spark, folder, "orders").selectExpr(
        "o_orderkey AS profile_id", "CAST(o_totalprice AS STRING) AS temperature", "o_orderpriority AS salinity",
        "substring(o_orderpriority, 1, 1) AS depth", "CAST(o_orderdate AS STRING) AS time",
        "CAST(o_custkey AS STRING) AS lat", "o_orderstatus AS lon"))


@query("export_rows", views="measurements", sql="""
SELECT time, lat, lon, depth, temperature, salinity FROM measurements
WHERE id IN (SELECT id FROM measurements WHERE quality_flag = 4)""", doubles="lat lon depth temperature salinity")
def export_rows(spark, folder):
    wanted = view(spark, folder, "readings").filter("quality_flag = 4").select("id")
    return x.export_rows(view(spark, folder, "measurements"), wanted)


@query("export_ascii", views="measurements", sql="""
SELECT concat_ws(' ', strftime(time, '%Y-%m-%d %H:%M:%S'), printf('%8.3f', lat), printf('%8.3f', lon),
       printf('%8.1f', depth), CASE WHEN temperature IS NULL THEN '     NaN' ELSE printf('%8.3f', temperature) END,
       printf('%8.3f', salinity)) AS value FROM measurements
UNION ALL SELECT unnest(['# ARGO Float Data Export', '# Generated: 2024-06-30 00:00:00 UTC',
  concat('# Number of profiles: ', (SELECT count(*) FROM measurements)),
  '# Format: DATE TIME LAT LON DEPTH TEMP SALINITY',
  '# Units: YYYY-MM-DD HH:MM:SS degrees degrees meters celsius psu',
  '#======================================================================'])""")
def export_ascii(spark, folder):
    return x.export_ascii(view(spark, folder, "measurements"), as_of=dt.datetime(2024, 6, 30))


# Three digits: the engines write smaller numbers with different exponents.
_SHORT = ("depth", "pressure", "temperature", "salinity", "oxygen", "ph", "chlorophyll")


@query("export_json", views="readings", sql=f"""
SELECT CAST(to_json(r) AS VARCHAR) AS record
FROM (SELECT * REPLACE ({", ".join(f"round({c} + 1e-9, 3) + 0.0 AS {c}" for c in _SHORT)}) FROM readings) r""")
def export_json(spark, folder):
    return x.json_records(view(spark, folder, "readings").withColumns({c: F.round(F.col(c) + 1e-9, 3) + 0.0 for c in _SHORT}))


@query("columnar_round_trip", views="measurements",
       sql="SELECT temperature, salinity, lat AS latitude, lon AS longitude, depth, time FROM measurements",
       doubles="temperature salinity latitude longitude depth")
def columnar_round_trip(spark, folder):
    """The columnar export of all measurements, written and read again."""
    path = scratch(spark)
    x.export_columnar(view(spark, folder, "measurements"), path)
    return spark.read.parquet(path)


@query("grid_rows", sql="""
SELECT vec_id AS time, CAST(i // 16 * 10 AS DOUBLE) AS depth, CAST(i // 4 % 4 AS DOUBLE) AS lat, CAST(i % 4 AS DOUBLE) AS lon,
       CAST(embedding[i + 1] AS DOUBLE) AS temperature
FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)""", doubles="depth lat lon temperature")
def grid_rows(spark, folder):
    """Each vector of the embedding table as a grid of four levels, latitudes and longitudes, cell by cell."""
    axis = lambda step: F.array(*(F.lit(float(k * step)) for k in range(4)))
    cells = F.expr("transform(sequence(0, 3), z -> transform(sequence(0, 3), y -> slice(embedding, z * 16 + y * 4 + 1, 4)))")
    slabs = table(spark, folder, "embeddings").select(F.col("vec_id").alias("TAXIS"), axis(10).alias("ZAX"), axis(1).alias("YAXIS"),
                                                      axis(1).alias("XAXIS"), cells.alias("TEMP"))
    return g.grid_to_rows(slabs)
