"""Latest rows, trajectories, pages, decimation, clusters, depth profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geography as g
from ..operators import order as o

from ..sources.binding import event_log, view
from .registry import query


def _points(spark, folder):
    return view(spark, folder, "casts").select(
        "float_id", "profile_id", F.col("profile_lat").alias("lat"), F.col("profile_lon").alias("lon"),
        F.col("profile_date").alias("time"),
    )


POINTS = """pts AS (SELECT float_id, profile_id, profile_lat AS lat, profile_lon AS lon, profile_date AS time
  FROM casts WHERE profile_lat BETWEEN -90 AND 90 AND profile_lon BETWEEN -180 AND 180)"""


@query("latest_positions", views="measurements", sql="""
SELECT float_id, id, time, lat, lon, depth, CAST(NULL AS BIGINT) AS wmo_id, CAST(NULL AS INT) AS cycle_number,
       CAST(NULL AS TIMESTAMP) AS profile_date
FROM measurements QUALIFY row_number() OVER (PARTITION BY float_id ORDER BY time DESC, id DESC) = 1""",
       doubles="lat lon depth")
def latest_positions(spark, folder):
    rows = view(spark, folder, "measurements").select("float_id", "id", "time", "lat", "lon", "depth")
    return o.latest_positions(rows, "id")


@query("float_trajectory", views="measurements", sql="""
SELECT float_id, profile_id, min(time) AS time, min(lat) AS lat, min(lon) AS lon,
       arg_min(temperature, id) FILTER (WHERE temperature IS NOT NULL) AS temperature
FROM measurements GROUP BY float_id, profile_id""", doubles="lat lon temperature")
def float_trajectory(spark, folder):
    return o.float_trajectory(view(spark, folder, "measurements"), ["time", "id"], ("time", "lat", "lon", "temperature"))


@query("trajectories", views="casts", sql=f"""WITH {POINTS}
SELECT pts.*, n_points FROM pts JOIN (SELECT float_id, count(*) AS n_points FROM pts GROUP BY float_id
  HAVING count(*) >= 2) n ON pts.float_id = n.float_id""",
       doubles="lat lon")
def trajectories(spark, folder):
    return o.trajectories(_points(spark, folder))


@query("trajectory_endpoints", views="casts", sql=f"""WITH {POINTS}
SELECT float_id, arg_min(lat, k) AS start_lat, arg_min(lon, k) AS start_lon, arg_min(time, k) AS start_time,
       arg_max(lat, k) AS end_lat, arg_max(lon, k) AS end_lon, arg_max(time, k) AS end_time
FROM (SELECT *, row_number() OVER (PARTITION BY float_id ORDER BY time, profile_id) AS k FROM pts)
GROUP BY float_id HAVING count(*) >= 2""", doubles="start_lat start_lon end_lat end_lon")
def trajectory_endpoints(spark, folder):
    return o.trajectory_endpoints(o.trajectories(_points(spark, folder)), ["time", "profile_id"])


@query("depth_ordered", views="measurements", sql="SELECT float_id, depth, id, temperature FROM measurements",
       doubles="depth temperature")
def depth_ordered(spark, folder):
    return o.depth_ordered(view(spark, folder, "measurements").select("float_id", "depth", "id", "temperature"), "id")


@query("page_of_rows", views="readings", sql="""
SELECT id, depth, temperature, true AS has_more FROM (SELECT * FROM readings ORDER BY id LIMIT 1000 OFFSET 3000)""",
       doubles="depth temperature")
def page_of_rows(spark, folder):
    return o.page_of_rows(view(spark, folder, "readings").select("id", "depth", "temperature"), ["id"], 3, 1000)


@query("decimate_even", views="readings", sql="""
WITH r AS (SELECT id, depth, temperature, row_number() OVER (ORDER BY id) - 1 AS spot, count(*) OVER () AS n
           FROM readings),
i AS (SELECT CASE WHEN i = 1999 THEN n - 1 ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / 1999)) AS BIGINT) END AS spot
      FROM range(2000) t(i), (SELECT count(*) AS n FROM readings))
SELECT id, depth, temperature FROM r WHERE spot IN (SELECT spot FROM i)""", doubles="depth temperature")
def decimate_even(spark, folder):
    return o.decimate_even(view(spark, folder, "readings").select("id", "depth", "temperature"), ["id"], 2000)


@query("last_events", sql="""
SELECT user_id AS service, event_id, ts, event_type, value,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS position
FROM events QUALIFY position <= 10""")
def last_events(spark, folder):
    return o.last_per_key(event_log(spark, folder), "service", o.desc("ts", "event_id"))


@query("first_floats", views="casts", sql="""
SELECT float_id, min(profile_date) AS first_seen FROM casts GROUP BY float_id ORDER BY first_seen, float_id LIMIT 3""")
def first_floats(spark, folder):
    return o.first_distinct(view(spark, folder, "casts"), "float_id", "profile_date", 3)


@query("distinct_locations", views="casts", sql="SELECT DISTINCT profile_lat AS lat, profile_lon AS lon FROM casts",
       doubles="lat lon")
def distinct_locations(spark, folder):
    return o.distinct_locations(_points(spark, folder))


@query("region_outlines", views="measurements", sql="""
WITH r(region, north, south, east, west) AS (VALUES ('Indian Ocean', 30, -60, 120, 20), ('Arabian Sea', 25, 5, 75, 50),
  ('Bay of Bengal', 22, 5, 95, 80), ('Equatorial Indian Ocean', 10, -10, 100, 50)),
c AS (SELECT r.*, n AS measurement_count FROM r JOIN (SELECT region, count(*) AS n FROM measurements JOIN r
  ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY region) USING (region))
SELECT region, measurement_count, 0 AS point, CAST(south AS DOUBLE) AS lat, CAST(west AS DOUBLE) AS lon FROM c
UNION ALL SELECT region, measurement_count, 1, south, east FROM c
UNION ALL SELECT region, measurement_count, 2, north, east FROM c
UNION ALL SELECT region, measurement_count, 3, north, west FROM c
UNION ALL SELECT region, measurement_count, 4, south, west FROM c""")
def region_outlines(spark, folder):
    return g.region_outlines(view(spark, folder, "measurements"))


REACH = 5.0  # degrees; gives clusters as well as single floats at every scale


# The SQL walks through the floats one by one and carries the list of leaders along.
@query("cluster_floats", views="casts", sql=f"""
WITH RECURSIVE pts AS (
  SELECT float_id, lat, lon, row_number() OVER (ORDER BY float_id) AS i FROM (
    SELECT float_id, profile_lat AS lat, profile_lon AS lon FROM casts
    QUALIFY row_number() OVER (PARTITION BY float_id ORDER BY profile_date DESC, profile_id DESC) = 1)),
walk(i, leaders) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, lat DOUBLE, lon DOUBLE)[])
  UNION ALL
  SELECT p.i, CASE WHEN len(list_filter(leaders, lambda l: sqrt((l.lat - p.lat) * (l.lat - p.lat) + (l.lon - p.lon) * (l.lon - p.lon)) <= {REACH})) > 0
                   THEN leaders ELSE list_append(leaders, {{'id': p.float_id, 'lat': p.lat, 'lon': p.lon}}) END
  FROM walk w JOIN pts p ON p.i = w.i + 1),
leads AS (SELECT unnest(leaders, recursive := true) FROM (SELECT leaders FROM walk ORDER BY i DESC LIMIT 1)),
sized AS (SELECT l.id AS leader, avg(p.lat) AS lat, avg(p.lon) AS lon, count(*) AS cluster_size,
                 row_number() OVER (ORDER BY l.id) - 1 AS position
  FROM leads l JOIN pts p ON sqrt((l.lat - p.lat) * (l.lat - p.lat) + (l.lon - p.lon) * (l.lon - p.lon)) <= {REACH} GROUP BY l.id)
SELECT CASE WHEN cluster_size > 1 THEN 'Cluster_' || position ELSE CAST(leader AS VARCHAR) END AS float_id, leader, lat, lon, cluster_size,
       CAST(CASE WHEN cluster_size > 1 THEN least(cluster_size * {g.MARKER_STEP} + {g.MARKER_BASE}, {g.MARKER_LIMIT}) ELSE {g.SINGLE_MARKER} END AS INT) AS marker_size
FROM sized""", doubles="lat lon")
def cluster_floats(spark, folder):
    """Latest position of every float, clustered in the order of their ids."""
    rows = view(spark, folder, "casts").select(
        "float_id", F.col("profile_id").alias("id"), F.col("profile_date").alias("time"),
        F.col("profile_lat").alias("lat"), F.col("profile_lon").alias("lon"))
    return g.cluster_floats(o.latest_positions(rows, "id").select("float_id", "lat", "lon"), REACH)


@query("density_grid", views="casts", sql="""
SELECT floor(profile_lat) AS lat_cell, floor(profile_lon) AS lon_cell, count(*) AS density FROM casts
WHERE profile_lat BETWEEN -90 AND 90 AND profile_lon BETWEEN -180 AND 180 GROUP BY 1, 2""",
       doubles="lat_cell lon_cell")
def density_grid(spark, folder):
    return g.density_grid(_points(spark, folder))


@query("profile_series", views="measurements", sql="\nUNION ALL\n".join(
       f"SELECT float_id, depth, '{c}' AS series, {c} AS value FROM measurements WHERE {c} IS NOT NULL"
       for c in g.SERIES), doubles="depth value")
def profile_series(spark, folder):
    return g.profile_series(view(spark, folder, "measurements"))


@query("ts_profile", views="readings", sql="""
SELECT id, temperature, salinity, depth, -depth AS display_depth FROM readings
WHERE temperature IS NOT NULL AND salinity IS NOT NULL""", doubles="temperature salinity depth display_depth")
def ts_profile(spark, folder):
    return g.ts_profile(view(spark, folder, "readings"))


@query("profile_comparison", views="casts readings", sql="""
WITH f AS (SELECT float_id FROM casts GROUP BY float_id ORDER BY count(*) DESC, float_id LIMIT 1),
c AS (SELECT profile_id, concat('Profile ', row_number() OVER (ORDER BY profile_date, profile_id)) AS label
      FROM casts WHERE float_id = (SELECT float_id FROM f))
SELECT label, r.profile_id, depth, -depth AS display_depth, 'temperature' AS parameter, temperature AS value
FROM readings r JOIN c ON r.profile_id = c.profile_id WHERE temperature IS NOT NULL
UNION ALL SELECT label, r.profile_id, depth, -depth, 'salinity', salinity
FROM readings r JOIN c ON r.profile_id = c.profile_id WHERE salinity IS NOT NULL""",
       doubles="depth display_depth value")
def profile_comparison(spark, folder):
    """All profiles of the float that has the most, numbered in time order."""
    casts = view(spark, folder, "casts")
    busiest = casts.groupBy("float_id").count().orderBy(F.desc("count"), "float_id").first()["float_id"]
    own = casts.filter(F.col("float_id") == busiest).select("profile_id", "profile_date")
    chosen = o.with_rank(own, ["profile_date", "profile_id"], "position").withColumn("position", F.col("position") + 1)
    return g.profile_comparison(view(spark, folder, "readings"), chosen)


@query("density_contours", views="readings", sql="""
WITH s AS (SELECT min(salinity) AS s0, max(salinity) AS s1, min(temperature) AS t0, max(temperature) AS t1
           FROM readings WHERE temperature IS NOT NULL AND salinity IS NOT NULL),
p AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, s0 + (s1 - s0) * i / 49 AS salinity,
             t0 + (t1 - t0) * j / 49 AS temperature FROM s, range(50) a(i), range(50) b(j))
SELECT *, 1000 + 0.8e0 * (salinity - 35) - 0.2e0 * (temperature - 15) AS density FROM p""",
       doubles="salinity temperature density")
def density_contours(spark, folder):
    return g.density_contours(view(spark, folder, "readings"))


@query("bgc_thresholds", views="readings", sql="\nUNION ALL\n".join(
       f"""SELECT '{c}' AS parameter, CAST({v} AS DOUBLE) AS threshold, '{text}' AS label, count({c}) AS measurement_count,
       count(*) FILTER (WHERE {c} < {v}e0) AS below_count,
       count(*) FILTER (WHERE {c} < {v}e0) / CAST(count({c}) AS DOUBLE) AS below_share FROM readings"""
       for c, v, text in g.REFERENCE_LINES), doubles="threshold below_share")
def bgc_thresholds(spark, folder):
    return g.bgc_thresholds(view(spark, folder, "readings"))
