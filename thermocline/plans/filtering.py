"""Filters by time, place, physical range and technical fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import labels
from ..functions import predicates as p
from ..operators import filters as f
from ..operators import joins as j
from ..operators import regions as rg
from ..operators.filters import Filters
from ..sources.binding import event_log, table, view
from .registry import query

AS_OF = dt.datetime(2001, 8, 1)
EVERY = "lat lon depth pressure temperature salinity oxygen ph chlorophyll"
READ = "depth pressure temperature salinity oxygen ph chlorophyll"


def _rows(name: str, where: str, filters: Filters, source: str = "measurements", doubles: str = EVERY):
    """Register a plain filter over one view."""

    @query(name, views=source, sql=f"SELECT * FROM {source} WHERE {where}", doubles=doubles)
    def build(spark, folder):
        return f.apply_filters(view(spark, folder, source), filters)


_rows("filter_date_range", "CAST(time AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-06-30'",
      Filters(dates=(dt.date(1997, 3, 1), dt.date(1997, 6, 30))))
_rows("filter_profile_date", "CAST(profile_date AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'",
      Filters(dates=(dt.date(1998, 1, 1), dt.date(1998, 12, 31))), "casts", "profile_lat profile_lon")
_rows("filter_relative_period", "time >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY",
      Filters(relative_days=p.RELATIVE_DAYS["Last 6 months"], as_of=AS_OF))
_rows("filter_months_years", "month(time) IN (3, 4, 5) AND year(time) IN (1996, 1999)",
      Filters(months=(3, 4, 5), years=(1996, 1999)))
_rows("filter_bbox", "lat BETWEEN 5 AND 25 AND lon BETWEEN 50 AND 75",
      Filters(box={"north": 25, "south": 5, "east": 75, "west": 50}))
_rows("filter_circle", "sqrt((lat - 10) * (lat - 10) + (lon - 70) * (lon - 70)) * 111 <= 1500",
      Filters(circle=(10.0, 70.0, 1500.0)))
_rows("filter_depth", "depth BETWEEN 0 AND 50", Filters(depths=p.DEPTH_PRESETS["Surface"]), "readings", READ)
_rows("filter_depth_levels", "depth IN (40, 80, 120, 200, 520)", Filters(depth_text="40, 80,120,200,520"), "readings",
      READ)
_rows("filter_temperature", "temperature BETWEEN 10 AND 20", Filters(temperature=(10.0, 20.0)), "readings", READ)
_rows("filter_salinity", "salinity BETWEEN 33 AND 36.5e0", Filters(salinity=(33.0, 36.5)), "readings", READ)
_rows("filter_bgc", "oxygen BETWEEN 2 AND 6 AND ph BETWEEN 7.6e0 AND 8.1e0 AND chlorophyll BETWEEN 0.1e0 AND 0.8e0",
      Filters(oxygen=(2.0, 6.0), ph=(7.6, 8.1), chlorophyll=(0.1, 0.8)), "readings", READ)
_rows("filter_cycles", "cycle_number BETWEEN 1 AND 200", Filters(cycles=p.DEFAULT_CYCLES), "casts",
      "profile_lat profile_lon")
_rows("filter_completeness", """(CASE WHEN temperature IS NULL THEN 0 ELSE 1 END + CASE WHEN salinity IS NULL THEN 0
  ELSE 1 END + CASE WHEN oxygen IS NULL THEN 0 ELSE 1 END + CASE WHEN ph IS NULL THEN 0 ELSE 1 END
  + CASE WHEN chlorophyll IS NULL THEN 0 ELSE 1 END) / 5e0 >= 0.7e0""", Filters(min_completeness=0.7), "readings", READ)
_rows("filter_max_age", "time >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY", Filters(max_age_days=90, as_of=AS_OF))
_rows("valid_coordinates", "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180", Filters(valid_places=True))


@query("filter_time_of_day", sql="""
SELECT event_id, ts, user_id AS service, event_type, value FROM events
WHERE CAST(ts + INTERVAL 330 MINUTE AS TIME) >= TIME '22:00:00' OR CAST(ts + INTERVAL 330 MINUTE AS TIME) < TIME '05:30:01'
""")
def filter_time_of_day(spark, folder):
    """Night hours in a zone five and a half hours ahead; the range runs over midnight."""
    night = p.time_of_day(F.col("ts"), dt.time(22), dt.time(5, 30), "IST")
    return event_log(spark, folder).filter(night)


@query("filter_named_region", views="measurements", sql="""
SELECT m.*, r.region FROM measurements m JOIN (VALUES
  ('Indian Ocean', 30, -60, 120, 20), ('Arabian Sea', 25, 5, 75, 50), ('Bay of Bengal', 22, 5, 95, 80),
  ('Equatorial Indian Ocean', 10, -10, 100, 50), ('Southern Indian Ocean', -20, -60, 120, 20))
  r(region, north, south, east, west)
  ON m.lat BETWEEN r.south AND r.north AND m.lon BETWEEN r.west AND r.east""", doubles=EVERY)
def filter_named_region(spark, folder):
    return rg.measurements_in_regions(view(spark, folder, "readings"), view(spark, folder, "casts"), labels.region_table(spark))


# A box per customer, of sides from a hundredth of a degree to sixty degrees, some of them without area.
BOXES = """SELECT c_custkey AS region, south + height AS north, south, west + width AS east, west FROM (
  SELECT c_custkey, CAST((c_custkey * 37) % 121 - 70 AS DOUBLE) - 0.5e0 AS south, CAST((c_custkey * 53) % 361 - 180 AS DOUBLE) - 0.5e0 AS west,
         CASE c_custkey % 5 WHEN 0 THEN 0e0 WHEN 1 THEN 0.01e0 WHEN 2 THEN 1e0 WHEN 3 THEN 7.5e0 ELSE 60e0 END AS height,
         CASE c_custkey % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 2e0 ELSE 30e0 END AS width FROM {customer})"""


@query("casts_in_boxes", views="casts", sql=f"""
SELECT region, count(*) AS profiles, count(DISTINCT float_id) AS floats, min(profile_id) AS first_profile
FROM casts JOIN ({BOXES.format(customer='customer')}) ON profile_lat BETWEEN south AND north AND profile_lon BETWEEN west AND east
GROUP BY region""")
def casts_in_boxes(spark, folder):
    """Profiles in each of as many boxes as there are customers."""
    boxes = spark.sql(BOXES, customer=table(spark, folder, "customer"))
    counts = rg.counts_in_regions(view(spark, folder, "casts"), boxes, "profile_id", "float_id", "profile_lat", "profile_lon")
    return counts.select("region", F.col("points").alias("profiles"), F.col("labels").alias("floats"), F.col("first").alias("first_profile"))


@query("filter_float_ids", views="measurements float_cards", sql="""
SELECT * FROM measurements WHERE float_id IN (
  SELECT float_id FROM float_cards WHERE deployment_lat BETWEEN 5 AND 25 AND deployment_lon BETWEEN 50 AND 75)""",
       doubles=EVERY)
def filter_float_ids(spark, folder):
    cards = view(spark, folder, "float_cards")
    home = p.in_region(F.col("deployment_lat"), F.col("deployment_lon"), "Arabian Sea")
    return f.by_listed(view(spark, folder, "measurements"), cards.filter(home), "float_id")


@query("filter_wmo_active", views="measurements floats", sql="""
SELECT m.* FROM measurements m WHERE m.float_id IN (SELECT float_id FROM floats WHERE status = 'ACTIVE'
  AND last_contact >= DATE '2001-08-01' - INTERVAL 365 DAY
  AND wmo_id IN (SELECT 5900000 + s_suppkey FROM supplier))""", doubles=EVERY)
def filter_wmo_active(spark, folder):
    """Active floats heard of within a year whose WMO number is in a list, here one taken from another table."""
    wanted = table(spark, folder, "supplier").selectExpr("5900000 + s_suppkey AS wmo_id")
    casts = f.by_fleet(view(spark, folder, "casts"), view(spark, folder, "floats"), wanted, active_only=True, recent_days=365, as_of=AS_OF)
    return j.placed_readings(view(spark, folder, "readings"), casts).select(view(spark, folder, "measurements").columns)


SHARE_SQL = ("(count(temperature) + count(salinity) + count(oxygen) + count(ph) + count(chlorophyll)) "
             "/ (count(*) * 5e0)")


@query("filter_quality_band", views="measurements", sql=f"""
SELECT * FROM measurements WHERE float_id IN (
  SELECT float_id FROM measurements GROUP BY float_id HAVING {SHARE_SQL} >= 0.85e0)""", doubles=EVERY)
def filter_quality_band(spark, folder):
    m = view(spark, folder, "measurements")
    return f.by_quality_level(m, ("Excellent", "Good")).select(m.columns)


@query("filter_funnel", views="measurements", sql="""
WITH c AS (SELECT count(*) AS c0,
  count(*) FILTER (WHERE d) AS c1, count(*) FILTER (WHERE d AND b) AS c2, count(*) FILTER (WHERE d AND b AND e) AS c3,
  count(*) FILTER (WHERE d AND b AND e AND t) AS c4, count(*) FILTER (WHERE d AND b AND e AND t AND s) AS c5
  FROM (SELECT CAST(time AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AS d,
               lat BETWEEN -60 AND 30 AND lon BETWEEN 20 AND 120 AS b, depth BETWEEN 0 AND 1000 AS e,
               temperature BETWEEN 5 AND 25 AS t, salinity BETWEEN 31 AND 38 AS s FROM measurements))
SELECT 1 AS step, 'date range' AS filter, c0 AS before, c1 AS after FROM c
UNION ALL SELECT 2, 'region', c1, c2 FROM c UNION ALL SELECT 3, 'depth', c2, c3 FROM c
UNION ALL SELECT 4, 'temperature', c3, c4 FROM c UNION ALL SELECT 5, 'salinity', c4, c5 FROM c""")
def filter_funnel(spark, folder):
    chosen = Filters(dates=(dt.date(1996, 1, 1), dt.date(2000, 12, 31)), region="Indian Ocean", depths=(0.0, 1000.0),
                     temperature=(5.0, 25.0), salinity=(31.0, 38.0))
    return f.filter_funnel(view(spark, folder, "measurements"), chosen)
