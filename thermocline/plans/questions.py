"""The sample questions as ready queries, and the data-quality reports."""

from __future__ import annotations

import datetime as dt

from ..operators import analytics as a
from ..operators import quality as k
from ..operators import questions as q
from ..sources.binding import event_log, view
from .registry import query
from .templates import BAND_SQL, ZONE_SQL

AS_OF = dt.datetime(2001, 8, 1)
READING_COLUMNS = ("id", "profile_id", "depth", "pressure", "temperature", "salinity", "oxygen", "ph", "chlorophyll", "quality_flag",
                   "dataset_type")
MEASUREMENT_COLUMNS = (*READING_COLUMNS, "float_id", "time", "lat", "lon")
WORDS = ("id", "dataset_type", "time")  # columns that are not numbers
CHECKED = tuple(c for c in READING_COLUMNS if c not in WORDS)
FENCED = tuple(c for c in CHECKED if c != "depth")  # places have no outliers


def _over(name: str, operator, sql: str, views: str = "measurements", doubles: str = "", takes: str | None = None):
    """Register an operator that takes exactly the listed views, in that order; the SQL uses ``views``."""

    @query(name, views=views, sql=sql, doubles=doubles)
    def build(spark, folder):
        return operator(*(view(spark, folder, v) for v in (takes or views).split()))


_over("deepest_per_float", q.deepest_per_float, """
SELECT float_id, depth, id, time, temperature, salinity FROM measurements
QUALIFY row_number() OVER (PARTITION BY float_id ORDER BY depth DESC, id) = 1""",
      doubles="depth temperature salinity")
_over("hemisphere_comparison", q.hemisphere_comparison, """
SELECT CASE WHEN lat >= 0 THEN 'Northern' ELSE 'Southern' END AS hemisphere, avg(salinity) AS avg_salinity,
       avg(temperature) AS avg_temperature, count(*) AS measurement_count FROM measurements GROUP BY 1""",
      doubles="avg_salinity avg_temperature", takes="readings casts")
_over("latitude_bands", q.latitude_bands, """
SELECT CAST(floor(lat / 10e0) * 10 AS INT) AS band_south, avg(temperature) AS avg_temperature,
       avg(salinity) AS avg_salinity, count(*) AS measurement_count FROM measurements GROUP BY 1""",
      doubles="avg_temperature avg_salinity", takes="readings casts")
_over("count_by_month", q.count_by_month, """
SELECT CAST(date_trunc('month', time) AS TIMESTAMP) AS month, count(*) AS measurement_count FROM measurements
GROUP BY 1""", takes="readings casts")
_over("seasonal_variation", q.seasonal_variation, """
SELECT quarter(time) AS quarter, month(time) AS month_of_year, avg(temperature) AS avg_temperature,
       avg(salinity) AS avg_salinity, count(*) AS measurement_count FROM measurements GROUP BY 1, 2""",
      doubles="avg_temperature avg_salinity", takes="readings casts")
_over("deployments_over_time", q.deployments_over_time, """
SELECT CAST(date_trunc('month', first_profile) AS TIMESTAMP) AS month, count(*) AS deployments
FROM (SELECT float_id, min(profile_date) AS first_profile FROM casts GROUP BY float_id) GROUP BY 1""", "casts")
_over("busiest_floats", q.busiest_floats, """
SELECT float_id, count(*) AS measurement_count FROM casts JOIN readings USING (profile_id)
GROUP BY float_id ORDER BY measurement_count DESC, float_id LIMIT 10""", "casts readings")
_over("float_duration", q.float_duration, """
SELECT float_id, min(profile_date) AS first_profile, max(profile_date) AS last_profile,
       date_diff('day', CAST(min(profile_date) AS DATE), CAST(max(profile_date) AS DATE)) AS days
FROM casts GROUP BY float_id""", "casts")
_over("oxygen_below_500", q.oxygen_below, """
SELECT avg(oxygen) AS avg_oxygen, min(oxygen) AS min_oxygen, max(oxygen) AS max_oxygen, count(*) AS measurement_count
FROM readings WHERE depth > 500 AND oxygen IS NOT NULL""", "readings", "avg_oxygen min_oxygen max_oxygen")
_over("surface_vs_deep", q.surface_vs_deep, """
SELECT CASE WHEN depth <= 50 THEN 'surface' ELSE 'deep' END AS layer, avg(temperature) AS avg_temperature,
       avg(oxygen) AS avg_oxygen, avg(ph) AS avg_ph, avg(chlorophyll) AS avg_chlorophyll,
       count(*) AS measurement_count
FROM readings WHERE depth <= 50 OR depth >= 500 GROUP BY 1""", "readings",
      "avg_temperature avg_oxygen avg_ph avg_chlorophyll")
_over("ph_by_depth", q.ph_by_depth, """
SELECT CAST(floor(depth / 100) * 100 AS INT) AS depth_from, avg(ph) AS avg_ph, min(ph) AS min_ph, max(ph) AS max_ph,
       count(*) AS measurement_count FROM readings WHERE ph IS NOT NULL GROUP BY 1""", "readings",
      "avg_ph min_ph max_ph")
_over("chlorophyll_by_zone", q.chlorophyll_by_zone, f"""
SELECT {ZONE_SQL} AS ocean_zone, count(*) AS measurement_count, avg(chlorophyll) AS avg_chlorophyll,
       min(chlorophyll) AS min_chlorophyll, max(chlorophyll) AS max_chlorophyll,
       quantile_cont(chlorophyll, 0.25) AS q25, quantile_cont(chlorophyll, 0.5) AS median,
       quantile_cont(chlorophyll, 0.75) AS q75
FROM readings WHERE chlorophyll IS NOT NULL GROUP BY 1""", "readings",
      "avg_chlorophyll min_chlorophyll max_chlorophyll q25 median q75")
_over("temp_sal_correlation", q.temp_sal_correlation, """
SELECT corr(temperature, salinity) AS correlation, count(*) AS measurement_count FROM readings
WHERE temperature IS NOT NULL AND salinity IS NOT NULL""", "readings", "correlation")
_over("depth_histogram", q.depth_histogram, """
SELECT CAST(floor(depth / 100) * 100 AS INT) AS depth_from, count(*) AS measurement_count FROM readings
WHERE depth IS NOT NULL GROUP BY 1""", "readings")
_over("missing_patterns", q.missing_patterns, """
SELECT concat_ws(',', CASE WHEN temperature IS NULL THEN 'temperature' END,
  CASE WHEN salinity IS NULL THEN 'salinity' END, CASE WHEN oxygen IS NULL THEN 'oxygen' END,
  CASE WHEN ph IS NULL THEN 'ph' END, CASE WHEN chlorophyll IS NULL THEN 'chlorophyll' END) AS missing,
  count(*) AS measurement_count FROM readings GROUP BY 1""", "readings")
_over("floats_in_region", q.floats_in_region, """
SELECT float_id, count(*) AS measurement_count, max(time) AS last_seen FROM measurements
WHERE lat BETWEEN 5 AND 25 AND lon BETWEEN 50 AND 75 GROUP BY float_id""")
_over("floats_near_equator", q.near_equator, """
SELECT float_id, count(*) AS measurement_count, max(time) AS last_seen FROM measurements
WHERE lat BETWEEN -5 AND 5 GROUP BY float_id""")
_over("avg_temp_at_depth", q.avg_temp_at_depth, """
SELECT avg(temperature) AS avg_temperature, count(*) AS measurement_count FROM readings
WHERE depth BETWEEN 475 AND 525 AND temperature IS NOT NULL""", "readings", "avg_temperature")
_over("warmest_surface", q.warmest_surface, """
SELECT id, float_id, time, lat, lon, depth, temperature FROM measurements
WHERE depth <= 50 AND temperature IS NOT NULL ORDER BY temperature DESC, id LIMIT 20""",
      doubles="lat lon depth temperature")
_over("high_chlorophyll_cells", q.high_chlorophyll_cells, """
SELECT floor(lat) AS lat_cell, floor(lon) AS lon_cell, avg(chlorophyll) AS avg_chlorophyll,
       count(*) AS measurement_count
FROM measurements WHERE chlorophyll IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180
GROUP BY 1, 2 ORDER BY round(avg(chlorophyll), 9) DESC, 1, 2 LIMIT 20""", doubles="lat_cell lon_cell avg_chlorophyll")
_over("region_coverage", q.region_coverage, """
WITH r(region, north, south, east, west) AS (VALUES
  ('Indian Ocean', 30, -60, 120, 20), ('Arabian Sea', 25, 5, 75, 50), ('Bay of Bengal', 22, 5, 95, 80),
  ('Equatorial Indian Ocean', 10, -10, 100, 50), ('Southern Indian Ocean', -20, -60, 120, 20))
SELECT region, count(DISTINCT (floor(lat / 5), floor(lon / 5))) AS occupied_cells, count(*) AS measurement_count,
       CAST((floor(any_value(north) / 5e0) - floor(any_value(south) / 5e0) + 1)
            * (floor(any_value(east) / 5e0) - floor(any_value(west) / 5e0) + 1) AS BIGINT) AS cells,
       count(DISTINCT (floor(lat / 5), floor(lon / 5)))
         / ((floor(any_value(north) / 5e0) - floor(any_value(south) / 5e0) + 1)
            * (floor(any_value(east) / 5e0) - floor(any_value(west) / 5e0) + 1)) AS coverage
FROM measurements JOIN r ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY region""",
      doubles="coverage", takes="readings casts")
_over("salinity_depth_ranges", q.salinity_depth_ranges, f"""
SELECT {BAND_SQL} AS depth_range, avg(salinity) AS avg_salinity, min(salinity) AS min_salinity,
       max(salinity) AS max_salinity, count(*) AS measurement_count
FROM readings WHERE salinity IS NOT NULL GROUP BY 1""", "readings", "avg_salinity min_salinity max_salinity")
_over("quality_by_float", k.quality_by_float, """
SELECT float_id, total_records, good AS good_data_percentage, bad AS bad_data_percentage,
       CASE WHEN good >= 90 THEN 5 WHEN good >= 80 THEN 4 WHEN good >= 70 THEN 3 WHEN good >= 60 THEN 2 ELSE 1 END
       AS overall_score
FROM (SELECT float_id, count(*) AS total_records,
             count(*) FILTER (WHERE quality_flag IN (1, 2)) * 100e0 / count(*) AS good,
             count(*) FILTER (WHERE quality_flag IN (3, 4)) * 100e0 / count(*) AS bad
      FROM measurements GROUP BY float_id)""", doubles="good_data_percentage bad_data_percentage", takes="readings casts")
_over("quality_score", k.quality_score, """
SELECT total_records, good AS good_data_percentage, bad AS bad_data_percentage,
       CASE WHEN good >= 90 THEN 5 WHEN good >= 80 THEN 4 WHEN good >= 70 THEN 3 WHEN good >= 60 THEN 2 ELSE 1 END
       AS overall_score
FROM (SELECT count(*) AS total_records,
             count(*) FILTER (WHERE quality_flag IN (1, 2)) * 100e0 / count(*) AS good,
             count(*) FILTER (WHERE quality_flag IN (3, 4)) * 100e0 / count(*) AS bad FROM readings)""",
      "readings", "good_data_percentage bad_data_percentage")
_over("missing_by_column", k.missing_by_column, "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
       (count(*) - count({c})) * 100e0 / count(*) AS missing_percentage FROM readings""" for c in CHECKED),
      "readings", "missing_percentage")


def _fence_sql(columns) -> str:
    """One row per column with its fences."""
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", q1 - 1.5e0 * (q3 - q1) AS lower_bound, q3 + 1.5e0 * (q3 - q1) AS upper_bound
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM readings)""" for c in columns)


_over("iqr_outliers", lambda m: k.iqr_outliers(m, FENCED), "WITH fences AS (" + _fence_sql(FENCED) + ")\n"
      + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < lower_bound OR {c} > upper_bound) AS outlier_count,
       count(*) FILTER (WHERE {c} < lower_bound OR {c} > upper_bound) * 100e0 / count({c}) AS outlier_percentage,
       min(lower_bound) AS lower_bound, min(upper_bound) AS upper_bound
FROM readings, (SELECT * FROM fences WHERE "column" = '{c}')""" for c in FENCED), "readings",
      "outlier_percentage lower_bound upper_bound")
_over("temperature_outliers", q.outlying_rows, "WITH fences AS (" + _fence_sql(["temperature"]) + """)
SELECT r.* FROM readings r, fences WHERE temperature < lower_bound OR temperature > upper_bound""", "readings",
      "depth pressure temperature salinity oxygen ph chlorophyll")

@query("outlying_rows", sql="""
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, ts, user_id AS service, event_type, value FROM events, b
WHERE value < q1 - 1.5e0 * (q3 - q1) OR value > q3 + 1.5e0 * (q3 - q1)""")
def outlying_rows(spark, folder):
    """The same operator on a column that has a long tail."""
    return q.outlying_rows(event_log(spark, folder), "value")


@query("equator_month_profiles", views="casts", sql="""
SELECT profile_id, float_id, profile_date, profile_lat, profile_lon FROM casts
WHERE CAST(profile_date AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' AND profile_lat BETWEEN -5 AND 5""",
       doubles="profile_lat profile_lon")
def equator_month_profiles(spark, folder):
    return q.equator_month_profiles(view(spark, folder, "casts"), 1998, 3)


@query("recent_region_bgc", views="measurements", sql="""
SELECT avg(oxygen) AS avg_oxygen, avg(ph) AS avg_ph, avg(chlorophyll) AS avg_chlorophyll,
       count(*) AS measurement_count
FROM measurements WHERE time >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY
  AND lat BETWEEN 5 AND 25 AND lon BETWEEN 50 AND 75""", doubles="avg_oxygen avg_ph avg_chlorophyll")
def recent_region_bgc(spark, folder):
    return q.recent_region_bgc(view(spark, folder, "measurements"), "Arabian Sea", AS_OF)


@query("quality_issues", views="readings", sql="WITH fences AS (" + _fence_sql(FENCED) + """),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality_flag = 4) * 100e0 / count(*) AS bad,
             count(*) FILTER (WHERE quality_flag IN (1, 2)) * 100e0 / count(*) AS good,
             """ + ", ".join(f"(count(*) - count({c})) * 100e0 / count(*) AS gaps_{c}" for c in CHECKED) + """ FROM readings),
issues AS (
  SELECT 'issue' AS kind, printf('High percentage of bad data: %.1f%%', bad) AS message FROM s WHERE bad > 10"""
       + "".join(f"""
  UNION ALL SELECT 'issue', printf('High missing data in {c}: %.1f%%', gaps_{c}) FROM s WHERE gaps_{c} > 50""" for c in CHECKED)
       + "".join(f"""
  UNION ALL SELECT 'issue', printf('High outlier percentage in {c}: %.1f%%', share) FROM (
    SELECT count(*) FILTER (WHERE {c} < lower_bound OR {c} > upper_bound) * 100e0 / count({c}) AS share
    FROM readings, (SELECT * FROM fences WHERE "column" = '{c}')) WHERE share > 5""" for c in FENCED) + """)
SELECT * FROM issues
UNION ALL SELECT 'recommendation', 'Consider filtering out bad quality data before analysis' FROM s WHERE good < 70
UNION ALL SELECT 'recommendation', 'Data quality appears good for analysis' FROM (SELECT count(*) AS c FROM issues)
WHERE c = 0""")
def quality_issues(spark, folder):
    return k.quality_issues(view(spark, folder, "readings"))


@query("table_quality", views="readings", sql=f"""
WITH b AS (SELECT quantile_cont(temperature, 0.25) AS t1, quantile_cont(temperature, 0.75) AS t3,
                  quantile_cont(salinity, 0.25) AS s1, quantile_cont(salinity, 0.75) AS s3,
                  quantile_cont(depth, 0.25) AS d1, quantile_cont(depth, 0.75) AS d3 FROM readings),
c AS (SELECT count(*) AS n,
  ({len(READING_COLUMNS)} * count(*) - {" - ".join(f"count({c})" for c in READING_COLUMNS)}) * 100e0
    / ({len(READING_COLUMNS)} * count(*)) AS gaps,
  count(*) FILTER (WHERE temperature < t1 - 1.5e0 * (t3 - t1) OR temperature > t3 + 1.5e0 * (t3 - t1)) AS t,
  count(*) FILTER (WHERE salinity < s1 - 1.5e0 * (s3 - s1) OR salinity > s3 + 1.5e0 * (s3 - s1)) AS s,
  count(*) FILTER (WHERE depth < d1 - 1.5e0 * (d3 - d1) OR depth > d3 + 1.5e0 * (d3 - d1)) AS d
  FROM readings, b),
i AS (SELECT *, [x FOR x IN [
  CASE WHEN gaps > 50 THEN printf('High missing data: %.1f%%', gaps)
       WHEN gaps > 20 THEN printf('Moderate missing data: %.1f%%', gaps) END,
  CASE WHEN t > n * 0.05e0 THEN printf('Potential outliers in temperature: %d values', t) END,
  CASE WHEN s > n * 0.05e0 THEN printf('Potential outliers in salinity: %d values', s) END,
  CASE WHEN d > n * 0.05e0 THEN printf('Potential outliers in depth: %d values', d) END] IF x IS NOT NULL] AS l
  FROM c),
r AS (SELECT *, greatest(0e0, 1e0 - gaps / 100 - len(l) * 0.1e0) AS score FROM i)
SELECT CASE WHEN score >= 0.95e0 THEN 'excellent' WHEN score >= 0.85e0 THEN 'good' WHEN score >= 0.70e0 THEN 'fair'
       ELSE 'poor' END AS status, score, gaps AS missing_percentage, n AS total_records,
       array_to_string(l, '; ') AS issues FROM r""", doubles="score missing_percentage")
def table_quality(spark, folder):
    return k.table_quality(view(spark, folder, "readings"))


@query("extra_checks", views="measurements", sql="""
SELECT count(id) - count(DISTINCT id) AS duplicate_count,
       count(*) FILTER (WHERE time > TIMESTAMP '2001-01-01') AS future_dates,
       count(*) FILTER (WHERE abs(lat) > 90 OR abs(lon) > 180) AS invalid_coordinates,
       count(*) FILTER (WHERE temperature < -5 OR temperature > 40) AS extreme_temperatures FROM measurements""")
def extra_checks(spark, folder):
    return k.extra_checks(view(spark, folder, "measurements"), dt.datetime(2001, 1, 1))


@query("completeness", views="measurements", sql="\nUNION ALL\n".join(
       f"""SELECT '{c}' AS "column", count({c}) * 100e0 / count(*) AS complete_percentage,
       100e0 - count({c}) * 100e0 / count(*) AS missing_percentage FROM measurements""" for c in MEASUREMENT_COLUMNS),
       doubles="complete_percentage missing_percentage")
def completeness(spark, folder):
    return k.completeness(view(spark, folder, "measurements"))


REPORTED = tuple(c for c in MEASUREMENT_COLUMNS if c not in WORDS)


@query("quality_report", views="measurements", sql="""
SELECT 'dataset' AS section, 'all' AS name, 'records' AS measure, CAST(count(*) AS DOUBLE) AS value FROM measurements
UNION ALL SELECT 'dataset', 'all', 'columns', """ + str(len(MEASUREMENT_COLUMNS)) + "".join(f"""
UNION ALL SELECT 'completeness', '{c}', 'complete_percentage', count({c}) * 100e0 / count(*) FROM measurements
UNION ALL SELECT 'completeness', '{c}', 'missing_percentage', 100e0 - count({c}) * 100e0 / count(*) FROM measurements"""
       for c in MEASUREMENT_COLUMNS) + "".join(f"""
UNION ALL SELECT 'statistics', '{c}', 'min', min({c}) FROM measurements
UNION ALL SELECT 'statistics', '{c}', 'max', max({c}) FROM measurements
UNION ALL SELECT 'statistics', '{c}', 'mean', avg({c}) FROM measurements""" for c in REPORTED), doubles="value")
def quality_report(spark, folder):
    return k.quality_report(view(spark, folder, "measurements"), REPORTED)


@query("key_audit", views="float_cards casts readings", sql="""
SELECT 'duplicate float_id' AS rule, count(*) AS violations
FROM (SELECT float_id FROM float_cards GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate profile_id', count(*) FROM (SELECT profile_id FROM casts GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate measurement id', count(*) FROM (SELECT id FROM readings GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'profile without float', count(*) FROM casts WHERE float_id NOT IN (SELECT float_id FROM float_cards)
UNION ALL SELECT 'measurement without profile', count(*) FROM readings
WHERE profile_id NOT IN (SELECT profile_id FROM casts)""")
def key_audit(spark, folder):
    return a.key_audit(view(spark, folder, "float_cards"), view(spark, folder, "casts"),
                       view(spark, folder, "readings"))


@query("load_summary", views="float_cards casts readings", sql="""
SELECT (SELECT count(*) FROM float_cards) AS floats, (SELECT count(*) FROM casts) AS profiles,
       (SELECT count(*) FROM readings) AS measurements""")
def load_summary(spark, folder):
    return a.load_summary(view(spark, folder, "float_cards"), view(spark, folder, "casts"),
                          view(spark, folder, "readings"))
