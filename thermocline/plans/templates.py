"""Lookups, fixed templates, totals and parameter statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import analytics as a
from ..operators import joins as j
from ..sources.binding import view
from .registry import query

PARAMETERS = ("temperature", "salinity", "oxygen", "ph", "chlorophyll", "pressure")



def _between(column: str, bounds) -> str:
    return f"{column} BETWEEN {bounds[0]} AND {bounds[1]}"


def _ladder_sql(column: str, steps, last: str) -> str:
    """The first step whose bound is above the value; a null falls through."""
    return "CASE " + " ".join(f"WHEN {column} < {bound} THEN '{name}'" for bound, name in steps) + f" ELSE '{last}' END"


BASIN_SQL = f"""CASE WHEN {_between('lon', labels.INDIAN[0])} AND {_between('lat', labels.INDIAN[1])} THEN 'Indian Ocean'
            WHEN {' OR '.join(_between('lon', strip) for strip in labels.PACIFIC)} THEN 'Pacific Ocean'
            WHEN {_between('lon', labels.ATLANTIC)} THEN 'Atlantic Ocean' ELSE 'Other' END"""
BAND_SQL = _ladder_sql("depth", labels.DEPTH_BANDS, labels.DEEPEST_BAND)
ZONE_SQL = _ladder_sql("depth", labels.OCEAN_ZONES, labels.DEEPEST_ZONE)


@query("profiles_by_ids", views="measurements casts float_cards", sql="""
SELECT m.id, m.time, m.lat, m.lon, m.depth, m.temperature, m.salinity, m.oxygen, m.ph, m.chlorophyll,
       m.float_id, m.profile_id, p.cycle_number, f.wmo_id
FROM measurements m JOIN casts p ON m.profile_id = p.profile_id JOIN float_cards f ON m.float_id = f.float_id
WHERE m.id IN (SELECT id FROM measurements WHERE quality_flag = 4 AND temperature IS NULL)""",
       doubles="temperature salinity oxygen ph chlorophyll lat lon")
def profiles_by_ids(spark, folder):
    """The listed ids are those of flagged measurements without a temperature: a list that grows with the data."""
    wanted = view(spark, folder, "readings").filter("quality_flag = 4 AND temperature IS NULL").select("id")
    casts, found = view(spark, folder, "casts"), j.rows_by_ids(view(spark, folder, "readings"), wanted)
    return j.with_numbers(j.placed_readings(found, casts), casts, view(spark, folder, "float_cards"))


@query("float_summary", views="readings casts floats", sql="""
WITH warm AS (SELECT float_id, profile_id, depth, temperature, salinity FROM readings JOIN casts USING (profile_id) WHERE temperature IS NOT NULL),
totals AS (SELECT float_id, count(DISTINCT profile_id) AS total_profiles, count(*) AS total_measurements,
                  sum(temperature) / count(*) AS avg_temperature, sum(salinity) / count(salinity) AS avg_salinity,
                  min(depth) AS min_depth, max(depth) AS max_depth FROM warm GROUP BY float_id)
SELECT float_id, wmo_id, deployment_date, totals.* EXCLUDE (float_id) FROM totals JOIN floats USING (float_id)
QUALIFY row_number() OVER (ORDER BY total_measurements DESC, float_id) <= 50""",
       doubles="avg_temperature avg_salinity min_depth max_depth", dates="deployment_date")
def float_summary(spark, folder):
    return j.float_summary(view(spark, folder, "floats"), view(spark, folder, "casts"),
                           view(spark, folder, "readings"))


@query("measurement_context", views="measurements profiles floats", sql="""
SELECT m.profile_id, m.float_id, m.id, m.time, m.lat, m.lon, m.depth, m.temperature, m.salinity, m.oxygen, m.ph,
       m.chlorophyll, p.cycle_number, p.profile_date, p.n_levels, f.wmo_id, f.deployment_date
FROM measurements m JOIN profiles p ON m.profile_id = p.profile_id JOIN floats f ON m.float_id = f.float_id""",
       doubles="temperature salinity oxygen ph chlorophyll lat lon", dates="deployment_date")
def measurement_context(spark, folder):
    return j.readings_context(view(spark, folder, "readings"), view(spark, folder, "profiles"), view(spark, folder, "floats"))


PROFILE_SUMMARY_SQL = """
SELECT p.profile_id, p.float_id, p.cycle_number, p.profile_date, p.profile_lat, p.profile_lon, p.n_levels, f.wmo_id,
       avg(m.temperature) AS avg_temp, min(m.temperature) AS min_temp, max(m.temperature) AS max_temp,
       avg(m.salinity) AS avg_sal, min(m.salinity) AS min_sal, max(m.salinity) AS max_sal,
       min(m.depth) AS min_depth, max(m.depth) AS max_depth, avg(m.oxygen) AS avg_oxygen, avg(m.ph) AS avg_ph,
       avg(m.chlorophyll) AS avg_chlorophyll
FROM profiles p JOIN float_cards f ON p.float_id = f.float_id JOIN readings m ON p.profile_id = m.profile_id
GROUP BY ALL"""


@query("profile_summary", views="profiles float_cards readings", sql=PROFILE_SUMMARY_SQL,
       doubles="profile_lat profile_lon avg_temp min_temp max_temp avg_sal min_sal max_sal min_depth max_depth "
               "avg_oxygen avg_ph avg_chlorophyll")
def profile_summary(spark, folder):
    return j.profile_summary(view(spark, folder, "profiles"), view(spark, folder, "float_cards"),
                             view(spark, folder, "readings"))


@query("profile_measurement_counts", views="casts readings", sql="""
SELECT p.float_id, p.cycle_number, p.profile_date, count(m.id) AS measurement_count,
       avg(m.temperature) AS avg_temp, avg(m.salinity) AS avg_salinity
FROM casts p JOIN readings m ON p.profile_id = m.profile_id
GROUP BY ALL ORDER BY p.profile_date, p.float_id, p.cycle_number LIMIT 10""", doubles="avg_temp avg_salinity")
def profile_measurement_counts(spark, folder):
    return j.profile_measurement_counts(view(spark, folder, "casts"), view(spark, folder, "readings"))


@query("float_profiles", views="profiles", sql="""
SELECT * FROM profiles WHERE float_id = (
  SELECT float_id FROM profiles GROUP BY float_id ORDER BY count(*) DESC, float_id LIMIT 1)""",
       doubles="profile_lat profile_lon")
def float_profiles(spark, folder):
    """Of the float with the most profiles."""
    casts = view(spark, folder, "casts")
    busiest = casts.groupBy("float_id").count().orderBy(F.desc("count"), "float_id").first()["float_id"]
    return j.float_profiles(view(spark, folder, "profiles"), busiest)


@query("avg_by_depth", views="readings", sql="""
SELECT depth, avg(temperature) AS avg_temperature, avg(salinity) AS avg_salinity, count(*) AS measurement_count
FROM readings WHERE temperature IS NOT NULL AND salinity IS NOT NULL GROUP BY depth ORDER BY depth LIMIT 100""",
       doubles="depth avg_temperature avg_salinity")
def avg_by_depth(spark, folder):
    return a.avg_by_depth(view(spark, folder, "readings"))


@query("dataset_comparison", views="measurements", sql="""
SELECT dataset_type, count(*) AS observation_count, avg(temperature) AS avg_temperature,
       avg(salinity) AS avg_salinity, min(time) AS start_date, max(time) AS end_date
FROM measurements GROUP BY dataset_type""", doubles="avg_temperature avg_salinity")
def dataset_comparison(spark, folder):
    return a.dataset_comparison(view(spark, folder, "readings"), view(spark, folder, "casts"))


@query("regional_comparison", views="measurements", sql=f"""
SELECT {BASIN_SQL} AS region, round(avg(temperature), 2) AS avg_temperature, round(avg(salinity), 2) AS avg_salinity,
       round(avg(oxygen), 2) AS avg_oxygen, count(*) AS measurement_count, round(min(depth), 0) AS min_depth_m,
       round(max(depth), 0) AS max_depth_m
FROM measurements WHERE temperature IS NOT NULL GROUP BY 1""",
       doubles="avg_temperature avg_salinity avg_oxygen min_depth_m max_depth_m")
def regional_comparison(spark, folder):
    return a.regional_comparison(view(spark, folder, "readings"), view(spark, folder, "casts"))


@query("depth_ranges", views="readings", sql=f"""
WITH banded AS (SELECT *, {BAND_SQL} AS depth_range FROM readings)
SELECT depth_range, sum(temperature) / count(*) AS avg_temperature, sum(salinity) / count(salinity) AS avg_salinity,
       sum(oxygen) / nullif(count(oxygen), 0) AS avg_oxygen, count(*) AS measurement_count
FROM banded WHERE temperature IS NOT NULL GROUP BY depth_range""", doubles="avg_temperature avg_salinity avg_oxygen")
def depth_ranges(spark, folder):
    return a.depth_ranges(view(spark, folder, "readings"))


@query("temporal_trends", views="measurements", sql="""
SELECT CAST(date_trunc('month', time) AS TIMESTAMP) AS month, avg(temperature) AS avg_temperature,
       avg(salinity) AS avg_salinity, count(*) AS measurement_count
FROM measurements WHERE temperature IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 100""",
       doubles="avg_temperature avg_salinity")
def temporal_trends(spark, folder):
    return a.temporal_trends(view(spark, folder, "readings"), casts=view(spark, folder, "casts"))


@query("bgc_zones", views="readings", sql=f"""
WITH known AS (SELECT {ZONE_SQL} AS ocean_zone, oxygen, ph, chlorophyll FROM readings WHERE oxygen + ph IS NOT NULL)
SELECT ocean_zone, sum(oxygen) / count(*) AS avg_oxygen, sum(ph) / count(*) AS avg_ph,
       sum(chlorophyll) / nullif(count(chlorophyll), 0) AS avg_chlorophyll, count(*) AS measurement_count
FROM known GROUP BY ocean_zone""", doubles="avg_oxygen avg_ph avg_chlorophyll")
def bgc_zones(spark, folder):
    return a.bgc_zones(view(spark, folder, "readings"))


@query("system_statistics", views="float_cards casts readings", sql="""
SELECT (SELECT count(DISTINCT float_id) FROM float_cards) AS active_floats,
       (SELECT count(*) FROM casts) AS total_profiles, (SELECT count(*) FROM readings) AS total_measurements,
       (SELECT round(avg(temperature), 2) FROM readings) AS avg_temperature,
       (SELECT round(avg(salinity), 2) FROM readings) AS avg_salinity, CAST(95.0 AS DOUBLE) AS data_quality""",
       doubles="avg_temperature avg_salinity data_quality")
def system_statistics(spark, folder):
    return a.system_statistics(view(spark, folder, "float_cards"), view(spark, folder, "casts"),
                               view(spark, folder, "readings"))


@query("float_card", views="floats casts readings", sql="""
SELECT f.*, coalesce(total_profiles, 0) AS total_profiles, first_profile, last_profile,
       coalesce(total_measurements, 0) AS total_measurements, min_depth, max_depth, avg_temp, avg_sal
FROM floats f
LEFT JOIN (SELECT float_id, count(*) AS total_profiles, min(profile_date) AS first_profile,
                  max(profile_date) AS last_profile FROM casts GROUP BY float_id) p ON f.float_id = p.float_id
LEFT JOIN (SELECT c.float_id, count(*) AS total_measurements, min(depth) AS min_depth, max(depth) AS max_depth,
                  avg(temperature) AS avg_temp, avg(salinity) AS avg_sal
           FROM readings r JOIN casts c ON r.profile_id = c.profile_id GROUP BY c.float_id) m
  ON f.float_id = m.float_id""", doubles="min_depth max_depth avg_temp avg_sal",
       dates="deployment_date last_contact")
def float_card(spark, folder):
    return a.float_card(view(spark, folder, "floats"), view(spark, folder, "casts"), view(spark, folder, "readings"))


@query("dataset_summary", views="measurements", sql="""
SELECT count(DISTINCT float_id) AS total_floats, count(DISTINCT profile_id) AS total_profiles,
       count(*) AS total_measurements, min(time) AS "start", max(time) AS "end",
       date_diff('day', CAST(min(time) AS DATE), CAST(max(time) AS DATE)) AS span_days,
       min(lat) AS lat_min, max(lat) AS lat_max, max(lat) - min(lat) AS lat_span,
       min(lon) AS lon_min, max(lon) AS lon_max, max(lon) - min(lon) AS lon_span,
       min(depth) AS min_depth, max(depth) AS max_depth, max(depth) - min(depth) AS depth_span,
       avg(depth) AS mean_depth,
       count(*) FILTER (WHERE quality_flag IN (1, 2)) * 100e0 / count(*) AS good_data_percentage
FROM measurements""", doubles="lat_min lat_max lat_span lon_min lon_max lon_span min_depth max_depth depth_span "
                              "mean_depth good_data_percentage")
def dataset_summary(spark, folder):
    return a.coverage_of_readings(view(spark, folder, "readings"), view(spark, folder, "casts"))


def _statistics_sql(parameters) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS parameter, count({c}) AS "count", avg({c}) AS mean, quantile_cont({c}, 0.5) AS median,
       stddev_samp({c}) AS std, min({c}) AS "min", max({c}) AS "max", quantile_cont({c}, 0.25) AS q25,
       quantile_cont({c}, 0.75) AS q75, max({c}) - min({c}) AS "range",
       CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}) / avg({c}) ELSE 0 END AS coefficient_of_variation
FROM readings""" for c in parameters)


@query("parameter_statistics", views="readings", sql=_statistics_sql(PARAMETERS),
       doubles="mean median std min max q25 q75 range coefficient_of_variation")
def parameter_statistics(spark, folder):
    return a.parameter_statistics(view(spark, folder, "readings"), PARAMETERS)


@query("data_summary", views="readings", sql="SELECT parameter, mean, median, std, \"min\", \"max\", \"count\" FROM ("
       + _statistics_sql(a.SUMMARY_COLUMNS) + ")", doubles="mean median std min max")
def data_summary(spark, folder):
    return a.data_summary(view(spark, folder, "readings"))


@query("data_totals", views="measurements", sql="""
SELECT count(*) AS total_records, 15 AS total_columns, 12 AS numeric_columns, min(time) AS first_time, max(time) AS last_time
FROM measurements""", dates="first_time last_time")
def data_totals(spark, folder):
    return a.data_totals(view(spark, folder, "measurements"))


@query("flag_distribution", views="readings", sql="""
SELECT quality_flag, count(*) AS flag_count,
       CASE quality_flag WHEN 1 THEN 'Good data' WHEN 2 THEN 'Probably good data' WHEN 4 THEN 'Bad data'
            ELSE 'Unknown' END AS flag_label
FROM readings GROUP BY quality_flag""")
def flag_distribution(spark, folder):
    return a.flag_distribution(view(spark, folder, "readings"))


NUMBERS = ("profile_id", "depth", "pressure", "temperature", "salinity", "oxygen", "ph", "chlorophyll", "quality_flag", "float_id",
           "lat", "lon")
HAS_NULLS = "count(*) > least(" + ", ".join(f"count({c})" for c in (*NUMBERS, "id", "dataset_type", "time")) + ")"


@query("result_summary", views="measurements", sql="\nUNION ALL\n".join(
       f"""SELECT count(*) AS total_rows, 15 AS total_columns, 12 AS numeric_columns, {HAS_NULLS}
       AS has_nulls, '{c}' AS "column", avg({c}) AS mean, CAST(min({c}) AS DOUBLE) AS "min",
       CAST(max({c}) AS DOUBLE) AS "max", count({c}) AS "count" FROM measurements"""
       for c in NUMBERS), doubles="mean min max")
def result_summary(spark, folder):
    return a.result_summary(view(spark, folder, "measurements"))


@query("profile_sigma_band", views="measurements", sql="""
SELECT float_id, mt AS mean_temperature, ms AS mean_salinity, st AS std_temperature, ss AS std_salinity,
       mt - st AS temperature_low, mt + st AS temperature_high, ms - ss AS salinity_low, ms + ss AS salinity_high
FROM (SELECT float_id, avg(temperature) AS mt, avg(salinity) AS ms, stddev_samp(temperature) AS st,
             stddev_samp(salinity) AS ss FROM measurements GROUP BY float_id)""",
       doubles="mean_temperature mean_salinity std_temperature std_salinity temperature_low temperature_high "
               "salinity_low salinity_high")
def profile_sigma_band(spark, folder):
    return a.sigma_band_of_readings(view(spark, folder, "readings"), view(spark, folder, "casts"))


@query("selection_metrics", views="measurements", sql="""
SELECT count(*) AS row_count, count(DISTINCT float_id) AS float_count, max(depth) AS max_depth FROM measurements""",
       doubles="max_depth")
def selection_metrics(spark, folder):
    return a.selection_metrics(view(spark, folder, "readings"), view(spark, folder, "casts"))
