"""Filters as column predicates.

Each one is sargable where it can be (plain comparisons of a column with literals), so that partition pruning
and Parquet statistics apply.  Ranges are closed at both ends and a null never passes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import REGIONS

# --- fixed values -----------------------------------------------------------------------------------------
RELATIVE_DAYS = {
    "Last 7 days": 7,
    "Last 30 days": 30,
    "Last 90 days": 90,
    "Last 6 months": 180,
    "Last year": 365,
    "Last 2 years": 730,
}
AGE_DAYS = (1, 7, 30, 90, 365)
DEPTH_PRESETS = {"Surface": (0.0, 50.0), "Deep": (500.0, 2000.0)}
DEFAULT_DEPTHS = (0.0, 1000.0)
DEFAULT_CYCLES = (1, 200)
TIME_ZONES = {"UTC": "UTC", "IST": "Asia/Kolkata"}
KM_PER_DEGREE = 111
# ----------------------------------------------------------------------------------------------------------


def _stamp(day: dt.date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def within_dates(ts: Column, first: dt.date, last: dt.date) -> Column:
    """Calendar dates ``first`` to ``last`` inclusive, as a half-open range on the raw timestamp."""
    return (ts >= _stamp(first)) & (ts < _stamp(last + dt.timedelta(days=1)))


def since_days(ts: Column, as_of: dt.datetime, days: int) -> Column:
    return ts >= F.lit((as_of - dt.timedelta(days=days)).isoformat(sep=" ")).cast("timestamp_ntz")


def months_and_years(ts: Column, months, years) -> Column:
    """Month and year lists; the years also bound the raw timestamp so that files can be skipped."""
    months, years = sorted(months), sorted(years)
    span = within_dates(ts, dt.date(years[0], 1, 1), dt.date(years[-1], 12, 31))
    return span & F.month(ts).isin(months) & F.year(ts).isin(years)


def time_of_day(ts: Column, start: dt.time, end: dt.time, zone: str = "UTC") -> Column:
    """Clock time in ``zone`` between both ends; a range that ends before it starts runs over midnight.

    "Local" is the session's zone.
    """
    target = F.current_timezone() if zone == "Local" else F.lit(TIME_ZONES.get(zone, zone))
    local = F.convert_timezone(F.lit("UTC"), target, ts)
    clock = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    a = start.hour * 3600 + start.minute * 60 + start.second
    b = end.hour * 3600 + end.minute * 60 + end.second
    return clock.between(a, b) if a <= b else (clock >= a) | (clock <= b)


def in_box(lat: Column, lon: Column, north: float, south: float, east: float, west: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def in_region(lat: Column, lon: Column, name: str) -> Column:
    return in_box(lat, lon, *REGIONS[name])


def planar_km(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    return F.sqrt((lat - at_lat) * (lat - at_lat) + (lon - at_lon) * (lon - at_lon)) * KM_PER_DEGREE


def in_circle(lat: Column, lon: Column, at_lat: float, at_lon: float, radius_km: float) -> Column:
    """Planar circle; the enclosing box comes first because only that part can skip files."""
    reach = radius_km / KM_PER_DEGREE * (1 + 1e-9)
    box = in_box(lat, lon, at_lat + reach, at_lat - reach, at_lon + reach, at_lon - reach)
    return box & (planar_km(lat, lon, at_lat, at_lon) <= radius_km)


def valid_place(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def depth_levels(depth: Column, text: str) -> Column:
    """Comma-separated depths; text that does not parse means the default range."""
    try:
        levels = [float(part) for part in text.split(",") if part.strip()]
    except ValueError:
        levels = []
    return depth.isin(levels) if levels else depth.between(*DEFAULT_DEPTHS)


def completeness(*columns: Column) -> Column:
    """Share 0..1 of non-null values among ``columns`` in one row."""
    present = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    return present / F.lit(float(len(columns)))
