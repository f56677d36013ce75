"""Filter state to one pushed-down predicate, and the before/after funnel in a single aggregation."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import predicates as p

READINGS = ("temperature", "salinity", "oxygen", "ph", "chlorophyll")


@dataclass(frozen=True)
class Filters:
    """Everything a user can set; an unset field filters nothing."""

    dates: tuple[dt.date, dt.date] | None = None
    relative_days: int | None = None
    months: tuple[int, ...] = ()
    years: tuple[int, ...] = ()
    time_of_day: tuple[dt.time, dt.time] | None = None
    zone: str = "UTC"
    max_age_days: int | None = None
    box: dict[str, float] | None = None
    region: str | None = None
    circle: tuple[float, float, float] | None = None
    valid_places: bool = False
    depths: tuple[float, float] | None = None
    depth_text: str | None = None
    temperature: tuple[float, float] | None = None
    salinity: tuple[float, float] | None = None
    oxygen: tuple[float, float] | None = None
    ph: tuple[float, float] | None = None
    chlorophyll: tuple[float, float] | None = None
    float_ids: tuple = ()
    cycles: tuple[int, int] | None = None
    min_completeness: float | None = None
    as_of: dt.datetime | None = None

    def active_groups(self) -> int:
        """How many of the four groups (time, place, physical, technical) are in use: 0 to 4."""
        groups = (
            (self.dates, self.relative_days, self.months, self.years, self.time_of_day, self.max_age_days),
            (self.box, self.region, self.circle, self.valid_places),
            (self.depths, self.depth_text, self.temperature, self.salinity, self.oxygen, self.ph, self.chlorophyll),
            (self.float_ids, self.cycles, self.min_completeness),
        )
        return sum(any(value not in (None, (), False) for value in group) for group in groups)


def _pick(columns, *names: str) -> Column | None:
    return next((F.col(n) for n in names if n in columns), None)


def predicates(columns: list[str], f: Filters) -> list[tuple[str, Column]]:
    """Named predicates in the order time, place, physical, technical; those without their column are left out."""
    found: list[tuple[str, Column]] = []
    ts = _pick(columns, "time", "profile_date", "date", "ts")
    lat, lon = _pick(columns, "lat", "latitude"), _pick(columns, "lon", "longitude")

    def add(name: str, wanted, predicate) -> None:
        if wanted:
            found.append((name, predicate()))

    if ts is not None:
        add("date range", f.dates, lambda: p.within_dates(ts, *f.dates))
        add("relative period", f.relative_days and f.as_of, lambda: p.since_days(ts, f.as_of, f.relative_days))
        add("months", f.months and f.years, lambda: p.months_and_years(ts, f.months, f.years))
        add("time of day", f.time_of_day, lambda: p.time_of_day(ts, *f.time_of_day, f.zone))
        add("data age", f.max_age_days and f.as_of, lambda: p.since_days(ts, f.as_of, f.max_age_days))
    if lat is not None and lon is not None:
        sides = ("north", "south", "east", "west")
        whole = f.box is not None and all(side in f.box for side in sides)
        add("box", whole, lambda: p.in_box(lat, lon, *(f.box[side] for side in sides)))
        add("region", f.region in labels.REGIONS, lambda: p.in_region(lat, lon, f.region))
        add("circle", f.circle, lambda: p.in_circle(lat, lon, *f.circle))
        add("valid place", f.valid_places, lambda: p.valid_place(lat, lon))
    if "depth" in columns:
        add("depth", f.depths, lambda: F.col("depth").between(*f.depths))
        add("depth levels", f.depth_text is not None, lambda: p.depth_levels(F.col("depth"), f.depth_text))
    for name in READINGS:
        bounds = getattr(f, name)
        if name in columns:
            add(name, bounds, lambda name=name, bounds=bounds: F.col(name).between(*bounds))
    if "float_id" in columns:
        add("float ids", f.float_ids, lambda: F.col("float_id").isin(list(f.float_ids)))
    if "cycle_number" in columns:
        add("cycles", f.cycles, lambda: F.col("cycle_number").between(*f.cycles))
    present = [F.col(c) for c in READINGS if c in columns]
    if present:
        add("completeness", f.min_completeness is not None, lambda: p.completeness(*present) >= f.min_completeness)
    return found


def apply_filters(df: DataFrame, f: Filters) -> DataFrame:
    """One conjunction, so that the optimizer can push every part of it to the scan."""
    found = [predicate for _, predicate in predicates(df.columns, f)]
    return df.filter(reduce(lambda a, b: a & b, found)) if found else df


def filter_funnel(df: DataFrame, f: Filters) -> DataFrame:
    """Rows before and after each filter step: one pass with conditional counts, not one pass per step."""
    found = predicates(df.columns, f)
    counts, passed = [F.count(F.lit(1)).alias("c0")], F.lit(True)
    for i, (_, predicate) in enumerate(found, 1):
        passed = passed & predicate
        counts.append(F.count_if(passed).alias(f"c{i}"))
    steps = F.array(
        *(
            F.struct(F.lit(i).alias("step"), F.lit(name).alias("filter"),
                     F.col(f"c{i - 1}").alias("before"), F.col(f"c{i}").alias("after"))
            for i, (name, _) in enumerate(found, 1)
        )
    )
    return df.agg(*counts).select(F.inline(steps))


def in_named_regions(df: DataFrame, names=tuple(labels.REGIONS)) -> DataFrame:
    """Rows tagged with every named region they lie in; boxes overlap, so a row may come back more than once.

    Five literal boxes are tested inside the scan stage; there is no join and no shuffle.
    """
    tags = F.array_compact(
        F.array(*(F.when(p.in_region(F.col("lat"), F.col("lon"), n), F.lit(n)) for n in names))
    )
    return df.withColumn("region", F.explode(tags))


def by_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in another table, of any length; the engine broadcasts it only when it is small."""
    return df.join(listed.select(key).distinct(), key, "left_semi")


def by_fleet(df: DataFrame, floats: DataFrame, wmo_ids: DataFrame | None = None, active_only: bool = False,
             recent_days: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
    """Rows of floats chosen by WMO list, status and last contact."""
    chosen = floats
    if wmo_ids is not None:
        chosen = by_listed(chosen, wmo_ids, "wmo_id")
    if active_only:
        chosen = chosen.filter(F.col("status") == "ACTIVE")
    if recent_days is not None:
        day = (as_of - dt.timedelta(days=recent_days)).date().isoformat()
        chosen = chosen.filter(F.col("last_contact") >= F.lit(day).cast("date"))
    return df.join(chosen.select("float_id"), "float_id", "left_semi")


def float_quality_levels(df: DataFrame, columns=READINGS) -> DataFrame:
    """Completeness 0..1 per float and its level name."""
    cells = sum((F.count(c) for c in columns[1:]), F.count(columns[0]))
    share = cells / (F.count(F.lit(1)) * F.lit(float(len(columns))))
    return df.groupBy("float_id").agg(share.alias("completeness")).withColumn(
        "quality_level", labels.quality_level(F.col("completeness"))
    )


def by_quality_level(df: DataFrame, levels, columns=READINGS) -> DataFrame:
    """Rows of floats whose completeness lies in one of the named levels."""
    chosen = float_quality_levels(df, columns).filter(F.col("quality_level").isin(list(levels)))
    return df.join(chosen.select("float_id"), "float_id", "left_semi")
