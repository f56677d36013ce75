"""Exact, repeatable samples of large tables, seven strategies, with a fidelity score.

Every choice is "the n rows with the smallest score in this stratum", where the score is a hash of the row's key and
a seed.  The size of a stratum tells where its n-th smallest score must lie but for a narrow band: rows below the band are
taken in the scan, rows above it are left there, and only the band is ordered.  No stratum is ever sorted in one task, the
sample size is exact, and the result does not depend on how the table is partitioned.

Departures: the key decides instead of a generator's state; rows kept on purpose (extremes, recent rows) are
reserved before the rest is drawn, so a final cut cannot lose them; the least latitude and longitude belong to the
first spatial cell instead of to none; a bin count of zero means one bin.
"""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.columns import left_closed_bin, n_rows, right_closed_bin, seconds
from ..session import durable
from .analytics import numeric_columns
from .order import every_nth, head_rows

SEED = 42
STRATA = 10
DEFAULT_TARGET = 10_000
STRATUM_COLUMNS = ("depth", "pressure", "temperature")
DATE_NAMES, LAT_NAMES, LON_NAMES = ("date", "time"), ("latitude", "lat"), ("longitude", "lon")


class Strategy(enum.Enum):
    RANDOM = "random"
    SYSTEMATIC = "systematic"
    STRATIFIED = "stratified"
    TEMPORAL = "temporal"
    SPATIAL = "spatial"
    ADAPTIVE = "adaptive"
    IMPORTANCE = "importance"


@dataclass(frozen=True)
class SamplingConfig:
    strategy: Strategy = Strategy.RANDOM
    target_size: int = DEFAULT_TARGET
    key: str = "id"
    preserve_extremes: bool = True
    preserve_recent: bool = False
    importance_column: str | None = None
    spatial_bins: int = 10
    temporal_bins: int = 12
    quality_threshold: float = 0.8
    seed: int = SEED


def _name(df: DataFrame, names) -> str | None:
    return next((n for n in names if n in df.columns), None)


def hash_text(key: str, seed: int = SEED) -> Column:
    """32 hex digits that depend on the row's key and the seed only."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def hash_unit(key: str, seed: int = SEED) -> Column:
    """The hash as a number in (0, 1]: its first 13 hex digits, plus one, over 2^52."""
    digits = F.conv(F.substring(hash_text(key, seed), 1, 13), 16, 10).cast("bigint")
    return (digits + 1).cast("double") / F.lit(float(1 << 52))


BROADCAST_CATEGORIES = 500_000  # categories up to which their frequencies are broadcast
BAND = 6.0  # half width of the band in standard deviations of the number of scores below it
BAND_LEAST = 20


def _cuts(n: int, rows: int, width: float) -> tuple[float, float]:
    """Scores between which the n-th smallest of ``rows`` uniform ones lies."""
    if n >= rows:
        return 1.0, 1.0
    reach = width * (math.sqrt(n) + BAND_LEAST)
    return max(0.0, (n - reach) / rows), min(1.0, (n + reach) / rows)


def take_by_strata(df: DataFrame, strata, key: str, seed: int = SEED) -> DataFrame:
    """Rows that are among the smallest hashes of their stratum in any of several divisions of the table.

    ``strata`` lists (stratum, quota): a column of few values, null for rows that belong nowhere, and a function of the
    number of occupied strata.  One scan counts the strata, one takes what can matter: a sample's worth of rows, which is
    kept.  Should a band miss its border, which its width makes rare, it is widened and the scan repeated.
    """
    marked = df.withColumns({f"_s{i}": stratum.cast("int") for i, (stratum, _) in enumerate(strata)})
    each = [F.struct(F.lit(i).alias("division"), F.col(f"_s{i}").alias("stratum")) for i in range(len(strata))]
    counts = marked.select(F.inline(F.array(*each))).filter("stratum IS NOT NULL").groupBy("division", "stratum").count()
    sizes = {(r["division"], r["stratum"]): r["count"] for r in counts.collect()}  # a row per stratum
    occupied = [sum(d == i for d, _ in sizes) for i in range(len(strata))]
    if not sizes:
        return df.limit(0)
    wanted = {s: min(n, strata[s[0]][1](occupied[s[0]])) for s, n in sizes.items()}
    width = {s: BAND for s in sizes}
    unit = F.col("_u")

    def of(i: int, values: dict) -> Column:
        known = [x for (d, s), v in values.items() if d == i for x in (F.lit(s), F.lit(v))]
        return F.element_at(F.create_map(*known), F.col(f"_s{i}")) if known else F.lit(None)

    while True:
        cuts = {s: _cuts(wanted[s], sizes[s], width[s]) for s in sizes}
        low, high = ({s: c[k] for s, c in cuts.items()} for k in (0, 1))
        near = [F.coalesce(unit <= of(i, high), F.lit(False)) for i in range(len(strata))]
        sure = [F.coalesce(unit <= of(i, low), F.lit(False)) for i in range(len(strata))]
        drawn = durable(marked.withColumn("_u", hash_unit(key, seed)).filter(F.greatest(*near, F.lit(False))))
        found = drawn.select(F.inline(F.array_compact(F.array(*(F.when(near[i], F.struct(
            F.lit(i).alias("division"), F.col(f"_s{i}").alias("stratum"), sure[i].alias("sure"))) for i in range(len(strata)))))))
        got = {(r["division"], r["stratum"]): (r["n"], r["sure"]) for r in found.groupBy("division", "stratum").agg(
            n_rows().alias("n"), F.count_if("sure").alias("sure")).collect()}  # a row per stratum
        short = [s for s in sizes if got.get(s, (0, 0))[0] < wanted[s] or got.get(s, (0, 0))[1] > wanted[s]]
        if not short:
            break
        for s in short:
            width[s] *= 4
    need = {s: wanted[s] - got.get(s, (0, 0))[1] for s in sizes}
    band = [near[i] & ~sure[i] for i in range(len(strata))]
    edge = F.greatest(*band, F.lit(False))
    places = {f"_r{i}": F.row_number().over(Window.partitionBy(f"_s{i}", band[i]).orderBy(hash_text(key, seed), key)) for i in range(len(strata))}
    ranked = drawn.filter(edge).withColumns(places)
    keep = F.greatest(*[sure[i] | (band[i] & (F.col(f"_r{i}") <= of(i, need))) for i in range(len(strata))], F.lit(False))
    whole = drawn.filter(~edge).select(*df.columns)
    return whole.unionAll(ranked.filter(keep).select(*df.columns))


def _near_hash(df: DataFrame, n: int, rows: int, key: str, seed: int, keys: list) -> tuple[DataFrame, Column]:
    """Rows among which are the n of smallest hashes, with those that have one of ``keys``, kept; and which of them are the former.

    The condition asks for the key only, so that it comes before joins that others of the columns need.
    """
    width = BAND
    while True:
        low = hash_unit(key, seed) <= F.lit(_cuts(n, rows, width)[1])
        near = durable(df.filter(low | F.col(key).isin(keys) if keys else low))
        if near.filter(low).count() >= min(n, rows):
            return near, low
        width *= 4


def take_by_hash(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """The n rows of smallest hashes, or all there are: every task keeps its n first ones, in one scan."""
    return df.orderBy(hash_text(key, seed), key).limit(n)


def sample_random(df: DataFrame, c: SamplingConfig) -> DataFrame:
    return take_by_hash(df, c.target_size, c.key, seed=c.seed)


def sample_systematic(df: DataFrame, c: SamplingConfig) -> DataFrame:
    """Every (n // target)-th row in key order."""
    return every_nth(df, [c.key], c.target_size)


def _bounds(df: DataFrame, *columns: Column):
    """Min and max of each column, read to the driver: two numbers per column."""
    row = df.agg(*(f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(columns) for f in (F.min, F.max))).first()
    return [tuple(row[2 * i: 2 * i + 2]) for i in range(len(columns))]


def sample_stratified(df: DataFrame, c: SamplingConfig, bins: int = STRATA) -> DataFrame:
    """Equal-width strata of the first of depth, pressure, temperature; target // bins rows of each."""
    column = _name(df, STRATUM_COLUMNS)
    if column is None:
        return sample_random(df, c)
    ((low, high),) = _bounds(df, F.col(column))
    if low is None:
        return sample_random(df, c)
    stratum = right_closed_bin(F.col(column), F.lit(float(low)), F.lit(float(high)), bins)
    return take_by_strata(df, [(stratum, lambda _: c.target_size // bins)], c.key, c.seed)


def _time_strata(column: str, c: SamplingConfig, low, high, target: int):
    """Equal-time bins, target // bins rows of each."""
    bins = max(1, c.temporal_bins)
    return left_closed_bin(seconds(F.col(column)), F.lit(low), F.lit(high), bins), lambda _: target // bins


def _place_strata(lat: str, lon: str, c: SamplingConfig, ends, target: int):
    """A square grid of int(sqrt(bins)) cells a side; target // occupied cells rows of each, at least one."""
    side = max(1, int(math.sqrt(c.spatial_bins)))
    (south, north), (west, east) = ends
    row = right_closed_bin(F.col(lat), F.lit(float(south)), F.lit(float(north)), side)
    column = right_closed_bin(F.col(lon), F.lit(float(west)), F.lit(float(east)), side)
    return row * side + column, lambda occupied: max(1, target // occupied)


def sample_temporal(df: DataFrame, c: SamplingConfig) -> DataFrame:
    column = _name(df, DATE_NAMES)
    if column is None:
        return sample_random(df, c)
    ((low, high),) = _bounds(df, seconds(F.col(column)))
    if low is None:
        return sample_random(df, c)
    return take_by_strata(df, [_time_strata(column, c, low, high, c.target_size)], c.key, c.seed)


def sample_spatial(df: DataFrame, c: SamplingConfig) -> DataFrame:
    lat, lon = _name(df, LAT_NAMES), _name(df, LON_NAMES)
    if lat is None or lon is None:
        return sample_random(df, c)
    ends = _bounds(df, F.col(lat), F.col(lon))
    if any(low is None for low, _ in ends):
        return sample_random(df, c)
    return take_by_strata(df, [_place_strata(lat, lon, c, ends, c.target_size)], c.key, c.seed)


def sample_adaptive(df: DataFrame, c: SamplingConfig) -> DataFrame:
    """Half by place and half by time where both exist, in the same scans; otherwise the best single strategy."""
    date, lat, lon = _name(df, DATE_NAMES), _name(df, LAT_NAMES), _name(df, LON_NAMES)
    if date and lat and lon:
        half = c.target_size // 2
        *ends, (first, last) = _bounds(df, F.col(lat), F.col(lon), seconds(F.col(date)))
        if first is None or any(low is None for low, _ in ends):
            parts = sample_spatial(df, replace(c, target_size=half)).unionByName(sample_temporal(df, replace(c, target_size=half)))
        else:
            parts = take_by_strata(df, [_place_strata(lat, lon, c, ends, half), _time_strata(date, c, first, last, half)], c.key, c.seed)
        return take_by_hash(parts.dropDuplicates([c.key]), c.target_size, c.key, c.seed)
    if "depth" in df.columns:
        return sample_stratified(df, c)
    if date:
        return sample_temporal(df, c)
    return sample_spatial(df, c) if lat and lon else sample_random(df, c)


def sample_importance(df: DataFrame, c: SamplingConfig) -> DataFrame:
    """Weighted without replacement: the smallest -ln(u)/w, with u from the hash (Efraimidis and Spirakis, 2006).

    A number weighs by its distance from the mean, a category by the inverse of its frequency.  Weight zero is never
    drawn.
    """
    column = c.importance_column
    if column is None or column not in df.columns:
        return sample_random(df, c)
    if column in numeric_columns(df):
        mean = df.select(F.avg(column)).first()[0]
        if mean is None:
            return df.limit(0)
        weighted = df.withColumn("_w", F.abs(F.col(column) - F.lit(mean)))
    else:
        counts = durable(df.groupBy(column).agg(n_rows().alias("_f")))
        # a join by few categories would send each of them to one task
        counts = F.broadcast(counts) if counts.count() <= BROADCAST_CATEGORIES else counts
        weighted = df.join(counts, column).withColumn("_w", 1.0 / F.col("_f")).drop("_f").select(*df.columns, "_w")
    scored = weighted.filter(F.col("_w") > 0).withColumn("_e", -F.log(hash_unit(c.key, c.seed)) / F.col("_w"))
    return scored.orderBy("_e", c.key).limit(c.target_size).drop("_w", "_e")


STRATEGIES = {
    Strategy.RANDOM: sample_random,
    Strategy.SYSTEMATIC: sample_systematic,
    Strategy.STRATIFIED: sample_stratified,
    Strategy.TEMPORAL: sample_temporal,
    Strategy.SPATIAL: sample_spatial,
    Strategy.ADAPTIVE: sample_adaptive,
    Strategy.IMPORTANCE: sample_importance,
}


def _extremes(df: DataFrame, c: SamplingConfig, columns=None) -> list[Column]:
    """Aggregates: the keys of the least and greatest row of each numeric column."""
    key, ends = F.col(c.key), []
    for i, name in enumerate(columns or numeric_columns(df)):
        value = F.col(name).cast("double")
        there = F.col(name).isNotNull()
        ends.append(F.min_by(key, F.when(there, F.struct(value, key))).alias(f"lo{i}"))
        ends.append(F.min_by(key, F.when(there, F.struct(-value, key))).alias(f"hi{i}"))
    return ends


def extreme_keys(df: DataFrame, c: SamplingConfig, columns=None, most: int | None = None) -> list:
    """Keys of the least and greatest row of each numeric column; one aggregation.

    Among equal values the smallest key wins.  ``most`` keeps the first so many, in column order.
    """
    ends = _extremes(df, c, columns)
    if not ends:
        return []
    kept = list(dict.fromkeys(k for k in df.agg(*ends).first() if k is not None))
    return kept if most is None else kept[:most]


def preserve_extremes(df: DataFrame, c: SamplingConfig, columns=None) -> DataFrame:
    return df.filter(F.col(c.key).isin(extreme_keys(df, c, columns)))


def _newest(df: DataFrame, c: SamplingConfig, column: str, low, high) -> DataFrame:
    recent = df.filter(seconds(F.col(column)) >= F.lit(high - (high - low) * 0.1))
    return head_rows(recent, [c.key], max(1, int(c.target_size * 0.05)))


def preserve_recent(df: DataFrame, c: SamplingConfig) -> DataFrame:
    """Rows of the last tenth of the time span in key order, at most max(1, target // 20)."""
    column = _name(df, DATE_NAMES)
    if column is None:
        return df.limit(0)
    ((low, high),) = _bounds(df, seconds(F.col(column)))
    return df.limit(0) if low is None else _newest(df, c, column, low, high)


def sample(df: DataFrame, c: SamplingConfig) -> DataFrame:
    """The whole procedure: strategy, rows kept on purpose, no duplicates, never more than the target.

    A table no larger than the target comes back unchanged.  A first pass needs the time only and counts the rows; extremes and recent
    rows are found in one job, where a joined table is shuffled once; a random sample and the rows of the extremes are read
    in one pass, which leaves out by key what cannot be among them.
    """
    date = _name(df, DATE_NAMES) if c.preserve_recent else None
    ends = _extremes(df, c) if c.preserve_extremes else []
    span = [f(seconds(F.col(date))) for f in (F.min, F.max)] if date else []
    rows, *bounds = df.agg(n_rows(), *span).first()
    if rows <= c.target_size:
        return df
    newest = _newest(df, c, date, *bounds) if span and bounds[0] is not None else df.limit(0)
    row = F.struct(*df.columns)
    found = newest.select(F.lit(None).cast(ArrayType(df.schema[c.key].dataType)).alias("_keys"), row.alias("_row"))
    if ends:
        found = found.unionAll(df.agg(F.array(*ends).alias("_keys")).select("_keys", F.lit(None).cast(df.schema).alias("_row")))
    found = durable(found)
    keys = [k for r in found.filter("_keys IS NOT NULL").collect() for k in dict.fromkeys(r["_keys"]) if k is not None]  # two a column
    if c.strategy is Strategy.RANDOM or (c.strategy is Strategy.IMPORTANCE and c.importance_column not in df.columns):
        near, unit = _near_hash(df, c.target_size, rows, c.key, c.seed, keys)
        drawn, extremes = take_by_hash(near.filter(unit), c.target_size, c.key, c.seed), near.filter(F.col(c.key).isin(keys))
    else:
        drawn, extremes = STRATEGIES[c.strategy](df, c), df.filter(F.col(c.key).isin(keys))
    drawn = drawn.withColumn("_kept", F.lit(1))
    if span:
        drawn = found.filter("_row IS NOT NULL").select("_row.*").withColumn("_kept", F.lit(0)).unionByName(drawn)
    if keys:
        drawn = extremes.withColumn("_kept", F.lit(0)).unionByName(drawn)
    # one row per key, those kept on purpose first in line for the cut
    rest = [n for n in df.columns if n != c.key]
    once = drawn.groupBy(c.key).agg(F.min("_kept").alias("_kept"), F.any_value(F.struct(*rest)).alias("_row"))
    once = once.select(c.key, "_row.*", "_kept").select(*df.columns, "_kept")
    return once.orderBy("_kept", hash_text(c.key, c.seed), c.key).limit(c.target_size).drop("_kept")


def sample_quality(df: DataFrame, sampled: DataFrame, columns=None) -> DataFrame:
    """Fidelity 0..1 in one row: mean, spread and range of each numeric column, each clipped and averaged.

    0 for an empty sample, 0.5 without a numeric column.
    """
    columns = [n for n in (columns or numeric_columns(df)) if n in sampled.columns]
    if not columns:
        return sampled.agg(F.when(n_rows() == 0, 0.0).otherwise(0.5).alias("quality_score"))

    def facts(frame: DataFrame) -> DataFrame:
        return frame.agg(n_rows().alias("n"), *(
            F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"),
                     (F.max(c) - F.min(c)).cast("double").alias("r")).alias(f"c{i}")
            for i, c in enumerate(columns))).select(F.struct("*").alias("facts"))

    both = df.sparkSession.sql("SELECT (SELECT facts FROM {a}) AS a, (SELECT facts FROM {b}) AS b",
                               a=facts(df), b=facts(sampled))
    tiny, scores = F.lit(1e-10), []
    for i in range(len(columns)):
        a, b = F.col(f"a.c{i}"), F.col(f"b.c{i}")
        mean = 1.0 - F.abs(a["m"] - b["m"]) / (F.abs(a["m"]) + tiny)
        spread = 1.0 - F.abs(a["s"] - b["s"]) / (F.abs(a["s"]) + tiny)
        reach = F.least(a["r"], b["r"]) / (F.greatest(a["r"], b["r"]) + tiny)
        scores.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean + spread + reach) / 3)))
    total = sum(scores[1:], scores[0]) / float(len(scores))
    return both.select(F.when(F.col("b.n") == 0, 0.0).otherwise(total).alias("quality_score"))


def sample_report(df: DataFrame, sampled: DataFrame, c: SamplingConfig) -> DataFrame:
    """Sizes, ratio, strategy and fidelity in one row."""
    sizes = df.sparkSession.sql(
        "SELECT (SELECT count(*) FROM {a}) AS original_size, (SELECT count(*) FROM {b}) AS sampled_size, "
        "(SELECT quality_score FROM {q}) AS quality_score",
        a=df, b=sampled, q=sample_quality(df, sampled, [n for n in numeric_columns(df)]),
    )
    return sizes.select(
        "original_size", "sampled_size", F.try_divide("sampled_size", "original_size").alias("sampling_ratio"),
        F.lit(c.strategy.value).alias("strategy_used"), "quality_score",
    )


def recommend(df: DataFrame, target_size: int, key: str = "id", rows: int | None = None) -> SamplingConfig:
    """Strategy and bin counts from the columns at hand and the size of the table."""
    rows = df.count() if rows is None else rows
    timed = _name(df, DATE_NAMES) is not None
    placed = _name(df, LAT_NAMES) is not None and _name(df, LON_NAMES) is not None
    if rows == 0 or target_size / rows > 0.5:
        strategy = Strategy.RANDOM
    elif placed and timed:
        strategy = Strategy.ADAPTIVE
    elif "depth" in df.columns:
        strategy = Strategy.STRATIFIED
    elif timed:
        strategy = Strategy.TEMPORAL
    elif placed:
        strategy = Strategy.SPATIAL
    else:
        strategy = Strategy.SYSTEMATIC
    return SamplingConfig(
        strategy, target_size, key, preserve_extremes=True, preserve_recent=timed,
        spatial_bins=max(1, min(20, int(math.sqrt(rows / 100)))), temporal_bins=max(1, min(24, rows // 1000)),
        quality_threshold=0.8 if "quality_flag" in df.columns else 0.5,
    )


def load_sampled(df: DataFrame, target_size: int = DEFAULT_TARGET, strategy: Strategy | None = None,
                 key: str = "id") -> DataFrame:
    """The table itself while it is small enough, otherwise a sample by the given or the recommended strategy."""
    rows = df.count()
    if rows <= target_size:
        return df
    if strategy is not None:
        return sample(df, SamplingConfig(strategy, target_size, key))
    return sample(df, recommend(df, target_size, key, rows))


def thin_scatter(df: DataFrame, x: str, y: str, color: str | None = None, max_points: int = DEFAULT_TARGET,
                 key: str = "id") -> DataFrame:
    """Points for a scatter plot: a random sample that keeps the extremes."""
    wanted = list(dict.fromkeys([key, x, y] + ([color] if color else [])))
    return sample(df.select(*wanted), SamplingConfig(Strategy.RANDOM, max_points, key))


def thin_lines(df: DataFrame, x: str, y: str, group: str | None = None, max_points: int = DEFAULT_TARGET,
               key: str = "id") -> DataFrame:
    """Points for line plots: every n-th row of each line, plus the rows where x or y is extreme in that line."""
    by = [group] if group else []
    rows = df.select(*dict.fromkeys([*by, key, x, y]))
    thinned = every_nth(rows, [key], max_points, by)
    ends = [
        f(key, F.when(F.col(c).isNotNull(), F.struct(F.col(c), F.col(key)))).alias(f"{f.__name__}_{c}")
        for c in (x, y) for f in (F.min_by, F.max_by)
    ]
    sizes = rows.groupBy(*by).agg(n_rows().alias("_n"), F.array_distinct(F.array(*ends)).alias("_k"))
    kept = sizes.filter(F.col("_n") > max_points).select(*by, F.explode("_k").alias(key))
    extra = rows.join(kept, [*by, key], "left_semi")
    both = thinned.withColumn("_kept", F.lit(1)).unionByName(extra.withColumn("_kept", F.lit(0)))
    once = both.groupBy(*by, key).agg(F.min("_kept").alias("_kept"), *(F.any_value(c).alias(c) for c in {x, y} - {key}))
    # a line holds at most max_points rows and four extremes here, so the window stays small
    line = Window.partitionBy(*by).orderBy("_kept", hash_text(key), key)
    cut = once.withColumn("_r", F.row_number().over(line)).filter((F.col("_r") <= max_points)).drop("_r", "_kept")
    return cut.orderBy(*by, x, key)
