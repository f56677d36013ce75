"""Row positions, paging, decimation, latest rows and trajectories.

A table has no order of its own here, so every operator that depends on one takes the columns that define it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros, packed_order
from ..functions.predicates import valid_place
from ..session import durable

_BITS = 33  # monotonically_increasing_id: partition number above, position in the partition below


def with_rank(df: DataFrame, order, name: str = "rank") -> DataFrame:
    """Zero-based position of every row in the given order, computed without a single-task sort.

    The rows are range-partitioned and sorted, written to the shared checkpoint folder so that both passes see
    the same partitions, and numbered inside each partition; the start of each partition is a running sum over
    one count per partition.  Ties in a hot value are split as long as ``order`` is unique.
    """
    spot = F.monotonically_increasing_id()
    placed = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_spot", spot)
    ).withColumn("_part", F.shiftright("_spot", _BITS))
    counts = placed.groupBy("_part").count()  # a row per range from here on
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_spot").bitwiseAND(F.lit((1 << _BITS) - 1))
    return (
        placed.join(F.broadcast(starts), "_part")  # bound: one row per shuffle partition
        .withColumn(name, F.col("_start") + inside)
        .drop("_part", "_spot", "_start")
    )


def with_group_rank(df: DataFrame, group, order, name: str = "rank") -> DataFrame:
    """Zero-based position within each group: the global position minus that of the group's first row.

    A group that holds a third of all rows is spread over many tasks, unlike with a window.
    """
    group = list(group)
    ranked = with_rank(df, [*group, *order], "_at")
    first = ranked.groupBy(*group).agg(F.min("_at").alias("_first"))
    same = ranked.join(first, group) if group else ranked.withColumn("_first", F.lit(0))
    return same.withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first")


def key_positions(df: DataFrame, order, by=()) -> DataFrame:
    """The columns ``by`` and ``order`` of every row with its position ``_r`` in its group, from 0, and the group's size ``_n``.

    Only these columns are range-partitioned, sorted and kept, so that both passes see the same partitions.  A group may
    spread over many ranges: its position there is the number of its rows in earlier ranges plus the place inside.
    """
    by, spot = list(by), F.monotonically_increasing_id()
    columns = [*by, *order]
    placed = durable(df.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_spot", spot)).withColumn(
        "_part", F.shiftright("_spot", _BITS))
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_c"), F.min("_spot").alias("_first"))  # a row per range and group in it
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_range"), "_first",
                           F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_start"), F.sum("_c").over(whole).alias("_n"))
    same = [placed["_part"] == starts["_range"], *(placed[c].eqNullSafe(starts[f"_by{i}"]) for i, c in enumerate(by))]
    return placed.join(starts, same).select(*columns, (F.col("_start") + F.col("_spot") - F.col("_first")).alias("_r"), "_n")


def rows_of_keys(df: DataFrame, keys: DataFrame, columns) -> DataFrame:
    """The rows of ``df`` whose ``columns`` are among ``keys``, as often as there; of equal keys any."""
    wanted = keys.groupBy(*columns).agg(F.count("*").alias("_times")).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)], "_times")
    found = df.join(wanted, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)])
    spot = F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(0)))
    return found.withColumn("_spot", spot).filter(F.col("_spot") <= F.col("_times")).select(*df.columns)


def head_rows(df: DataFrame, order, n: int) -> DataFrame:
    """The first n rows: every task keeps n of them."""
    return df.orderBy(*order).limit(n)


def page_of_rows(df: DataFrame, order, page: int, size: int, total: int | None = None) -> DataFrame:
    """Page ``page`` (from 0) with a ``has_more`` column.

    ``has_more`` follows the total when it is known, otherwise whether the page is full.
    """
    offset = page * size
    rows = df.orderBy(*order).offset(offset).limit(size)
    filled = F.count("*").over(Window.partitionBy(F.lit(0)))  # of a page, not of the table
    more = (F.lit(offset) + filled < total) if total is not None else (filled == size)
    return rows.withColumn("has_more", more)


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """Keyset paging: the next ``size`` rows after ``last``; the filter reaches the scan, no offset is counted."""
    rows = df if last is None else df.filter(F.col(key) > last)
    return rows.orderBy(key).limit(size)


def decimate_even(df: DataFrame, order, k: int) -> DataFrame:
    """k rows at evenly spaced positions, the first and the last included; all rows when there are no more than k.

    Position i is floor(i * (n-1)/(k-1)) in double arithmetic, the last forced to n-1.  Keys alone are ordered; the
    rows of the chosen keys come from a second scan.
    """
    n = df.count()
    if n <= k:
        return df
    step = (n - 1) / (k - 1) if k > 1 else 0.0
    at = F.when((F.col("id") == k - 1) & F.lit(k > 1), F.lit(n - 1)).otherwise(
        F.floor(F.col("id").cast("double") * F.lit(step))
    )
    wanted = df.sparkSession.range(k).select(at.cast("bigint").alias("_r"))
    return rows_of_keys(df, key_positions(df, order).join(wanted, "_r", "left_semi").select(*order), order)


def every_nth(df: DataFrame, order, target: int, by=()) -> DataFrame:
    """Rows at positions 0, step, 2 step … with step = n // target, at most ``target`` of them, per group.

    Groups no larger than the target are kept whole.  Keys alone are ordered, as in ``decimate_even``.
    """
    columns = [*by, *order]
    step = F.greatest(F.floor(F.col("_n") / F.lit(target)), F.lit(1))
    keep = (F.col("_n") <= target) | ((F.col("_r") % step == 0) & (F.col("_r") < step * target))
    return rows_of_keys(df, key_positions(df, order, by).filter(keep).select(*columns), columns)


def last_per_key(df: DataFrame, key: str, newest_first, n: int = 10) -> DataFrame:
    """The newest n rows of every key with their position 1..n.

    The row-number limit is applied before the shuffle as well, so a hot key sends n rows per task, not all.
    """
    spot = F.row_number().over(Window.partitionBy(key).orderBy(*newest_first))
    return df.withColumn("position", spot).filter(F.col("position") <= n)


def first_distinct(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n distinct keys by their earliest ``order`` value."""
    return df.groupBy(key).agg(F.min(order).alias("first_seen")).orderBy("first_seen", key).limit(n)


def extreme_rows(df: DataFrame, by, value: str, tie: Column) -> DataFrame:
    """The row of each group with the greatest ``value``, a column of fixed width; among equals the first by ``tie``.

    The greatest values, one number a group, are hashed together and meet the rows again; few rows are left to be ordered.  A
    group without values keeps the first row by ``tie``.
    """
    ends = df.groupBy(*by).agg(F.max(value).alias("_end")).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_end")
    near = df.join(ends, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)] + [F.col(value).eqNullSafe(F.col("_end"))])
    place = F.row_number().over(Window.partitionBy(*by).orderBy(tie))
    return near.withColumn("_n", place).filter("_n = 1").select(*df.columns)


def latest_positions(df: DataFrame, tie_key: str) -> DataFrame:
    """Newest row of every float that has coordinates; a missing descriptive column becomes null.

    Null times never win unless a float has nothing else.  The newest time of each float comes from a hash aggregate; only
    rows that share it are ordered by ``tie_key``.
    """
    for name, kind in (("wmo_id", "bigint"), ("cycle_number", "int"), ("profile_date", "timestamp_ntz")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    found = extreme_rows(df, ["float_id"], "time", F.col(tie_key).desc())
    return found.select("float_id", *(c for c in df.columns if c != "float_id")).filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def float_trajectory(df: DataFrame, order, columns=("time", "lat", "lon")) -> DataFrame:
    """One point per float and profile: the first non-null value of each column; points without a place go."""
    key = F.struct(*order)
    if "profile_id" not in df.columns:
        points = df.select("float_id", "lat", "lon", "time").distinct()
    else:
        points = df.groupBy("float_id", "profile_id").agg(
            *(F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in columns)
        )
    return points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def trajectories(points: DataFrame, float_ids=None, first_floats: int | None = None, seen: str = "time") -> DataFrame:
    """Points of the floats that have at least two, before and after the coordinate check.

    ``first_floats`` keeps the first so many distinct floats.
    """
    if float_ids is not None:
        points = points.filter(F.col("float_id").isin(list(float_ids)))
    if first_floats is not None:
        points = points.join(first_distinct(points, "float_id", seen, first_floats), "float_id", "left_semi")
    valid = points.filter(valid_place(F.col("lat"), F.col("lon")))
    lengths = valid.groupBy("float_id").agg(F.count(F.lit(1)).alias("n_points")).filter(F.col("n_points") >= 2)
    return valid.join(lengths, "float_id")


def trajectory_endpoints(paths: DataFrame, order) -> DataFrame:
    """Start and end point of every trajectory, one hash aggregate over ``order``, a time and perhaps a whole number."""
    time, *number = order
    key = packed_order(micros(F.col(time)), F.col(number[0]).cast("bigint") if number else F.lit(0))
    return paths.groupBy("float_id").agg(*(
        f(c, key).alias(f"{end}_{c}") for end, f in (("start", F.min_by), ("end", F.max_by)) for c in ("lat", "lon", "time")))


def depth_ordered(df: DataFrame, tie_key: str) -> DataFrame:
    """Rows in float and depth order; the tie key lets a hot float spread over several sort ranges."""
    return df.orderBy("float_id", "depth", tie_key)


def union_distinct(left: DataFrame, right: DataFrame, key=None) -> DataFrame:
    """Both frames together without duplicates (by key, or by whole row)."""
    both = left.unionByName(right)
    return both.dropDuplicates([key] if key else both.columns)


def distinct_locations(df: DataFrame) -> DataFrame:
    return df.select("lat", "lon").distinct()


def desc(*names: str) -> list[Column]:
    return [F.col(n).desc() for n in names]
