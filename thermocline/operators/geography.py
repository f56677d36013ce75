"""Positions, clusters, densities and depth profiles."""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.columns import n_rows
from ..functions.predicates import valid_place
from ..session import staged
from .order import with_rank

# --- fixed values: marker sizes of the map, reference lines of the chemistry plots ------------------------
SINGLE_MARKER, MARKER_STEP, MARKER_BASE, MARKER_LIMIT = 12, 3, 8, 25
REFERENCE_LINES = (
    ("oxygen", 2.0, "Hypoxic threshold"),
    ("oxygen", 6.0, "Well-oxygenated"),
    ("ph", 8.1, "Surface ocean pH"),
)
SERIES = ("temperature", "salinity", "oxygen", "ph", "chlorophyll")
# ----------------------------------------------------------------------------------------------------------

UNDECIDED, CENTRE, COVERED = 0, 1, 2
CELL_POINTS = 64  # points of a cell that a round looks at
BLOCK_POINTS = 50_000  # points that a task holds
LEAST_BITS, MOST_BITS = 4, 30


def region_outlines(m: DataFrame, names=labels.OUTLINED) -> DataFrame:
    """Closed five-point ring of every region that has measurements, with their number."""
    from .filters import in_named_regions

    counts = in_named_regions(m.select("lat", "lon"), names).groupBy("region").agg(
        n_rows().alias("measurement_count")
    )
    boxes = labels.region_table(m.sparkSession)
    ring = F.array(
        *(F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
          for lat, lon in (("south", "west"), ("south", "east"), ("north", "east"), ("north", "west"),
                           ("south", "west")))
    )
    return counts.join(F.broadcast(boxes), "region").select(
        "region", "measurement_count", F.posexplode(ring).alias("point", "_p")
    ).select("region", "measurement_count", "point", "_p.lat", "_p.lon")


def density_grid(df: DataFrame, cell: float = 1.0) -> DataFrame:
    """Valid points per grid cell, each point weighing one."""
    lat, lon = ((F.floor(F.col(c) / cell) * cell).cast("double").alias(f"{c}_cell") for c in ("lat", "lon"))
    return df.filter(valid_place(F.col("lat"), F.col("lon"))).groupBy(lat, lon).agg(n_rows().alias("density"))


def _around() -> Column:
    """The 5 x 5 cells around the cell (cx, cy)."""
    return F.expr(
        "inline(flatten(transform(sequence(cx - 2, cx + 2), x -> "
        "transform(sequence(cy - 2, cy + 2), y -> struct(x AS cx, y AS cy)))))"
    )


def _apart(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> Column:
    lat, lon = F.col(a_lat) - F.col(b_lat), F.col(a_lon) - F.col(b_lon)
    return F.sqrt(lat * lat + lon * lon)


def _written(df: DataFrame, **numbers: Column) -> tuple[DataFrame, dict]:
    """``df`` written to the shared folder, and sums over its rows that are taken as they pass."""
    seen = Observation()
    kept = staged(df.observe(seen, *(number.alias(name) for name, number in numbers.items())))
    return kept, seen.get


def _block_bits(spots: DataFrame, points: int) -> int:
    """Blocks are squares of 2^bits cells a side: the largest that hold at most about ``BLOCK_POINTS`` points each."""
    if points <= BLOCK_POINTS:
        return MOST_BITS
    cells = spots.groupBy("cx", "cy").agg(F.least(F.count("*"), F.lit(CELL_POINTS + 1)).alias("n"))
    levels = cells.select("n", "cx", "cy", F.explode(F.sequence(F.lit(LEAST_BITS), F.lit(MOST_BITS))).alias("bits"))
    blocks = levels.groupBy("bits", F.expr("shiftright(cx, bits)"), F.expr("shiftright(cy, bits)")).agg(F.sum("n").alias("n"))
    fitting = blocks.groupBy("bits").agg(F.max("n").alias("n")).filter(F.col("n") <= BLOCK_POINTS)
    return fitting.agg(F.max("bits")).first()[0] or LEAST_BITS


def _decide(threshold: float):
    """The greedy loop inside one block, as far as it can be known there.

    Points come in key order.  A point near a centre is covered.  A point with an earlier undecided point nearby, one of
    another block or one beyond the part of a cell that was sent, stays undecided; any other becomes a centre.
    """
    def solve(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("ord", kind="stable")
        centres, undecided = defaultdict(list), defaultdict(list)
        beyond = {(x, y): o for x, y, o, over in zip(points["cx"], points["cy"], points["ord"], points["over"]) if over}
        states = []
        for o, lat, lon, cx, cy, own in zip(*(points[c].tolist() for c in ("ord", "lat", "lon", "cx", "cy", "own"))):
            around = [(x, y) for x in range(cx - 2, cx + 3) for y in range(cy - 2, cy + 3)]

            def near(found) -> bool:
                return any(math.sqrt((lat - a) * (lat - a) + (lon - b) * (lon - b)) <= threshold for c in around if c in found for a, b in found[c])  # noqa: B023

            state = COVERED if near(centres) else UNDECIDED
            if state != COVERED:
                if not own or near(undecided) or any(c in beyond and beyond[c] < o for c in around):
                    undecided[cx, cy].append((lat, lon))
                else:
                    state = CENTRE
                    centres[cx, cy].append((lat, lon))
            states.append(state)
        return points.assign(state=states)[points["own"]][["ord", "lat", "lon", "cx", "cy", "state"]]

    return solve


def _round(undecided: DataFrame, threshold: float, bits: int) -> tuple[DataFrame, dict]:
    """Points sent to the task of their block, with what was decided there, and how many were sent and left open.

    A cell sends its first ``CELL_POINTS`` points and the next one, which tells where its knowledge ends: two points of one cell
    are always within the threshold, so a cell has one centre at most.  Points near a border go to the blocks behind it too.
    """
    place = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("ord"))
    first = undecided.withColumn("_n", place).filter(F.col("_n") <= CELL_POINTS + 1).withColumn("over", F.col("_n") > CELL_POINTS)
    block = lambda x, y: F.struct(F.shiftright(F.col("cx") + x, bits).alias("bx"), F.shiftright(F.col("cy") + y, bits).alias("by"))
    reach = F.array_distinct(F.array(block(0, 0), *(block(x, y) for x in (-2, 2) for y in (-2, 2))))
    sent = first.select("ord", "lat", "lon", "cx", "cy", "over", block(0, 0).alias("home"), F.explode(reach).alias("block"))
    sent = sent.select("ord", "lat", "lon", "cx", "cy", "over", "block", (F.col("home") == F.col("block")).alias("own"))
    kind = undecided.schema["ord"].dataType.simpleString()
    decided = sent.groupBy("block").applyInPandas(_decide(threshold), f"ord {kind}, lat double, lon double, cx long, cy long, state int")
    return _written(decided, sent=n_rows(), open=F.count_if(F.col("state") == UNDECIDED))


def _leaders(spots: DataFrame, threshold: float, points: int) -> DataFrame:
    """Points the greedy loop would make cluster centres.

    Every round solves blocks of cells inside tasks and exchanges only what happens at their borders, so rounds follow how often
    a chain of dependent points crosses a border, not its length.  Pairs of points are never formed: a point meets at most
    the centres of the 25 cells around it.
    """
    undecided, chosen, bits = spots.select("ord", "lat", "lon", "cx", "cy"), None, _block_bits(spots, points)
    while True:
        decided, counts = _round(undecided, threshold, bits)
        found = decided.filter(F.col("state") == CENTRE).drop("state")
        chosen = found if chosen is None else chosen.unionByName(found)
        if not counts["open"] and counts["sent"] == points:
            return chosen
        cover = found.select(F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"), _around())
        a, b = undecided.alias("a"), cover.alias("b")
        same = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
        left = a.join(b, same & (_apart("a.lat", "a.lon", "b.l_lat", "b.l_lon") <= threshold), "left_anti")
        undecided, counts = _written(left, points=n_rows())
        points = counts["points"]


def cluster_floats(points: DataFrame, threshold: float = 2.0, key: str = "float_id") -> DataFrame:
    """Greedy clusters of nearby floats, in key order.

    The first free float takes every float within ``threshold`` degrees (planar) as a member, members of earlier
    clusters included; the output row is the members' mean place and number.  A float with no neighbour keeps its
    id.  Floats at the very same place are one point with a weight.  One row at most comes back unchanged, and
    points without a place take no part.
    """
    side = threshold / 1.4143 if threshold > 0 else 1.0
    spots, counts = _written(
        points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy("lat", "lon")
        .agg(F.min(key).alias("ord"), n_rows().alias("weight"))
        .withColumn("cx", F.floor(F.col("lon") / side))
        .withColumn("cy", F.floor(F.col("lat") / side)), points=n_rows())
    centres = _leaders(spots, threshold, counts["points"]) if threshold > 0 else spots.select("cx", "cy", "ord", "lat", "lon")
    cover = centres.select("ord", F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"),
                           _around())
    near = _apart("lat", "lon", "l_lat", "l_lon") <= threshold
    members = (
        spots.select("lat", "lon", "weight", "cx", "cy").join(cover, ["cx", "cy"]).filter(near)
        .groupBy("ord")
        .agg(
            F.sum("weight").alias("cluster_size"),
            (F.sum(F.col("lat") * F.col("weight")) / F.sum("weight")).alias("lat"),
            (F.sum(F.col("lon") * F.col("weight")) / F.sum("weight")).alias("lon"),
        )
    )
    placed = with_rank(members, ["ord"], "position")
    grouped = F.col("cluster_size") > 1
    name = F.when(grouped, F.concat(F.lit("Cluster_"), F.col("position"))).otherwise(F.col("ord").cast("string"))
    size = F.when(grouped, F.least(F.col("cluster_size") * MARKER_STEP + MARKER_BASE, F.lit(MARKER_LIMIT)))
    return placed.select(
        name.alias("float_id"), F.col("ord").alias("leader"), "lat", "lon", "cluster_size",
        F.coalesce(size, F.lit(SINGLE_MARKER)).cast("int").alias("marker_size"),
    )


def profile_series(df: DataFrame, float_id=None, series=SERIES) -> DataFrame:
    """(float, series, depth, value) without nulls: the lines of all depth profiles in one long table."""
    rows = df if float_id is None else df.filter(F.col("float_id") == float_id)
    cells = F.array(*(F.struct(F.lit(c).alias("series"), F.col(c).alias("value")) for c in series if c in df.columns))
    return rows.filter(F.col("depth").isNotNull()).select("float_id", "depth", F.inline(cells)).filter(
        F.col("value").isNotNull()
    )


def ts_profile(df: DataFrame) -> DataFrame:
    """Temperature, salinity, depth triples with depth pointing down."""
    whole = F.col("temperature").isNotNull() & F.col("salinity").isNotNull() & F.col("depth").isNotNull()
    return df.filter(whole).select("id", "temperature", "salinity", "depth", (-F.col("depth")).alias("display_depth"))


def profile_comparison(m: DataFrame, chosen: DataFrame, parameters=("temperature", "salinity")) -> DataFrame:
    """Depth curves of the chosen profiles, labelled ``Profile i`` in the order given, or by their own label.

    ``chosen`` has profile_id and either ``position`` (from 1) or ``label``.
    """
    label = F.col("label") if "label" in chosen.columns else F.concat(F.lit("Profile "), F.col("position"))
    cells = F.array(*(F.struct(F.lit(c).alias("parameter"), F.col(c).alias("value")) for c in parameters))
    rows = m.filter(F.col("depth").isNotNull()).join(chosen.select("profile_id", label.alias("label")), "profile_id")
    return rows.select(
        "label", "profile_id", "depth", (-F.col("depth")).alias("display_depth"), F.inline(cells)
    ).filter(F.col("value").isNotNull())


def density_contours(df: DataFrame, steps: int = 50, least_rows: int = 10) -> DataFrame:
    """Linear sea-water density on a grid over the salinity and temperature span; nothing for too few rows."""
    whole = F.col("temperature").isNotNull() & F.col("salinity").isNotNull()
    span = df.filter(whole).agg(
        n_rows().alias("n"), F.min("salinity").alias("s0"), F.max("salinity").alias("s1"),
        F.min("temperature").alias("t0"), F.max("temperature").alias("t1"),
    ).filter(F.col("n") > least_rows)
    ticks = F.sequence(F.lit(0), F.lit(steps - 1))
    grid = span.withColumn("i", F.explode(ticks)).withColumn("j", F.explode(ticks))
    salinity = F.col("s0") + (F.col("s1") - F.col("s0")) * F.col("i") / (steps - 1)
    temperature = F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("j") / (steps - 1)
    return grid.select("i", "j", salinity.alias("salinity"), temperature.alias("temperature")).withColumn(
        "density", 1000 + 0.8 * (F.col("salinity") - 35) - 0.2 * (F.col("temperature") - 15)
    )


def bgc_thresholds(df: DataFrame, lines=REFERENCE_LINES) -> DataFrame:
    """Rows below each reference line, and their share, in one pass."""
    found = [(i, line) for i, line in enumerate(lines) if line[0] in df.columns]
    wide = df.agg(*(
        F.struct(F.count(c).alias("n"), F.count_if(F.col(c) < F.lit(v)).alias("below")).alias(f"_{i}")
        for i, (c, v, _) in found
    ))
    cells = F.array(*(
        F.struct(F.lit(c).alias("parameter"), F.lit(v).alias("threshold"), F.lit(text).alias("label"),
                 F.col(f"_{i}")["n"].alias("measurement_count"), F.col(f"_{i}")["below"].alias("below_count"))
        for i, (c, v, text) in found
    ))
    return wide.select(F.inline(cells)).withColumn(
        "below_share", F.try_divide(F.col("below_count").cast("double"), F.col("measurement_count"))
    )
