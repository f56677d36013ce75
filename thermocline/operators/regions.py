"""Points in boxes: a range join for any number of boxes of any sizes.

A box lies on the level of a grid hierarchy whose cells are as wide as its longer side, where it touches at most nine cells.
A point has one cell on each level that is in use.  Level and cell are an ordinary join key; the exact test comes after.

Counts in boxes need no pairs: what lies in a cell is summed first, a box takes whole cells as sums and looks into its border
cells only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

LEAST, MOST = -20, 12  # levels: cells of 2**level degrees
FINE = 4  # counting: a side of a box spans at most 2**FINE cells and one more
MANY_PLACES = 64  # places of a label up to which its signed boxes are formed
PART_ROWS = 500_000  # items and cells of boxes that one task joins
BATCH = 100_000  # signed boxes handed on at once
BOUNDS = ("south", "north", "west", "east")
ITEM = ("s", "n", "w", "e")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def _boxed(regions: DataFrame) -> DataFrame:
    """Regions with their level and each cell they touch.  A box without area or with missing bounds keeps its place or none."""
    side = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    level = F.when(side > 0, F.ceil(F.log2(side))).otherwise(LEAST).cast("int")
    level = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), level))
    known = regions.filter((F.col("south") <= F.col("north")) & (F.col("west") <= F.col("east"))).withColumn("_level", level)
    span = lambda low, high: F.sequence(_cell(F.col(low), F.col("_level")), _cell(F.col(high), F.col("_level")))
    return known.withColumn("_y", F.explode(span("south", "north"))).withColumn("_x", F.explode(span("west", "east")))


def in_regions(points: DataFrame, regions: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Every point once for each region it lies in, bounds included, with the column ``region``.

    ``regions`` has region, north, south, east and west.  Points without a place, and boxes whose bounds are missing or the
    wrong way round, meet nothing.  The levels in use, at most a few tens, are read first.
    """
    boxes = _boxed(regions.select("region", "north", "south", "east", "west"))
    levels = [r["_level"] for r in boxes.select("_level").distinct().collect()]
    if not levels:
        return points.withColumn("region", F.lit(None).cast(regions.schema["region"].dataType)).limit(0)
    placed = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn(
        "_at", F.explode(F.array(*(F.lit(level) for level in sorted(levels)))))
    placed = placed.withColumns({"_cy": _cell(F.col(lat), F.col("_at")), "_cx": _cell(F.col(lon), F.col("_at"))})
    same = (F.col("_at") == F.col("_level")) & (F.col("_cy") == F.col("_y")) & (F.col("_cx") == F.col("_x"))
    inside = F.col(lat).between(F.col("south"), F.col("north")) & F.col(lon).between(F.col("west"), F.col("east"))
    return placed.join(boxes, same & inside).select(*points.columns, "region")


def measurements_in_regions(readings: DataFrame, casts: DataFrame, regions: DataFrame) -> DataFrame:
    """Measurements tagged with their regions: profiles are placed first, so a reading meets only profiles inside some."""
    places = casts.select("profile_id", "float_id", F.col("profile_date").alias("time"), F.col("profile_lat").alias("lat"),
                          F.col("profile_lon").alias("lon"))
    return readings.join(in_regions(places, regions), "profile_id")


def signed_boxes(places: Iterable[tuple[float, float]]) -> Counter:
    """Boxes (south, north, west, east) with signs: those inside any box add up to 1 if it holds a place, else to 0.

    Among the places in a box one comes first by latitude, then longitude.  It does so for every box that reaches no earlier
    place; going south, the earlier places narrow how far such a box may reach west and east.  Each stretch between two of
    them is a difference of boxes.
    """
    ordered, signs = sorted(places), Counter()
    for i, (lat, lon) in enumerate(ordered):
        top, west, east = lat, None, None

        def add(bottom, top=top, lat=lat, lon=lon):
            for south, a in ((top, 1), (bottom, -1)):
                for left, b in ((lon, 1), (west, -1)):  # noqa: B023
                    for right, c in ((lon, 1), (east, -1)):  # noqa: B023
                        if None not in (south, left, right):
                            signs[south, lat, left, right] += a * b * c

        for y, x in reversed(ordered[:i]):
            if (west is not None and x <= west) or (east is not None and x >= east):
                continue
            if y < top:
                add(y, top)
                top = y
            if x == lon:
                break
            west, east = (x, east) if x < lon else (west, x)
        else:
            add(None, top)
    return Counter({box: sign for box, sign in signs.items() if sign})


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a label's places to signed boxes, equal ones of a batch added up."""
    def rows(signs: Counter) -> pa.RecordBatch:
        columns = zip(*signs) if signs else [[]] * 4
        return pa.record_batch([*(pa.array(c, pa.float64()) for c in columns), pa.array(signs.values(), pa.int64())], [*ITEM, "labels"])

    for batch in batches:
        signs = Counter()
        for lats, lons in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for box, sign in signed_boxes(zip(lats, lons)).items():
                signs[box] += sign
            if len(signs) >= BATCH:
                yield rows(signs)
                signs = Counter()
        yield rows(signs)


def _fine(low: str, high: str, least: int) -> Column:
    """Level of the cells that an axis of a box is cut into: even levels, so that few are in use."""
    side = F.col(high) - F.col(low)
    level = F.when(side > 0, F.ceil(F.log2(side) / 2) * 2).otherwise(least)
    return (F.greatest(F.lit(least), level) - FINE).cast("int")


def counts_in_regions(points: DataFrame, regions: DataFrame, key: str, label: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Regions that hold points, with ``points``, different ``labels`` and the least ``key`` of theirs.

    ``regions`` is as for ``in_regions``, with one box per region; equal rows count as often as they occur.  Points at one place
    are one counted item, and the places of a label are signed boxes, equal ones of all labels added up.  Items are summed
    per cell; a box takes the sums of cells whose items all lie inside it and tests the items of the others.  Labels of more than
    ``MANY_PLACES`` places meet the boxes place by place.
    """
    spark = points.sparkSession
    placed = points.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    placed = placed.filter((F.abs("lat") < math.inf) & (F.abs("lon") < math.inf))
    ends = placed.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    kinds = {"region": regions.schema["region"].dataType, "first": points.schema[key].dataType}
    if ends[0] is None:
        return spark.createDataFrame([], "points bigint, labels bigint").select(
            F.lit(None).cast(kinds["region"]).alias("region"), "points", "labels", F.lit(None).cast(kinds["first"]).alias("first"))
    clipped = {c: (F.greatest if i % 2 == 0 else F.least)(F.col(c).cast("double"), F.lit(float(ends[i]))) for i, c in enumerate(BOUNDS)}
    known = regions.filter(F.greatest(*(F.col(c).isNull() for c in BOUNDS)) == F.lit(False)).select("region", *(c.alias(n) for n, c in clipped.items()))
    known = known.filter((F.col("south") <= F.col("north")) & (F.col("west") <= F.col("east"))).groupBy("region", *BOUNDS).agg(F.count("*").alias("copies"))
    least = max(LEAST, 2 * math.ceil(math.log2(max(1.0, *map(abs, ends))) / 2) - 40)  # cell numbers stay whole
    boxes = known.select(*BOUNDS).distinct().withColumns({"ly": _fine("south", "north", least), "lx": _fine("west", "east", least)})
    used = boxes.groupBy("ly", "lx").count().collect()  # few
    levels = [F.struct(F.lit(r["ly"]).alias("ly"), F.lit(r["lx"]).alias("lx")) for r in used]

    seen = placed.filter(F.col("label").isNotNull()).select("label", "lat", "lon").distinct()
    number = seen.groupBy("label").agg(F.count("*").alias("places"))
    lists = seen.join(number.filter(F.col("places") <= MANY_PLACES), "label").groupBy("label").agg(
        F.collect_list(F.struct("lat", "lon")).alias("at")).select("at.lat", "at.lon")
    at = [F.col(c).alias(i) for c, i in zip(("lat", "lat", "lon", "lon"), ITEM)]
    counted = placed.groupBy("lat", "lon").agg(F.count("*").alias("points"), F.min("key").alias("first")).select(
        *at, "points", "first", F.lit(0).cast("bigint").alias("labels"))
    signed = lists.mapInArrow(_signed, "s double, n double, w double, e double, labels bigint")
    items = staged(counted.unionByName(signed, allowMissingColumns=True).groupBy(*ITEM).agg(
        F.sum("points").alias("points"), F.min("first").alias("first"), F.sum("labels").alias("labels")).filter("points > 0 OR labels <> 0"))

    cell = ["ly", "lx", "cy", "cx"]
    levelled = items.select("*", F.inline(F.array(*levels))) if levels else items.withColumns({c: F.lit(0) for c in cell[:2]}).limit(0)
    levelled = levelled.withColumns({"cy": _cell(F.col("s"), F.col("ly")), "cx": _cell(F.col("w"), F.col("lx"))})
    # the parts are numbered here: rows grow after they are read, which the engine's own number does not foresee
    parts = 8 + (items.count() * len(levels) + sum(r["count"] for r in used) * 4 ** FINE // 2) // PART_ROWS
    levelled = levelled.repartition(parts, *cell)
    sums = [F.sum("points").alias("points"), F.min("first").alias("first"), F.sum("labels").alias("labels")]
    nodes = levelled.groupBy(*cell).agg(F.min("s").alias("s"), F.max("n").alias("n"), F.min("w").alias("w"), F.max("e").alias("e"), *sums)
    span = lambda low, high, level: F.explode(F.sequence(_cell(F.col(low), F.col(level)), _cell(F.col(high), F.col(level))))
    near = boxes.withColumn("cy", span("south", "north", "ly")).withColumn("cx", span("west", "east", "lx")).repartition(parts, *cell)
    inside = (F.col("south") <= F.col("s")) & (F.col("n") <= F.col("north")) & (F.col("west") <= F.col("w")) & (F.col("e") <= F.col("east"))
    met = near.join(nodes, cell).filter((F.col("s") <= F.col("north")) & (F.col("w") <= F.col("east")))
    found = ["points", "first", "labels"]
    whole = met.filter(inside).select(*BOUNDS, *found)
    tested = met.filter(~inside).select(*cell, *BOUNDS).join(levelled, cell).filter(inside).select(*BOUNDS, *found)
    rest = seen.join(number.filter(F.col("places") > MANY_PLACES).select("label"), "label", "left_semi")
    one_by_one = in_regions(rest, boxes.select(F.struct(*BOUNDS).alias("region"), *BOUNDS)).groupBy("region").agg(
        F.count_distinct("label").alias("labels")).select("region.*", "labels")
    total = whole.unionAll(tested).unionByName(one_by_one, allowMissingColumns=True).groupBy(*BOUNDS).agg(*sums)
    return known.join(total, list(BOUNDS)).select("region", (F.col("points") * F.col("copies")).alias("points"), "labels", "first")
