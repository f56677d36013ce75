"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at many places of a ring; a document belongs to the next one clockwise from the hash of its id.  A shard
takes bytes up to its bound, large documents first and then by hash; what finds it full goes on clockwise to the next
shard that is not.  So no shard is above the bound by more than the last unit it took, and all others move little.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import BROADCAST_ROWS, CRC_TABLE_SQL, counted, crc_sql, free_name, table

SHARDS = 16
NODES = 64  # places of a shard on the ring
EXCESS = 0.0  # a shard is full at this much over the mean; more of it moves fewer documents when shards are added
SLICES = 64  # units of one size class on one arc of the ring
SALTS = 1024  # parts of the rows that repeat id and text, numbered side by side
DIGITS = 13  # hexadecimal digits of a place: 52 bits
LAW = "bytes"


def _place(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """Places and shards of all virtual nodes, clockwise.  The nodes of a shard don't depend on the number of shards."""
    return sorted((_place(f"node:{s}:{v}"), s) for s in range(shards) for v in range(nodes))


def _clockwise(around: Sequence[tuple[int, int]]) -> list[tuple[int, list[int]]]:
    """For each arc, the one that ends at a node, the distinct shards from that node on."""
    found, following = [], []
    for arc in range(2 * len(around) - 1, -1, -1):
        shard = around[arc % len(around)][1]
        following = [shard] + [s for s in following if s != shard]
        if arc < len(around):
            found.append((arc, following))
    return found


def _numbers(values: Sequence[int]) -> Column:
    """A constant array, folded by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _hashed(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _arc(place: Column, around: Sequence[tuple[int, int]]) -> Column:
    """Number of the first node at or after a place: nodes before the place's cell of the ring, and those before it inside."""
    bits = max(len(around) - 1, 1).bit_length()
    cell = F.shiftright(place, 4 * DIGITS - bits)
    places = [p for p, _ in around]
    cells = [0] * ((1 << bits) + 1)
    for p in places:
        cells[(p >> (4 * DIGITS - bits)) + 1] += 1
    for i in range(1, len(cells)):
        cells[i] += cells[i - 1]
    before = _numbers(cells)
    first, last = F.element_at(before, (cell + 1).cast("int")), F.element_at(before, (cell + 2).cast("int"))
    inside = F.slice(_numbers(places), (first + 1).cast("int"), (last - first).cast("int"))
    return ((first + F.size(F.filter(inside, lambda p: p < place))) % len(around)).cast("int")


def _copies(rows: DataFrame, ident: str, number: str, copy: str) -> DataFrame:
    """Numbers rows of equal ``ident`` from 0.  Few have company; those are numbered in salted parts, side by side."""
    same = durable(rows.groupBy(ident).agg(F.count("*").alias(copy)).filter(F.col(copy) > 1).select(ident))
    repeated = same.count()
    if not repeated:
        return rows.withColumn(copy, F.lit(0).cast("long"))
    same = F.broadcast(same) if repeated <= BROADCAST_ROWS else same
    salt, before = free_name(rows.columns, "salt"), free_name(rows.columns, "before")
    many = rows.join(same, ident, "left_semi").withColumn(salt, F.pmod(F.xxhash64(number), F.lit(SALTS)))
    counts = many.groupBy(ident, salt).agg(F.count("*").alias(before))
    earlier = Window.partitionBy(ident).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(ident, salt).orderBy(number)) - 1
    numbered = many.withColumn(copy, inside.cast("long")).join(counted(counts), [ident, salt]).withColumn(
        copy, F.col(copy) + F.col(before)).drop(salt, before)
    return rows.join(same, ident, "left_anti").withColumn(copy, F.lit(0).cast("long")).unionByName(numbered)


def _fill(units: DataFrame, shards: int, excess: float) -> DataFrame:
    """The shard of every unit: adds ``shard`` to (arc, bits, slice, bytes, rows, following).

    In each round a unit goes to the first shard clockwise that is not full, and a shard takes units in order, large
    documents first, while what it holds is below its bound.  A shard that turns one away is full then, so there are no more
    rounds than shards.  Units are bounded in number by the ring, not by the documents; the driver holds a load per shard.
    """
    total = units.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    bound = total * (1 + excess) / shards
    loads = [0] * shards
    placed, order = [], [F.col("bits").desc(), "slice", "arc"]
    rest = units
    while True:
        full = [s for s in range(shards) if loads[s] >= bound]
        to = F.element_at(F.filter("following", lambda s: ~s.isin(full)) if full else F.col("following"), 1)
        earlier = Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        held = F.coalesce(F.sum("bytes").over(earlier), F.lit(0)) + F.element_at(_numbers(loads), F.col("shard") + 1)
        step = durable(rest.withColumn("shard", to).withColumn("taken", held < F.lit(bound)))
        placed.append(step.filter("taken").drop("taken"))
        left = 0
        for row in step.groupBy("shard", "taken").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect():  # two rows a shard at most
            if row["taken"]:
                loads[row["shard"]] += row["b"]
            else:
                left += row["n"]
        if not left:
            break
        rest = step.filter("not taken").drop("taken", "shard")
    found = placed[0]
    for part in placed[1:]:
        found = found.unionAll(part)
    return found


def place(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, excess: float = EXCESS, slices: int = SLICES,
          keep: Sequence[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``size`` (UTF-8 bytes of the text and one), ``text_crc32``, ``shard`` and ``slot``, its place in the shard from 0.

    ``keep`` names the columns of ``docs`` to return (all); an added column whose name they hold gets ``_`` in front.  A
    null text has size 1 and the CRC of nothing, a null doc_id counts as the empty text.  Rows that repeat an id and a text
    count one by one; which of them gets which slot is left open, all else depends on the rows alone, not on their order or
    partitions.  An empty table gives an empty result.

    A unit is what one arc of the ring, one power of two of sizes and one of ``slices`` hash slices have in common.  Sums per unit,
    at most arcs x 40 x slices rows at any size of the corpus, decide; documents then meet their unit's shard.  Rows that repeat one
    id share an arc but not a slice, so no unit, window or join key holds them all.
    """
    spark = docs.sparkSession
    kept = list(docs.columns if keep is None else keep)
    name = {n: free_name(kept, n) for n in (
        "size", "text_crc32", "shard", "slot", "ident", "number", "copy", "arc", "bits", "slice", "following", "bytes", "rows", "first", "inside")}
    size, crc, ident, copy, arc, bits, slice_ = (name[n] for n in ("size", "text_crc32", "ident", "copy", "arc", "bits", "slice"))
    text, key = F.coalesce(docs["text"], F.lit("")), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    around = ring(shards, nodes)
    read = docs.select(*[docs[c] for c in kept], (F.octet_length(text).cast("long") + 1).alias(size), F.crc32(text).alias(crc),
                       key.alias(ident), F.monotonically_increasing_id().alias(name["number"]))
    read = read.withColumn(arc, _arc(_hashed(F.concat(F.lit("key:"), ident)), around)).withColumn(
        ident, F.concat_ws(":", ident, F.col(crc).cast("string"), F.col(size).cast("string")))
    rows = _copies(durable(read), ident, name["number"], copy).withColumn(bits, F.length(F.bin(size))).withColumn(
        slice_, (_hashed(F.concat_ws(":", F.lit("slice"), ident, F.col(copy).cast("string"))) % slices).cast("int"))
    units = rows.groupBy(F.col(arc).alias("arc"), F.col(bits).alias("bits"), F.col(slice_).alias("slice")).agg(
        F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    ways = spark.createDataFrame(_clockwise(around), "arc int, following array<int>")  # a row per virtual node
    filled = _fill(durable(units.join(F.broadcast(ways), "arc")), shards, excess)
    earlier = Window.partitionBy("shard").orderBy(F.col("bits").desc(), "slice", "arc").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted(filled.select(*[F.col(n).alias(name[n]) for n in ("arc", "bits", "slice", "shard")],
                                   F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias(name["first"])))
    inside = F.row_number().over(Window.partitionBy(arc, bits, slice_).orderBy(ident, copy)) - 1
    found = rows.withColumn(name["inside"], inside).join(starts, [arc, bits, slice_])
    return found.select(*kept, size, crc, F.col(name["shard"]).cast("int").alias(name["shard"]),
                        (F.col(name["first"]) + F.col(name["inside"])).cast("long").alias(name["slot"]))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Parquet below ``path``, a folder per shard, rows of a file by slot.  ``docs`` has no columns of the added names."""
    placed = place(docs, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of 16 of nearly equal bytes."""
    placed = place(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql() -> str:
    """The rounds one after the other; a round without units leaves the loads as they are."""
    place_of = lambda text: f"('0x' || left(md5({text}), {DIGITS}))::BIGINT"
    rounds = []
    for r in range(SHARDS):
        rounds.append(f"""
step{r} AS MATERIALIZED (
  SELECT * EXCLUDE (held), held + load < bound AS taken FROM (
    SELECT u.*, coalesce(sum(bytes) OVER (PARTITION BY shard ORDER BY bits DESC, slice, arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held
    FROM (SELECT * EXCLUDE (shard, full_ones), list_filter(following, lambda s: NOT list_contains(full_ones, s))[1] AS shard
          FROM rest{r}, (SELECT coalesce(list(l.shard) FILTER (load >= bound), []) AS full_ones FROM loads{r} l, bounds)) u)
  JOIN loads{r} USING (shard), bounds),
loads{r + 1} AS MATERIALIZED (SELECT l.shard, l.load + coalesce((SELECT sum(bytes) FROM step{r} s WHERE s.shard = l.shard AND taken), 0) AS load FROM loads{r} l),
rest{r + 1} AS MATERIALIZED (SELECT * EXCLUDE (taken, load, bound) FROM step{r} WHERE NOT taken)""")
    took = " UNION ALL ".join(f"SELECT arc, bits, slice, rows, shard FROM step{r} WHERE taken" for r in range(SHARDS))
    return f"""
WITH {CRC_TABLE_SQL},
sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc_sql("coalesce(text, '')")} AS crc FROM documents, crc_table),
named AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS key, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || crc || ':' || size AS ident FROM sized),
copied AS (SELECT *, row_number() OVER (PARTITION BY ident) - 1 AS copy, {place_of("'key:' || key")} AS place FROM named),
nodes AS (SELECT s AS shard, {place_of("'node:' || s || ':' || v")} AS place FROM range({SHARDS}) a(s), range({NODES}) b(v)),
around AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY place, shard) - 1 AS arc FROM nodes),
ways AS (SELECT arc, list(shard ORDER BY distance) AS following
         FROM (SELECT a.arc, b.shard, min((b.arc - a.arc + {SHARDS * NODES}) % {SHARDS * NODES}) AS distance FROM around a, around b GROUP BY a.arc, b.shard)
         GROUP BY arc),
rows_ AS MATERIALIZED (
  SELECT doc_id, size, crc, ident, copy, length(bin(size)) AS bits, {place_of("'slice:' || ident || ':' || copy")} % {SLICES} AS slice,
         (SELECT count(*) FROM around a WHERE a.place < c.place) % {SHARDS * NODES} AS arc FROM copied c),
units AS (SELECT arc, bits, slice, sum(size) AS bytes, count(*) AS rows FROM rows_ GROUP BY ALL),
bounds AS MATERIALIZED (SELECT CAST(sum(bytes) AS DOUBLE) * (1 + {EXCESS}::DOUBLE) / {SHARDS} AS bound FROM units),
loads0 AS MATERIALIZED (SELECT s AS shard, 0::HUGEINT AS load FROM range({SHARDS}) a(s)),
rest0 AS MATERIALIZED (SELECT *, NULL::BIGINT AS shard FROM units JOIN ways USING (arc)),{','.join(rounds)},
starts AS (SELECT *, coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY bits DESC, slice, arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
           FROM ({took}))
SELECT doc_id, size, crc AS text_crc32, '{LAW}' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(first + row_number() OVER (PARTITION BY arc, bits, slice ORDER BY ident, copy) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM rows_ JOIN starts USING (arc, bits, slice)
"""


OP11_SQL = _sql()
