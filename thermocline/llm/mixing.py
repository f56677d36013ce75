"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .common import TOKEN, counted, free_name, table

MOST = 3  # no source is repeated more often
SEED = "mix"
HEX_DIGITS = 13  # 52 bits, exact as a double


def text_size(text: Column) -> Column:
    """Number of tokens between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key alone; a null key counts as the empty text."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / float(16 ** HEX_DIGITS)


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, ... by code point of ``source``, null last: adds ``weight``.

    A place in the order is the number of rows in earlier ranges plus the place inside a range, so no task holds more
    than one range of sources.
    """
    order = [F.col("source").asc_nulls_last()]
    ranged = durable(sources.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("part", F.spark_partition_id()).withColumn("inside", F.monotonically_increasing_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("rows"), F.min("inside").alias("first"))  # a row per range
    left, right = counts.alias("l"), counts.alias("r")
    before = left.join(F.broadcast(right), F.col("r.part") < F.col("l.part"), "left").groupBy("l.part", "l.first").agg(
        F.coalesce(F.sum("r.rows"), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("inside") - F.col("first")
    return ranged.join(F.broadcast(before), "part").withColumn("weight", (place % 3 + 1).cast("double")).drop(
        "part", "inside", "first", "before")


def fill(sources: DataFrame, most: float = MOST) -> DataFrame:
    """Shares of the total size by weight, none above ``most`` times the source's size: adds ``target``.

    What a stopped source leaves is shared again by weight until no source is above its limit.  Each round is one
    aggregate over the sources and stops at least one of them.
    """
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level = -1.0
    while True:
        stopped = F.lit(float(most)) * F.col("source_size") <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(stopped, F.col("source_size"))).alias("held"),
                          F.sum(F.when(~stopped, F.col("weight"))).alias("open")).first()
        rest = total - most * (row["held"] or 0)
        if not row["open"] or rest / row["open"] <= level:
            break
        level = rest / row["open"]
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.lit(max(level, 0.0)) * F.col("weight"))
    return sources.withColumn("target", target)


def rates(docs: DataFrame, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) of every source, null among them."""
    sizes = docs.select("source", text_size(F.col("text")).alias("size"))
    sources = durable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    return fill(durable(cyclic_weights(sources)), most)


def _added(docs: DataFrame) -> list[str]:
    """Names of the columns that ``copies`` adds: ``mix_...``, with ``_`` in front if ``docs`` has such a column."""
    return [free_name(docs.columns, n) for n in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]


def copies(docs: DataFrame, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` with mix_size, mix_source_size, mix_target and mix_copies.

    A document gets floor(rate) copies and one more with the probability of the remaining fraction, decided by a hash
    of its id: the same in every run and for every partitioning.  Rows repeating an id decide alike.  A source without
    tokens has rate 0.  The text is tokenised once for the sums and once here; nothing is shuffled but the sums.
    A null source is a source, a null text has size 0, an empty table stays empty.  An added column whose name ``docs`` holds gets
    ``_`` in front.
    """
    size, source_size, target, times = _added(docs)
    source = free_name([*docs.columns, source_size, target], "mix_source")
    found = counted(rates(docs, most).select(F.col("source").alias(source), F.col("source_size").alias(source_size),
                                             F.col("target").alias(target)))
    rate = F.when(found[source_size] > 0, found[target] / found[source_size]).otherwise(F.lit(0.0))
    extra = (draw(docs["doc_id"], seed) < rate - F.floor(rate)).cast("int")
    number = F.least(F.floor(rate) + extra, F.lit(most)).cast("int")
    return docs.join(found, docs["source"].eqNullSafe(found[source]), "left").select(
        *[docs[c] for c in docs.columns], text_size(docs["text"]).alias(size), found[source_size], found[target], number.alias(times))


def mix(docs: DataFrame, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with all its columns."""
    times = _added(docs)[-1]
    taken = copies(docs, most, seed).filter(F.col(times) > 0)
    repeated = taken.withColumn(free_name(taken.columns, "mix_copy"), F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes from it."""
    found = copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.round("mix_target", 6).alias("target"),
                        (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
ordered AS (
  SELECT *, 3.0 * source_size / weight AS stop,
         coalesce(sum(source_size) OVER before, 0) AS held,
         (SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER before, 0) AS open_weight
  FROM sources WINDOW before AS (ORDER BY 3.0 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT max(CASE WHEN ((SELECT sum(source_size) FROM sources) - 3.0 * held) / open_weight <= stop
                  THEN ((SELECT sum(source_size) FROM sources) - 3.0 * held) / open_weight END) AS level FROM ordered),
rated AS (
  SELECT source, source_size, least(3.0 * source_size, level * weight)::DOUBLE AS target FROM sources, levels),
drawn AS (
  SELECT d.doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || left(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * least(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM drawn
"""
