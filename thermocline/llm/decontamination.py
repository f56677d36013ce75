"""Benchmark decontamination: n-gram windows of test items looked up in every window of the training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BETWEEN_WORDS_AS_WRITTEN, BROADCAST_ROWS, counted, table, text_key, words

WINDOW = 10
BROADCAST_WINDOWS = 500_000  # windows of ten short words: about 100 MB as a hash table


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the test items: (hash, gram, length, items).

    An item shorter than a window, but not empty, is one window.  Items without words have none.  A null item id
    counts as the empty one.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    grams = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("gram"))
    return grams.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        F.xxhash64("gram").alias("hash"), "gram", F.size("gram").alias("length"), "items")


def _hashes(lengths: list[int]) -> Column:
    """Hash of every window of the words ``w``, length after length."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
        every = F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, n)))
        return F.when(F.size("w") >= n, every).otherwise(F.expr("cast(array() as array<bigint>)"))

    return F.concat(*map(of, lengths))


def _start(lengths: list[int]) -> Column:
    """Zero-based first word of the window at place ``place`` of ``_hashes``."""
    before, start = F.lit(0), None
    for n in lengths:
        here = F.col("place") - before
        start = here if start is None else F.when(F.col("length") == n, here).otherwise(start)
        before = before + F.greatest(F.size("w") - (n - 1), F.lit(0))
    return start


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per distinct (doc_id, text): (doc_id, text_hash, n_words, spans, items).

    ``spans`` holds the distinct occurrences (start, length) in words, in order, ``items`` the items they come from.
    Null texts have no words.  Rows that repeat both id and text count once.

    One scan of the texts.  The window table is broadcast when its counted rows are few, and then nothing is shuffled
    but one narrow row per document and hit; a larger one meets the hashes in a shuffle.  A hash only nominates: the
    words themselves are compared afterwards.
    """
    grams = benchmark_windows(benchmark, window)
    sizes = {r["length"]: r["count"] for r in grams.groupBy("length").count().collect()}  # at most ``window`` rows
    lengths = sorted(sizes, reverse=True)
    read = docs.select("doc_id", text_key(F.col("text")).alias("text_hash"), words(F.col("text")).alias("w"))
    if not lengths:
        return read.select("doc_id", "text_hash", F.size("w").alias("n_words"),
                           F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"),
                           F.expr("cast(array() as array<string>)").alias("items")).distinct()
    hashed = read.withColumn("hashes", _hashes(lengths))
    if sum(sizes.values()) <= broadcast_windows:
        # The outer form keeps documents without windows, and keeps the optimizer from computing the hashes twice.
        places = hashed.select("doc_id", "text_hash", "w", F.posexplode_outer("hashes").alias("place", "hash"))
        found = places.join(F.broadcast(grams), "hash", "left")
        found = found.filter(F.col("gram").isNotNull() | (F.coalesce("place", F.lit(0)) == 0))
    else:
        places = hashed.select("doc_id", "text_hash", F.posexplode_outer("hashes").alias("place", "hash"))
        named = places.join(grams, "hash").distinct().alias("n")
        same = F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.text_hash") == F.col("n.text_hash"))
        found = read.alias("d").join(named, same, "left").select("d.*", "place", "gram", "length", "items")
    found = found.withColumn("start", _start(lengths))
    hit = F.slice("w", F.col("start") + 1, F.col("length")) == F.col("gram")
    found = found.select("doc_id", "text_hash", F.size("w").alias("n_words"),
                         F.when(F.col("gram").isNotNull(), hit).alias("hit"), "start", "length", "items")
    return found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("hit"), F.struct("start", "length")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hit"), F.col("items")))))).alias("items"))


def covered(spans: Column) -> Column:
    """Number of words inside at least one of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    def step(acc, s):
        end = F.greatest(acc["end"], s["start"] + s["length"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], s["start"])).alias("n"), end.alias("end"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and without the separators that follow them."""
    parts = F.split(text, BETWEEN_WORDS_AS_WRITTEN)
    gaps = F.concat(F.regexp_extract_all(text, F.lit(BETWEEN_WORDS_AS_WRITTEN), F.lit(0)), F.array(F.lit("")))
    skipped = F.when(F.element_at(parts, 1) == "", F.lit(1)).otherwise(F.lit(0))
    whole = F.zip_with(parts, gaps, lambda p, g: F.concat(p, g))

    def kept(part, i):
        inside = F.exists(spans, lambda s: (i - skipped >= s["start"]) & (i - skipped < s["start"] + s["length"]))
        return F.when(inside, F.lit("")).otherwise(part)

    return F.array_join(F.transform(whole, kept), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (``action="documents"``) or without their spans (``"spans"``).

    All columns stay; rows that repeat an id are judged by their own text.  An empty table gives an empty table.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"unknown action {action!r}")
    bad = hits(docs, benchmark, window).filter(F.size("spans") > 0)
    spans = [F.col("spans").alias("bad_spans")] if action == "spans" else []
    bad = counted(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"), *spans),
                  BROADCAST_ROWS // 10 if spans else BROADCAST_ROWS)
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (text_key(docs["text"]) == bad["bad_hash"])
    if action == "documents":
        return docs.join(bad, same, "left_anti")
    clean = F.when(bad["bad_spans"].isNull(), docs["text"]).otherwise(without_spans(docs["text"], bad["bad_spans"]))
    columns = [clean.alias("text") if c == "text" else docs[c] for c in docs.columns]
    return docs.join(bad, same, "left").select(*columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside occurrences of benchmark windows; rows that repeat are answered one by one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, table(spark, sf_dir, "benchmark")).withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_hash"))
    found = rows.join(found, rows["doc_id"].eqNullSafe(found["found_id"]) & (rows["text_hash"] == found["found_hash"]))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + 9] AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS gram
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i
        FROM words CROSS JOIN (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN grams g ON p.n = g.n AND p.gram = g.gram),
marks AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN marks USING (doc_id) LEFT JOIN named USING (doc_id)
"""
