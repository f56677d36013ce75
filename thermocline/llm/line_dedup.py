"""Line dedup: equal lines and lines one edit apart, found by a join of hashed deletion variants; the earliest stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import free_name, table, text_key

SHORTEST_NEAR = 20  # characters; shorter lines are compared for equality only
SECTIONS = 8
BROADCAST_LINES = 500_000  # pairs of hashes: about 30 MB as a hash table
BLANK = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def lines(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: (doc_id, text_hash, line_no from 0, line without outer blanks)."""
    split = docs.select("doc_id", text_key(F.col("text")).alias("text_hash"),
                        F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line_no", "line"))
    return split.withColumn("line", _trimmed(F.col("line"))).filter("line <> ''")


def _named(rows: DataFrame) -> DataFrame:
    """Adds two independent hashes, which together stand for the line."""
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def _sections(line: Column, m: int) -> Column:
    """What stays of a line around each of ``m`` sections: array of (key, longer, start, stop).

    Cut the shorter of two lines one edit apart into ``m`` sections: the edit touches one of them only, so the lines agree
    before it, counted from the start, and after it, counted from the end.  A line may be the shorter one or as long as
    its partner (longer false), or have one character more (longer true).  The section is line[start:stop].
    """
    size = F.length(line)

    def around(longer: bool, k: int) -> Column:
        n = size - 1 if longer else size
        start, after = F.floor(n * k / m).cast("int"), n - F.floor(n * (k + 1) / m).cast("int")
        key = F.xxhash64(F.lit(k), n, F.left(line, start), F.right(line, after))
        return F.struct(key.alias("key"), F.lit(longer).alias("longer"), start.alias("start"), (size - after).alias("stop"))

    return F.array(*[around(longer, k) for longer in (False, True) for k in range(m)])


def _halves(line: Column) -> Column:
    """``_sections`` for two sections, reduced to the part that stays: the first or the last half, for both lengths."""
    n = F.length(line)
    keys = [F.xxhash64(F.lit(side), half, F.left(line, half) if side == "first" else F.right(line, half))
            for half in (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")) for side in ("first", "last")]
    return F.when(n >= SHORTEST_NEAR - 1, F.array_distinct(F.array(*keys)))


def distinct_lines(named: DataFrame) -> DataFrame:
    """One row per different line: (h1, h2, first = (doc_id, text_hash, line_no) of its earliest place, places, halves)."""
    rows = named.select("h1", "h2", F.struct("doc_id", "text_hash", "line_no").alias("at"), _halves(F.col("line")).alias("halves"))
    return rows.groupBy("h1", "h2", "halves").agg(F.min("at").alias("first"), F.count("*").alias("places"))


def _variants(key: Column, part: Column, longer: Column) -> Column:
    """The section without each of its characters and, unless it is the longer one, as it is: array of (place, hash).

    The place is the lost character's, -1 for a whole section and -2 for any cut of a longer one.
    """
    n = F.length(part)
    whole = F.when(longer, F.lit(None)).otherwise(F.struct(F.lit(-1).alias("place"), F.xxhash64(key, part).alias("hash")))
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.when(longer, F.lit(-2)).otherwise(i - 1).alias("place"),
        F.xxhash64(key, F.concat(F.left(part, i - 1), F.substr(part, i + 1))).alias("hash")))
    return F.array_compact(F.concat(F.array(whole), F.when(n > 0, cut).otherwise(F.slice(cut, 1, 0))))


def near_lines(named: DataFrame, distinct: DataFrame, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Lines with an earlier line one edit away: (h1, h2), each once.

    Only lines that agree with another one outside of a half, and then outside of a section, can have a partner; they alone
    emit the deletion variants of that section.  Lines with the same variant that lost the character at the same place
    differ in that character; a line equal to another one's variant is that line shortened.  So each line meets the
    earliest line of its variant, never all of them, and no pair is lost: whoever has an earlier partner has the
    earliest one as a candidate.  Candidates are verified on their texts.
    """
    keyed = distinct.filter(F.col("halves").isNotNull()).select("h1", "h2", "first", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").count().filter("count > 1").select("half")
    left = durable(keyed.join(shared, "half", "left_semi").select("h1", "h2", "first").distinct())
    small = left.count() <= broadcast_lines
    at = F.struct("doc_id", "text_hash", "line_no")
    picked = named.join(F.broadcast(left) if small else left, ["h1", "h2"]).filter(at == F.col("first"))
    texts = durable(picked.select("h1", "h2", "line", "first").distinct())

    parts = texts.select("h1", "h2", "first", "line", F.explode(_sections(F.col("line"), SECTIONS)).alias("s")).select(
        "h1", "h2", "first", "s.key", "s.longer",
        F.substring(F.col("line"), F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")).alias("part"))
    agree = parts.groupBy("key").count().filter("count > 1").select("key")
    parts = durable(parts.join(agree, "key", "left_semi"))
    rows = parts.select("h1", "h2", "first", F.explode(_variants(F.col("key"), F.col("part"), F.col("longer"))).alias("v"))
    rows = rows.select("h1", "h2", "first", "v.place", F.col("v.hash").alias("variant"))
    me = F.struct("first", "h1", "h2")
    same_text, same_cut = Window.partitionBy("variant"), Window.partitionBy("variant", "place")
    swap = F.col("place") >= 0
    met = rows.select("*", F.min(F.when(F.col("place") == -1, me)).over(same_text).alias("shorter"),
                      F.min(F.when(F.col("place") == -2, me)).over(same_text).alias("longer"))
    met = met.select("*", F.min(F.when(swap, me)).over(same_cut).alias("swapped"))
    other = F.when(swap, F.col("swapped")).when(F.col("place") == -1, F.col("longer")).otherwise(F.col("shorter"))
    pairs = met.select("h1", "h2", "first", other.alias("o")).filter(F.col("o.first") < F.col("first"))
    pairs = pairs.select("h1", "h2", F.col("o.h1").alias("g1"), F.col("o.h2").alias("g2")).distinct()
    mine = texts.select("h1", "h2", "line")
    theirs = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("earlier"))
    both = pairs.join(mine, ["h1", "h2"]).join(theirs, ["g1", "g2"])
    long_enough = F.greatest(F.length("line"), F.length("earlier")) >= SHORTEST_NEAR
    return both.filter(long_enough & (F.levenshtein("line", "earlier", 1) == 1)).select("h1", "h2").distinct()


def removals(docs: DataFrame) -> DataFrame:
    """Lines to remove: (doc_id, text_hash, line_no, near).

    A line goes if an equal line (near false) or one a single edit away (near true) stands earlier, in the order of
    doc_id, a hash of the text and line number; a null doc_id comes first.  Being removed does not stop a line from
    removing later ones.  Blank lines stay.  Rows that repeat both id and text are one document.
    """
    named = _named(lines(docs))
    distinct = durable(distinct_lines(named))
    near = near_lines(named, distinct).withColumn("near", F.lit(True))
    # Lines that occur once and have no partner need no decision.
    decided = distinct.drop("halves").join(near, ["h1", "h2"], "left").filter("places > 1 or near")
    at = F.struct("doc_id", "text_hash", "line_no")
    found = named.drop("line").join(decided, ["h1", "h2"])
    gone = found.filter(F.col("near") | (at != F.col("first")))
    return gone.select("doc_id", "text_hash", "line_no", (at == F.col("first")).alias("near"))


def removed_by_document(docs: DataFrame) -> DataFrame:
    """(gone_id, gone_hash, gone, gone_near): the removed line numbers of each document that loses lines, in order."""
    return removals(docs).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("line_no")).alias("gone"),
        F.count_if("near").alias("gone_near")).withColumnsRenamed({"doc_id": "gone_id", "text_hash": "gone_hash"})


def dedup_lines(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; all columns stay, whatever their names.

    With ``drop_emptied`` a document that had lines and keeps none goes; a document that was blank before stays as it is,
    a null text too.  Rows that repeat id and text are cut alike; an empty table stays empty.
    """
    gone = removed_by_document(docs)
    names = [free_name(docs.columns, c) for c in gone.columns]
    gone = gone.toDF(*names)
    key, hashed, lost = (gone[c] for c in names[:3])
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(key) & (text_key(docs["text"]) == hashed), "left")
    split = F.split(docs["text"], "\n")
    places = F.sequence(F.lit(0), F.size(split) - 1)
    kept = F.transform(F.array_except(places, lost), lambda i: F.element_at(split, i + 1))
    text = F.when(lost.isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    cut = free_name(docs.columns, "cut")
    out = joined.select(*[docs[c] for c in docs.columns if c != "text"], text.alias("text"), lost.isNotNull().alias(cut))
    if drop_emptied:
        out = out.filter(~F.col(cut) | (F.btrim(F.col("text"), F.lit(BLANK + "\n")) != ""))
    return out.select(*docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of lines that are not blank, the numbers of the lines it loses, and why."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", text_key(F.col("text")).alias("text_hash"), F.size(F.filter(
        F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: _trimmed(x) != "")).cast("long").alias("n_lines"))
    gone = removed_by_document(docs)
    same = counted["doc_id"].eqNullSafe(gone["gone_id"]) & (counted["text_hash"] == gone["gone_hash"])
    none = F.lit(0).cast("long")
    return counted.join(gone, same, "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone").cast("long") - F.col("gone_near"), none).alias("n_equal"),
        F.coalesce("gone_near", none).alias("n_near"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))


# The SQL cuts every line of the table in every way and joins the texts themselves.
OP8_SQL = r"""
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM split),
full_lines AS (SELECT * FROM lines WHERE line <> ''),
firsts AS (SELECT line, min(ROW(doc_id, line_no)) AS first FROM full_lines GROUP BY line),
cuts AS (SELECT line, first, i, hash(left(line, i - 1) || substr(line, i + 1)) AS rest
         FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS i FROM firsts WHERE length(line) >= 19)),
pairs AS (
  SELECT a.line, b.line AS other, a.first, b.first AS other_first FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.line <> b.line
  WHERE length(a.line) >= 20
  UNION ALL SELECT a.line, b.line, a.first, b.first FROM cuts a JOIN firsts b ON a.rest = hash(b.line) WHERE length(a.line) >= 20
  UNION ALL SELECT b.line, a.line, b.first, a.first FROM cuts a JOIN firsts b ON a.rest = hash(b.line) WHERE length(a.line) >= 20),
near AS (SELECT DISTINCT line FROM pairs WHERE other_first < first),
gone AS (
  SELECT doc_id, line_no, ROW(doc_id, line_no) = first AS near FROM full_lines JOIN firsts USING (line)
  WHERE ROW(doc_id, line_no) <> first OR line IN (SELECT line FROM near)),
by_doc AS (SELECT doc_id, count(*) FILTER (NOT near) AS n_equal, count(*) FILTER (near) AS n_near,
                  string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce((SELECT count(*) FROM full_lines f WHERE f.doc_id = d.doc_id), 0) AS n_lines,
       coalesce(n_equal, 0) AS n_equal, coalesce(n_near, 0) AS n_near, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN by_doc b ON d.doc_id = b.doc_id
"""
