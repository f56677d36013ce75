"""Secret scans: fixed patterns, and windows of high Shannon entropy per character class, outside an allow-list."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Kind, pattern, group whose length counts (0 is the match), least length.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A run of 16 or more is the same run whether shorter ones are matched and dropped or not matched at all.
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``letters`` of at least ``window`` characters; windows with more than ``bits`` of entropy are secrets."""

    kind: str
    pattern: str
    letters: str
    window: int
    bits: float


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
CLASSES = (
    CharacterClass("entropy_hex", "[0-9A-Fa-f]{20,}", "0123456789abcdef", 20, 3.01),
    CharacterClass("entropy_base64", "[A-Za-z0-9+/_-]{24,}", LETTERS + "+/_-", 24, 4.01),
)
KINDS = [k for k, *_ in PATTERNS] + [c.kind for c in CLASSES]

# Whole runs that look random and are not: numbers, UUIDs.
PLAIN_RUN = r"^([0-9+/_-]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"
# Dense stretches that are not secrets: words of documentation and ordered alphabets, and letters that read as words, without a
# digit and without capitals strewn in between.
ALLOWED = r"(?i)example|placeholder|dummy|changeme|abcdefghij|0123456789"
STREWN = r"[0-9]|[A-Z][a-z]{1,2}[A-Z]"
PIECE = 256  # windows that one fold goes through


def _places(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of the pattern, left to right: array of (start, stop, word), code points; word is the group's text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    words = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("found"), words.alias("word"), F.slice(gaps, 1, F.size(found)).alias("gap"))

    def step(acc, m):
        start = acc["at"] + F.length(m["gap"])
        stop = start + F.length(m["found"])
        one = F.struct(start.alias("start"), stop.alias("stop"), m["word"].alias("word"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    empty = F.expr("cast(array() as array<struct<start:int,stop:int,word:string>>)")
    all_of = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(pattern)), all_of).otherwise(empty)


def _spans(places: Column, kind: str) -> Column:
    """Sortable spans (start, kind number, stop)."""
    return F.transform(places, lambda p: F.struct(
        p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), p["stop"].alias("stop")))


def _base_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    return _spans(F.filter(_places(text, pattern, group), lambda p: F.length(p["word"]) >= least), kind)


def _weight(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _dense_piece(codes: Column, of: CharacterClass) -> Column:
    """Stretches of a short array of letter numbers covered by windows above the class's entropy: array of (start, stop).

    The counts of the window's characters and the sum of n log n over them move along with the window: one character
    enters and one leaves, everything else stays.
    """
    most = math.log2(of.window)

    def move(acc, i):
        enters, leaves = F.get(acc["codes"], i), F.get(acc["codes"], i - of.window)
        full = i >= of.window
        inside = F.get(acc["counts"], enters)
        total = acc["total"] + _weight(inside + 1) - _weight(inside)
        # The leaving character is counted after the entering one, which may be the same.
        outside = F.get(acc["counts"], leaves) + (enters == leaves).cast("int")
        total = total + F.when(full, _weight(outside - 1) - _weight(outside)).otherwise(F.lit(0.0))
        counts = F.transform(acc["counts"], lambda n, k: n + (k == enters).cast("int") - (full & (k == leaves)).cast("int"))
        return counts, total

    def step(acc, i):
        counts, total = move(acc, i)
        start, stop = i + 1 - of.window, i + 1
        high = (start >= 0) & (F.lit(most) - total / of.window > of.bits)
        n = F.size(acc["out"])
        last = F.get(acc["out"], n - 1)
        longer = F.concat(F.slice(acc["out"], 1, F.greatest(n - 1, F.lit(0))),
                          F.array(F.struct(last["start"].alias("start"), stop.alias("stop"))))
        another = F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))
        out = F.when(~high, acc["out"]).when((n > 0) & (last["stop"] >= start), longer).otherwise(another)
        return F.struct(acc["codes"].alias("codes"), counts.alias("counts"), total.alias("total"), out.alias("out"))

    begin = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(of.letters)).alias("counts"),
                     F.lit(0.0).alias("total"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, step, lambda acc: acc["out"])


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used inside."""
    return F.get(F.transform(F.array(value), use), 0)


def dense_windows(word: Column, of: CharacterClass) -> Column:
    """Stretches of ``word`` covered by windows above the class's entropy: array of (start, stop).

    A fold copies what it carries at every step, so a run is cut into pieces that overlap by a window less one character: every
    window lies in one piece.  Stretches of neighbouring pieces that touch are joined, so the cost follows the length.
    """
    codes = F.transform(F.array_remove(F.split(word, ""), ""), lambda c: F.instr(F.lit(of.letters), c) - 1)

    def pieces(all_codes):
        starts = F.sequence(F.lit(0), F.greatest(F.size(all_codes) - of.window, F.lit(0)), F.lit(PIECE))
        return F.flatten(F.transform(starts, lambda at: F.transform(
            _dense_piece(F.slice(all_codes, at + 1, PIECE + of.window - 1), of),
            lambda s: F.struct((at + s["start"]).alias("start"), (at + s["stop"]).alias("stop")))))

    def joined(found):
        first = F.filter(found, lambda s, i: (i == 0) | (F.get(found, i - 1)["stop"] < s["start"]))
        last = F.filter(found, lambda s, i: (i == F.size(found) - 1) | (F.get(found, i + 1)["start"] > s["stop"]))
        return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["stop"].alias("stop")))

    return _once(_once(codes, pieces), joined)


def _entropy_spans(text: Column, of: CharacterClass, allowed: str) -> Column:
    """Dense stretches of all runs, but for those that the allow-list knows; it is asked about the stretch, not its surroundings."""
    candidates = F.filter(_places(text, of.pattern), lambda p: ~F.rlike(p["word"], F.lit(PLAIN_RUN)))

    def secret(word: Column) -> Column:
        return F.rlike(word, F.lit(STREWN)) & ~F.rlike(word, F.lit(allowed))

    def spans(p):
        found = F.transform(dense_windows(F.lower(p["word"]) if of.kind == "entropy_hex" else p["word"], of), lambda w: F.struct(
            w["start"].alias("start"), w["stop"].alias("stop"), F.substring(p["word"], w["start"] + 1, w["stop"] - w["start"]).alias("word")))
        return F.transform(F.filter(found, lambda w: secret(w["word"])), lambda w: F.struct(
            (p["start"] + w["start"]).alias("start"), F.lit(KINDS.index(of.kind)).alias("kind"), (p["start"] + w["stop"]).alias("stop")))

    return F.flatten(F.transform(candidates, spans))


def scan(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: str = ALLOWED) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every row of ``docs``: arrays of (start, kind number, stop), in order.

    ``base`` holds the fixed patterns, ``spans`` also the entropy windows that no base span contains.  A null text is
    empty.  Rows are handled one by one: nothing is shuffled, repeated rows repeat their result.
    """
    read = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = [_base_spans(F.col("text"), *row) for row in PATTERNS]
    based = read.select("doc_id", "text", F.array_sort(F.concat(*base)).alias("base"))
    dense = F.concat(*[_entropy_spans(F.col("text"), c, allowed) for c in classes])
    added = F.filter("dense", lambda d: ~F.exists("base", lambda b: (b["start"] <= d["start"]) & (b["stop"] >= d["stop"])))
    return based.withColumn("dense", dense).select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _written(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["stop"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of pattern matches per kind and all spans."""
    found = scan(table(spark, sf_dir, "documents"))

    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *map(number, range(len(PATTERNS))), F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                        _written(F.col("spans")).alias("spans"))


def _sql_places(name: str, pattern: str, group: int, kept: str) -> str:
    """Matches with their places, from the gaps between them."""
    quoted = pattern.replace("'", "''")
    return f"""
{name}_cut AS (SELECT doc_id, regexp_extract_all(text, '{quoted}', 0) AS found, regexp_extract_all(text, '{quoted}', {group}) AS word,
               string_split_regex(text, '{quoted}') AS gap FROM texts WHERE regexp_matches(text, '{quoted}')),
{name}_row AS (SELECT doc_id, i, found[i] AS found, word[i] AS word, gap[i] AS gap FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM {name}_cut)),
{name} AS (SELECT * FROM (
  SELECT doc_id, found, word, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) - length(found) AS start FROM {name}_row)
  WHERE {kept})"""


def _sql() -> str:
    """Windows are counted one by one here, without carrying anything over."""
    parts = [_sql_places(kind, pattern, group, f"length(word) >= {least}") for kind, pattern, group, least in PATTERNS]
    for c in CLASSES:
        letter = "lower(ch)" if c.kind == "entropy_hex" else "ch"
        parts.append(_sql_places(c.kind, c.pattern, 0, f"NOT regexp_matches(found, '{PLAIN_RUN}')"))
        parts.append(f"""
{c.kind}_window AS (SELECT doc_id, start AS run_start, start + k AS start, found[k + 1:k + {c.window}] AS part
  FROM (SELECT *, unnest(range(0, length(found) - {c.window} + 1)) AS k FROM {c.kind})),
{c.kind}_count AS (SELECT doc_id, run_start, start, {letter} AS ch, count(*) AS n
  FROM (SELECT doc_id, run_start, start, unnest(string_split(part, '')) AS ch FROM {c.kind}_window) GROUP BY ALL),
{c.kind}_high AS (SELECT doc_id, run_start, start FROM {c.kind}_count GROUP BY ALL
  HAVING log2({c.window}) - sum(n * log2(n)) / {c.window} > {c.bits}),
{c.kind}_fresh AS (SELECT *, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id, run_start ORDER BY start) + {c.window}
                                  THEN 0 ELSE 1 END AS fresh FROM {c.kind}_high),
{c.kind}_run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, run_start ORDER BY start) AS run FROM {c.kind}_fresh),
{c.kind}_stretch AS (SELECT doc_id, run_start, min(start) AS start, max(start) + {c.window} AS stop FROM {c.kind}_run GROUP BY doc_id, run_start, run),
{c.kind}_text AS (SELECT s.*, substr(found, CAST(s.start - run_start + 1 AS BIGINT), CAST(s.stop - s.start AS BIGINT)) AS stretch
  FROM {c.kind}_stretch s JOIN {c.kind} r ON r.doc_id = s.doc_id AND r.start = s.run_start),
{c.kind}_span AS (SELECT doc_id, start, stop FROM {c.kind}_text WHERE regexp_matches(stretch, '{STREWN}') AND NOT regexp_matches(stretch, '{ALLOWED}'))""")
    base = " UNION ALL ".join(f"SELECT doc_id, start, {i} AS kind, start + length(found) AS stop FROM {kind}"
                              for i, (kind, *_) in enumerate(PATTERNS))
    dense = " UNION ALL ".join(f"SELECT doc_id, start, {KINDS.index(c.kind)} AS kind, stop FROM {c.kind}_span" for c in CLASSES)
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    listed = f"string_agg({names} || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind, stop)"
    numbers = ", ".join(f"coalesce((SELECT count(*) FROM {kind} k WHERE k.doc_id = t.doc_id), 0) AS n_{kind}" for kind, *_ in PATTERNS)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),{','.join(parts)},
base AS ({base}), dense AS ({dense}),
added AS (SELECT * FROM dense d WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.doc_id = d.doc_id AND b.start <= d.start AND b.stop >= d.stop)),
base_text AS (SELECT doc_id, {listed} AS listed FROM base GROUP BY doc_id),
all_text AS (SELECT doc_id, {listed} AS listed FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
SELECT t.doc_id, {numbers}, sha256(coalesce(b.listed, '')) AS base_sha256, coalesce(a.listed, '') AS spans
FROM texts t LEFT JOIN base_text b USING (doc_id) LEFT JOIN all_text a USING (doc_id)
"""


OP4_SQL = _sql()
