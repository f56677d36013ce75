"""Conversation structure repair: the cheapest edits that make the roles of a conversation follow the grammar.

A conversation becomes a word of role/fault signatures, one character a row.  The distinct words form an automaton that
shares suffixes: a node is a signature in front of a node, so conversations that end alike share nodes, and the cost-to-go
of each node and grammar state is found once for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable
from .common import CRC_TABLE_SQL, counted, crc_sql, table

# Costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 1, 2, 5, 5
SAID = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
DAMAGES = 20
PIECE = 1 << 16  # signatures that a task holds before it hands them on

# A signature: one of 16 letters, role class (s, u, a, other) and fault (none, blank, duplicate, truncated).
ROLES, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
SIGNATURES = "ABCDEFGHIJKLMNOP"
LEGAL = {"su", "ua", "au"}

# Grammar states: nothing yet, after s, after u, after a.  The end needs START or ANSWERED.
START, SYSTEM, ASKED, ANSWERED = range(4)
NEXT_ROLE = ("u", "u", "a", "u")  # the only role that an inserted or re-roled row can have
AFTER = {"s": SYSTEM, "u": ASKED, "a": ANSWERED}
FOLLOWS = {(START, "s"), (START, "u"), (SYSTEM, "u"), (ASKED, "a"), (ANSWERED, "u")}
FULL = {"u": "user", "a": "assistant"}
NEVER = 1 << 40


def damage(convs: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by a hash of ``conv_id:turn``; a null there, in role and in text is one space.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 gives the row twice, 4 makes the
    role user.  conv_id and turn themselves stay null.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % DAMAGES
    read = convs.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return read.filter("hit <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def _plain(convs: DataFrame) -> DataFrame:
    """The four columns, null roles and texts as one space."""
    return convs.select("conv_id", F.col("turn").cast("long").alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _signature(repeated: Column) -> Column:
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(SAID), 1).when(repeated, 2).when(~F.col("text").rlike(ENDED), 3).otherwise(0)
    return F.substring(F.lit(SIGNATURES), (role * 4 + fault + 1).cast("int"), F.lit(1))


def _pieces(limit: int):
    """Sorted rows to pieces of words: neighbours of one conversation, with the place of the first of them."""
    names = ["conv_id", "turn", "role", "digest", "seen"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], [*names, "word"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first, letters = [], None, []
        for batch in batches:
            for *place, letter in zip(*[batch.column(n).to_pylist() for n in (*names, "letter")]):
                if first is None or place[0] != first[0] or len(letters) >= limit:
                    if first is not None:
                        out.append((*first, "".join(letters)))
                    first, letters = place, []
                letters.append(letter)
            if out:
                yield batch_of(out)
                out = []
        if first is not None:
            yield batch_of([(*first, "".join(letters))])

    return rows


def words(convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """The signature word of every conversation that has rows: ``conv_id, word``.

    Rows go by turn, nulls first; rows of one turn by role and digest of the text.  A conversation of any length is spread over
    tasks by that order; a task hands on one character a row.
    """
    rows = convs.select("conv_id", "turn", "role", "text", F.md5("text").alias("digest"))
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    # Only what later steps need goes through the shuffle: faults that the text alone decides are found before it.
    alone = rows.select("conv_id", "turn", "role", "digest", _signature(F.lit(False)).alias("alone"))
    number = F.row_number().over(same).cast("long")
    seen = alone.withColumn("seen", number)
    place = F.instr(F.lit(SIGNATURES), F.col("alone")) - 1
    again = (F.col("seen") > 1) & (place % 4 != 1)
    letter = F.when(again, F.substring(F.lit(SIGNATURES), (place - place % 4 + 3).cast("int"), F.lit(1))).otherwise(F.col("alone"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "seen")]
    sorted_ = seen.withColumn("letter", letter).drop("alone").repartitionByRange(*order).sortWithinPartitions(*order)
    found = sorted_.mapInArrow(_pieces(piece), "conv_id long, turn long, role string, digest string, seen long, word string")
    pieces = F.array_sort(F.collect_list(F.struct("turn", "role", "digest", "seen", "word")), _sooner)
    return found.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["word"]), "").alias("word"))


def _sooner(a: Column, b: Column) -> Column:
    """Order of two pieces by turn, nulls first, role, digest and number."""
    turn = lambda c: F.struct(c["turn"].isNotNull(), F.coalesce(c["turn"], F.lit(0)), c["role"], c["digest"], c["seen"])
    return F.when(turn(a) < turn(b), -1).when(turn(a) > turn(b), 1).otherwise(0)


def _step(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Cost-to-go and first edit of a node from each grammar state, given the costs of the node behind it.

    Edits that tie have different initials, so the least initial starts the least audit.
    """
    at = SIGNATURES.index(letter)
    role, fault = (ROLES + "-")[at // 4], FAULTS[at % 4]
    stays = TRUNCATED_STAYS if fault == "truncated" else 0
    best = []
    for state in range(4):
        options = [(DELETE + after[state], "D")]
        if fault not in ("blank", "duplicate"):
            if (state, role) in FOLLOWS:
                options.append((stays + after[AFTER[role]], "K"))
            options.append((REROLE + stays + after[AFTER[NEXT_ROLE[state]]], "R"))
        best.append(min(options))
    return _inserted(best)


def _inserted(best: list[tuple[int, str]]) -> tuple[tuple[int, ...], str]:
    for _ in range(3):
        best = [min(b, (INSERT + best[AFTER[NEXT_ROLE[s]]][0], "I")) for s, b in enumerate(best)]
    return tuple(c for c, _ in best), "".join(e for _, e in best)


END = _inserted([(0, ""), (NEVER, ""), (NEVER, ""), (0, "")])


def _audit(word: str, edits: list[str]) -> str:
    """The best edits along a word from nothing on; ``edits[i]`` are first edits by state in front of the last ``i`` rows."""
    state, out = START, []
    for left in range(len(word), -1, -1):
        role = (ROLES + "-")[SIGNATURES.index(word[-left]) // 4] if left else ""
        while (edit := edits[left][state:state + 1] if left else _end_edit(state)) == "I":
            out.append("I")
            state = AFTER[NEXT_ROLE[state]]
        if left:
            out.append(edit)
            state = AFTER[role] if edit == "K" else AFTER[NEXT_ROLE[state]] if edit == "R" else state
    return "".join(out)


def _end_edit(state: int) -> str:
    return "" if state in (START, ANSWERED) else "I"


def _solver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and audits of words sorted from their ends.

    Only the nodes of the current word are held.  A word that ends like the one before it goes on from the nodes they
    share.  A node's costs depend on its letter and on the differences of the costs behind it, so those are worked out once.
    """
    steps: dict[tuple[str, tuple[int, ...]], tuple[int, tuple[int, ...], str]] = {}
    base, shape, edits, previous = [0], [END[0]], [END[1]], ""
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for word in batch.column("word").to_pylist():
            back = word[::-1]
            shared = _common(back, previous)
            del base[shared + 1:], shape[shared + 1:], edits[shared + 1:]
            for letter in back[shared:]:
                node = (letter, shape[-1])
                if node not in steps:
                    costs, first = _step(letter, shape[-1])
                    steps[node] = (min(costs), tuple(c - min(costs) for c in costs), first)
                more, differences, first = steps[node]
                base.append(base[-1] + more)
                shape.append(differences)
                edits.append(first)
            previous = back
            faults = np.frombuffer(word.encode(), np.uint8) - ord("A")
            kinds = np.bincount(faults % 4, minlength=4)
            roles = faults // 4
            pairs = roles[:-1] * 4 + roles[1:]
            legal = np.isin(pairs, [ROLES.index(a) * 4 + ROLES.index(b) for a, b in LEGAL]).sum()
            row = (word, int(kinds[1]), int(kinds[2]), int(kinds[3]), len(pairs) - int(legal), base[-1] + shape[-1][START], _audit(word, edits))
            for column, value in zip(columns, row):
                column.append(value)
        types = [pa.string(), *[pa.int64()] * 5, pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)],
                              ["word", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


PLAN = "word string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(found: DataFrame) -> DataFrame:
    """The faults, cost and audit of each distinct word of ``words``."""
    back = F.reverse("word")
    each = found.select("word").distinct().repartitionByRange(back).sortWithinPartitions(back)
    return each.mapInArrow(_solver, PLAN)


def planned(convs: DataFrame) -> DataFrame:
    """Every conversation that has rows with its faults, cost and audit: ``conv_id`` and the columns of ``plans``."""
    found = durable(words(convs))
    return found.join(counted(plans(found)), "word")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order, each conversation's audit in front of them, to repaired rows in order."""
    conv, audit, at, state, place = None, "", 0, START, 0
    out: list[tuple] = []

    def inserts():
        nonlocal at, state, place
        while audit[at:at + 1] == "I":
            out.append((conv, place, "I", None, FULL[NEXT_ROLE[state]], ""))
            state, at, place = AFTER[NEXT_ROLE[state]], at + 1, place + 1

    for batch in batches:
        for key, plan, turn, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "turn", "role", "text")]):
            if plan is not None:  # the next conversation begins
                inserts()
                conv, audit, at, state, place = key, plan, 0, START, 0
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = FULL[NEXT_ROLE[state]]
            out.append((conv, place, edit, turn, role, text))
            state, place = AFTER[role[0]], place + 1
        if out:
            yield _repaired(out)
            out.clear()
    inserts()
    if out:
        yield _repaired(out)


def _repaired(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", "place", "edit", "turn", "role", "text"])


def repaired_rows(convs: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id, place, edit, turn, role, text``; deleted rows are gone, inserted ones have no turn.

    A conversation's rows pass through one task in order, as a stream: held are one audit and a batch of rows.  That is
    what the digest over a whole conversation needs; nothing else is ordered by task.
    """
    rows = _plain(convs).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", F.md5("text").alias("digest"))
    heads = (planned(convs) if plan is None else plan).select(
        "conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "string"))])
    order = [F.col("conv_id"), F.col("audit").isNull(), *[F.col(c).asc_nulls_first() for c in ("turn", "role", "digest")]]
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _applied, "conv_id long, place long, edit string, turn long, role string, text string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``role:text`` lines per conversation, rows in order."""
    conv, digest, ids, found = None, None, [], []
    for batch in batches:
        for key, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")]):
            if place == 0:
                if digest is not None:
                    ids.append(conv)
                    found.append(digest.hexdigest())
                conv, digest = key, hashlib.sha256()
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if ids:
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
            ids, found = [], []
    if digest is not None:
        yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the very result of ``repaired_rows``, whose tasks hold whole conversations in order."""
    return repaired.mapInArrow(_hashed, "conv_id long, repaired_sha256 string")


def repair(convs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row per conversation: ``conv_id``, its turn gaps, faults, the cost and audit of the cheapest repair, and a digest of
    the repaired rows.

    ``convs`` needs conv_id, turn, role and text; other columns are ignored, whatever their names.  ``ids`` adds conversations
    that may have no rows: zeros, an empty audit and the digest of nothing.  A null conv_id is a conversation, a null turn
    comes first, a null role or text is one space.  A repeated row is a duplicate and goes.  An empty table gives an empty result.

    Duplicates, order and words use digests of texts, and the order is a range of rows, so a conversation with very many rows is
    spread over tasks.  Only its text, once, runs through one task, as a stream (``repaired_rows``).
    """
    rows = _plain(convs)
    plan = durable(planned(rows))
    turns = rows.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("turns"))
    gaps = turns.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"))
    text = digests(repaired_rows(rows, plan))
    found = (rows if ids is None else ids).select("conv_id").distinct()
    for part in (gaps, plan.drop("word"), text):
        found = found.join(part, found["conv_id"].eqNullSafe(part["conv_id"]), "left").drop(part["conv_id"])
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and its cheapest repair."""
    convs = table(spark, sf_dir, "conversations")
    return repair(damage(convs), convs)


def _sql() -> str:
    """Costs from the end of each conversation, kept with their whole audits; then the edits from its beginning."""
    stays = f"CASE WHEN f.fault = 't' THEN {TRUNCATED_STAYS} ELSE 0 END"
    add = lambda cost, edit, v: f"{{'c': {cost} + {v}.c, 'e': '{edit}' || {v}.e}}"

    def row_edits(state: int) -> str:
        keeps = [f"CASE WHEN may AND initial = '{r}' THEN {add(stays, 'K', f'v{AFTER[r]}')} END" for s, r in sorted(FOLLOWS) if s == state]
        reroles = f"CASE WHEN may THEN {add(f'{REROLE} + {stays}', 'R', f'v{AFTER[NEXT_ROLE[state]]}')} END"
        return f"list_min([{add(DELETE, 'D', f'v{state}')}, {', '.join(keeps)}, {reroles}]) AS b{state}"

    return rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
hits AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % {DAMAGES} AS hit
         FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE hit WHEN 3 THEN [1, 2] ELSE [1] END) AS time FROM hits WHERE hit <> 0),
seen AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS no,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY turn NULLS FIRST, role, md5(text), seen) AS i FROM seen),
f AS (SELECT *, left(role, 1) AS initial,
             CASE WHEN NOT regexp_matches(text, '{SAID}') THEN 'b' WHEN seen > 1 THEN 'd'
                  WHEN NOT regexp_matches(text, '{ENDED}') THEN 't' ELSE '' END AS fault FROM numbered),
faulted AS (SELECT *, fault NOT IN ('b', 'd') AS may FROM f),
sizes AS (SELECT no, any_value(conv_id) AS conv_id, max(i) AS n,
                 coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated
          FROM faulted GROUP BY no),
pairs AS (SELECT no, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM (SELECT no, lag(initial) OVER (PARTITION BY no ORDER BY i) || initial AS pair FROM faulted) WHERE pair IS NOT NULL GROUP BY no),
togo AS (
  SELECT no, n + 1 AS i, {{'c': 0, 'e': ''}} AS v0, {{'c': 10, 'e': 'II'}} AS v1, {{'c': 5, 'e': 'I'}} AS v2, {{'c': 0, 'e': ''}} AS v3 FROM sizes
  UNION ALL
  SELECT no, i, list_min([b0, {{'c': 5 + v2.c, 'e': 'I' || v2.e}}]) AS v0, list_min([b1, {{'c': 5 + v2.c, 'e': 'I' || v2.e}}]) AS v1, v2, v3
  FROM (SELECT no, i, b0, b1, list_min([b2, {{'c': 5 + b3.c, 'e': 'I' || b3.e}}]) AS v2, list_min([b3, {{'c': 5 + b2.c, 'e': 'I' || b2.e}}]) AS v3
        FROM (SELECT f.no, f.i, {', '.join(row_edits(s) for s in range(4))}
              FROM togo JOIN faulted f ON f.no = togo.no AND f.i = togo.i - 1))),
best AS (SELECT no, CAST(v0.c AS BIGINT) AS cost, v0.e AS audit FROM togo WHERE i = 1),
walk AS (
  SELECT no, 0 AS p, 1 AS i, '' AS last, audit, CAST([] AS VARCHAR[]) AS lines FROM best
  UNION ALL
  SELECT no, p + 1, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE WHEN edit = 'D' THEN last ELSE left(line, 1) END, audit,
         CASE WHEN edit = 'D' THEN lines ELSE list_append(lines, line) END
  FROM (SELECT w.no, p, w.i, last, audit, lines, substr(audit, p + 1, 1) AS edit,
               CASE WHEN substr(audit, p + 1, 1) = 'K' THEN role || ':' || text
                    ELSE CASE WHEN last = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN substr(audit, p + 1, 1) = 'I' THEN '' ELSE text END END AS line
        FROM walk w LEFT JOIN faulted f ON f.no = w.no AND f.i = w.i WHERE p < length(audit))),
repaired AS (SELECT no, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM walk WHERE p = length(audit))
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN pairs USING (no) LEFT JOIN best USING (no) LEFT JOIN repaired USING (no)
"""


OP12_SQL = _sql()
