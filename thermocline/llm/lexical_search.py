"""Ranked lexical search: best-first search over document intervals, bounded by range-maximum tables of posting lists."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable, staged
from .common import table, word_bytes

K = 10
ITEM_BYTES = 32 << 20  # text of the items that one pass over the index answers
BLOCK_POSTINGS = 500_000  # a block of documents is searched when it has so many postings, or ...
BLOCK_DOCS = 100_000  # ... so many documents
FRONT = 32  # intervals split at once
SALTS = 64  # parts of an item's candidates that are ranked apart first
SCALE = 1_000_000_000


def _indexer(known: dict[bytes, int]):
    """Terms of whole texts: the number of all of them, and the items' terms with their occurrences."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = word_bytes(text or "")
                met = Counter(map(known.get, words))
                met.pop(None, None)
                lengths.append(len(words))
                terms.append(list(met.keys()))
                counts.append(list(met.values()))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(lengths, pa.int64()),
                                   pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                                  ["doc_id", "n", "terms", "counts"])

    return rows


def _chunks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items as (number, distinct terms), in blocks of at most about ``limit`` bytes of text."""
    block, size = [], 0
    for row in items.select("item_no", "text").toLocalIterator():
        terms = sorted(set(word_bytes(row["text"] or "")))
        block.append((row["item_no"], terms))
        size += sum(map(len, terms)) + 16
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


class Block:
    """Posting lists of some documents, longest first, with a sparse table of places of maxima per list.

    Documents are numbered by id, null last, so that of two equal scores the one of the lower number wins.
    """

    def __init__(self, ids: np.ndarray, missing: np.ndarray, norm: np.ndarray, term: np.ndarray, doc: np.ndarray, count: np.ndarray):
        order = np.lexsort((ids, missing))
        self.ids, self.missing, self.docs, norm = ids[order], missing[order], len(ids), norm[order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc = place[doc]
        names, term, lengths = np.unique(term, return_inverse=True, return_counts=True)
        longest = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[longest] = np.arange(len(names))
        self.rank = {int(t): int(r) for t, r in zip(names, rank)}
        self.lengths = lengths[longest]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        key = rank[term] * self.docs + doc
        order = np.argsort(key)
        self.key = key[order]
        self.doc, count = doc[order], count[order]
        self.impact = SCALE * count // (1000 * count + 8 * norm[self.doc])
        self._tables()

    def _tables(self) -> None:
        """Level j holds for each place the place of the maximum of the 2^j next ones; only of lists that are so long."""
        level = np.arange(len(self.key), dtype=np.int32)
        levels, j = [level], 1
        while len(self.lengths) and (1 << j) <= self.lengths[0]:
            end = self.starts[np.searchsorted(-self.lengths, -(1 << j), side="right")]  # lists of 2^j postings or more
            half = 1 << (j - 1)
            left = level[:end]
            right = np.concatenate([level[half:end], np.zeros(min(half, end), np.int32)])[:end]  # beyond a list: never asked
            level = np.where(self.impact[right] > self.impact[left], right, left)
            levels.append(level)
            j += 1
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in levels])])
        self.table = np.concatenate(levels)

    def bounds(self, ranks: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval of documents the sum of the lists' maxima in it, and the document of the greatest one."""
        base = (ranks * self.docs)[:, None]
        a, b = np.searchsorted(self.key, base + low), np.searchsorted(self.key, base + high)
        some = b > a
        level = np.where(some, np.frexp(np.maximum(b - a, 1))[1] - 1, 0)
        last = len(self.key) - 1
        left = self.table[self.first[level] + np.where(some, a, 0)]
        right = self.table[self.first[level] + np.where(some, np.clip(b - (1 << level), 0, last), 0)]
        best = np.where(self.impact[right] > self.impact[left], right, left)
        parts = np.where(some, weights[:, None] * self.impact[best], 0)
        top = parts.argmax(axis=0)
        return parts.sum(axis=0), self.doc[best[top, np.arange(len(low))]]

    def scores(self, ranks: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        wanted = (ranks * self.docs)[:, None] + docs
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, weights[:, None] * self.impact[at], 0).sum(axis=0)

    def search(self, ranks: np.ndarray, weights: np.ndarray, k: int, held: list[tuple[int, bool, int]]) -> list[tuple[int, bool, int]]:
        """The k best of ``held`` and of the documents here, as (-score, id is null, id), best first.

        Intervals are taken by their bounds, greatest first.  Each is split at the document with the greatest single
        impact, which is scored; a part goes once its bound can't reach the k-th best any more.
        """
        low, high = np.array([0]), np.array([self.docs])
        bound, split = self.bounds(ranks, weights, low, high)
        while len(low):
            if len(held) >= k:
                least, null, worst = -held[-1][0], held[-1][1], held[-1][2]
                ids, missing = self.ids[low], self.missing[low]
                sooner = (missing < null) | ((missing == null) & (ids < worst))
                open_ = (bound > least) | ((bound == least) & sooner)
            else:
                open_ = bound > 0
            low, high, bound, split = low[open_], high[open_], bound[open_], split[open_]
            if not len(low):
                break
            order = np.lexsort((low, -bound))
            now, later = order[:FRONT], order[FRONT:]
            docs = split[now]
            scores = self.scores(ranks, weights, docs)
            found = [(-int(s), bool(self.missing[d]), int(self.ids[d])) for s, d in zip(scores, docs) if s > 0]
            held = sorted(held + found)[:k]
            new_low = np.concatenate([low[now], docs + 1])
            new_high = np.concatenate([docs, high[now]])
            there = new_low < new_high
            new_low, new_high = new_low[there], new_high[there]
            new_bound, new_split = self.bounds(ranks, weights, new_low, new_high)
            low, high = np.concatenate([low[later], new_low]), np.concatenate([high[later], new_high])
            bound, split = np.concatenate([bound[later], new_bound]), np.concatenate([split[later], new_split])
        return held


def _searcher(shared, docs: int, terms: int, k: int, block_postings: int):
    """Best k documents of a task's part of the index for every item."""
    def norms(n: np.ndarray) -> np.ndarray:
        if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
            return np.array([10 + 90 * int(x) * docs // terms for x in n], np.int64)
        return 10 + 90 * n * docs // terms

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        held: dict[int, list] = {}

        def close(parts: list) -> None:
            sizes = [len(p[0]) for p in parts]
            first = np.concatenate([[0], np.cumsum(sizes)])
            ids, missing, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
            doc = np.concatenate([f + p[3] for f, p in zip(first, parts)])
            term, count = (np.concatenate([p[i] for p in parts]) for i in (4, 5))
            if not len(term):
                return
            block = Block(ids, missing, norms(n), term, doc, count)
            for item, wanted in items:
                there = [t for t in wanted.tolist() if t in block.rank and weights[t] > 0]
                if there:
                    ranks = np.array([block.rank[t] for t in there])
                    held[item] = block.search(ranks, weights[there], k, held.get(item, []))

        parts, postings, number = [], 0, 0
        for batch in batches:
            ids, lists = batch.column("doc_id"), batch.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            parts.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("n").to_numpy(),
                          np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(),
                          batch.column("counts").flatten().to_numpy()))
            postings, number = postings + int(sizes.sum()), number + len(sizes)
            if postings >= block_postings or number >= BLOCK_DOCS:
                close(parts)
                parts, postings, number = [], 0, 0
        if parts:
            close(parts)
        out = [(item, None if null else doc, -score) for item, best in held.items() for score, null, doc in best]
        for start in range(0, len(out), 10_000):
            columns = list(zip(*out[start:start + 10_000]))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["item_no", "doc_id", "score"])

    return rows


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, first inside salted parts so that no task ranks all tasks' candidates of an item."""
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = Window.partitionBy("item_no", "salt").orderBy(*best)
    first = found.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= k)
    whole = Window.partitionBy("item_no").orderBy(*best)
    return first.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k).drop("salt")


def search(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES,
           block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored, whatever their names.  A null or
    empty text has no terms, so it is neither found nor finds anything; without any terms the result is empty.  Rows that
    repeat an id are documents of their own, and rows of ``items`` that repeat an id are answered one by one.  Equal scores go
    by ascending doc_id, null last.

    The texts are read once: each becomes its length and the counts of terms that some item has, kept in the shared folder.
    Sums over these give the corpus counts.  A second pass cuts them into blocks of documents of bounded size inside each
    task, builds the lists and their tables, and keeps k documents per item and task; only those are shuffled.  Items pass
    through the driver in blocks of ``item_bytes``, each with passes of its own.
    """
    spark = docs.sparkSession
    asked = durable(items.select("item_id", "text").withColumn("item_no", F.monotonically_increasing_id()))
    parts = []
    for chunk in _chunks(asked, item_bytes):
        known = {t: i for i, t in enumerate(sorted({t for _, terms in chunk for t in terms}))}
        indexed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _indexer(known), "doc_id long, n long, terms array<int>, counts array<long>")
        index = staged(indexed.filter("n > 0"))
        total = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            break
        held = {r["term"]: r["df"] for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(
            F.count("*").alias("df")).toLocalIterator()}  # at most a row per term of the block
        weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(known))], np.int64)
        wanted = [(no, np.array([known[t] for t in terms], np.int64)) for no, terms in chunk if terms]
        shared = spark.sparkContext.broadcast((wanted, weights))
        parts.append(index.mapInArrow(_searcher(shared, total["docs"], total["terms"], k, block_postings), "item_no long, doc_id long, score long"))
    if not parts:
        found = spark.createDataFrame([], "item_no long, doc_id long, score long")
    else:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionAll(part)
    return _ranked(found, k).join(asked.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH doc_terms AS (
  SELECT no, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS no, * FROM documents)),
item_terms AS (
  SELECT DISTINCT no, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS no, * FROM benchmark)),
counted AS (SELECT no, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM doc_terms GROUP BY no, term),
sized AS (SELECT no, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY no),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
norms AS (SELECT no, 100 - 90 + ((90 * n * docs) // terms) AS m FROM sized, total),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), total),
scored AS (
  SELECT i.no AS item_no, any_value(i.item_id) AS item_id, c.no, any_value(c.doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item_terms i JOIN counted c USING (term) JOIN weights USING (term) JOIN norms n ON n.no = c.no GROUP BY i.no, c.no)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
