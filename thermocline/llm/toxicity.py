"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, free_name, remainder, table, words

FOLDS = 5
FEATURES = 1024  # words and beginnings of words the sentence model looks at
TRAIN_DOCUMENTS = 12_000  # bound on the labelled documents the weights are fitted on
STEMS = (4, 5, 6, 7)  # characters
REMEMBERED = 200_000  # words a task remembers before it starts afresh
LEAST_DOCUMENTS = 5  # labelled documents a word must occur in
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.5

# One table for a whole text as bytes: letters in lower case, ends of sentences as line ends, what separates words as a
# blank.  Bytes beyond ASCII stay, so words are those of ``common.words``, and every byte keeps its place.
_TABLE = bytes(
    10 if chr(b) in ".!?\n" else b if b > 127 or chr(b).isalnum() else 32
    for b in (bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))))
_SENTENCE = re.compile(rb"[^\n]+")


@dataclass
class Model:
    """Weight of each feature in a sentence, the bias, and the leak: the label's probability without any sentence."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    leak: float = 0.0


def _sentences(text: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, stop, words) of each sentence that has words; places are bytes of the UTF-8 text."""
    for m in _SENTENCE.finditer(text.encode("utf-8", "replace").translate(_TABLE)):
        found = m[0].split(b" ")
        if any(found):
            yield m.start(), m.end(), found


def _softplus(x):
    return np.logaddexp(0.0, x)


def word_features(word: str) -> list[str]:
    """What the sentence model sees of a word: the word, and its beginnings marked by a trailing hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) >= n)]


def _feature_column(text: Column) -> Column:
    """The distinct features of all words of a text, as ``word_features`` has them."""
    found = F.array_distinct(words(text))

    def beginnings(n: int) -> Column:
        return F.transform(F.filter(found, lambda w: F.length(w) >= n), lambda w: F.concat(F.left(w, F.lit(n)), F.lit("-")))

    return F.array_distinct(F.concat(found, *map(beginnings, STEMS)))


class _Lookup:
    """Numbers of the chosen features of a word, remembered for the words met so far."""

    def __init__(self, number: dict[str, int]):
        self.number, self.met = number, {}

    def __call__(self, found: list[bytes]) -> list[int]:
        met, here = self.met, set()
        for word in found:
            numbers = met.get(word)
            if numbers is None:
                if len(met) >= REMEMBERED:
                    met.clear()
                text = word.decode("utf-8", "replace")
                numbers = met[word] = tuple(self.number[f] for f in word_features(text) if f in self.number)
            if numbers:
                here.update(numbers)
        return sorted(here)


def fit(y: np.ndarray, doc_of: np.ndarray, sent_of: np.ndarray, feature_of: np.ndarray, n_features: int, steps: int = 300,
        rate: float = 0.15, ridge: float = 2e-4) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak by full-batch gradient steps.

    ``y`` are the labels of the documents, ``doc_of`` the document of each sentence; every feature of a sentence is one
    entry of ``sent_of`` and ``feature_of``.  A document is clean only if none of its sentences is toxic and the leak does
    not strike: P(label 1) = 1 - (1 - leak) * prod(1 - p(sentence)).
    """
    n_sent = len(doc_of)
    theta = np.concatenate([np.zeros(n_features), [-6.0, math.log(max(y.mean(), 1e-4)) - 2.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, bias, leak = theta[:-2], theta[-2], theta[-1]
        z = np.bincount(sent_of, weights=w[feature_of], minlength=n_sent) + bias if n_sent else np.zeros(0)
        clean = -np.bincount(doc_of, weights=_softplus(z), minlength=len(y)) - _softplus(leak)  # log P(label 0)
        clean = np.minimum(clean, -1e-9)
        # d(-log likelihood)/d(clean) of each document
        slope = np.where(y > 0, np.exp(clean) / -np.expm1(clean), -1.0) / len(y)
        dz = -slope[doc_of] / (1.0 + np.exp(-z)) if n_sent else z
        grad = np.empty_like(theta)
        grad[:-2] = np.bincount(feature_of, weights=dz[sent_of], minlength=n_features) + ridge * w
        grad[-2] = dz.sum()
        grad[-1] = -(slope / (1.0 + math.exp(-leak))).sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-2], float(theta[-2]), float(1.0 / (1.0 + math.exp(-theta[-1])))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the documents whose label may be learned from; a document labelled both ways is toxic.

    Few labels are broadcast after counting them, so that texts stay where they are; more meet the texts in a shuffle.
    """
    known = labels.filter("toxic is not null and doc_id is not null").filter(remainder(F.col("doc_id"), FOLDS) != 0)
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    small = labels.count() <= BROADCAST_LABELS
    read = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return read.join(F.broadcast(known) if small else known, "doc_id")


def _chosen_words(rows: DataFrame, totals, features: int) -> list[str]:
    """The features whose presence in a document goes most with its label (chi square over all labelled documents)."""
    n, pos = totals["n"], totals["pos"]
    counts = rows.select("toxic", F.explode(_feature_column(F.col("text"))).alias("word")).groupBy("word").agg(
        F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("in_docs"))
    cross = F.col("a") * F.lit(float(n)) - F.col("in_docs") * F.lit(float(pos))
    chi = cross * cross / (F.col("in_docs") * (F.lit(float(n) + 1) - F.col("in_docs")))
    best = counts.filter(F.col("in_docs") >= LEAST_DOCUMENTS).orderBy(chi.desc(), "word").limit(features)
    return [r["word"] for r in best.collect()]


def train(docs: DataFrame, labels: DataFrame, features: int = FEATURES, documents: int = TRAIN_DOCUMENTS) -> Model:
    """A model from the labels of the training fold.

    Word statistics cover all labelled documents.  The weights are fitted on at most about ``documents`` of them, drawn by a
    hash of the id; only the numbers of the chosen words, sentence by sentence, leave the executors.  Without labels
    every score is 0; with labels of one kind only, every score is about that label's share.
    """
    rows = labelled(docs, labels)
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    if not totals["n"]:
        return Model()
    chosen = _chosen_words(rows, totals, features)
    if not chosen or totals["pos"] in (0, totals["n"]):
        return Model(leak=totals["pos"] / totals["n"])
    number = {w: i for i, w in enumerate(chosen)}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(number)
        for batch in batches:
            bags = [[lookup(found) for _, _, found in _sentences(t)]
                    for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(bags, pa.list_(pa.list_(pa.int32())))],
                                             ["toxic", "bag"])

    share = min(1.0, documents / totals["n"])
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = drawn.select("toxic", "text").mapInArrow(extract, "toxic int, bag array<array<int>>").toArrow()
    y = found.column("toxic").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return Model(leak=totals["pos"] / totals["n"])
    bags = found.column("bag").combine_chunks()
    sentences = bags.flatten()
    per_doc, per_sentence = (np.diff(x.offsets.to_numpy()) for x in (bags, sentences))
    weights, bias, leak = fit(y, np.repeat(np.arange(len(y)), per_doc), np.repeat(np.arange(len(sentences)), per_sentence),
                              sentences.flatten().to_numpy(), len(chosen))
    return Model({w: float(weights[i]) for w, i in number.items()}, bias, leak)


def _scored(text: str, model: Model, weights: list[float], lookup: _Lookup, plain: float) -> tuple[float, list[tuple[int, int, int, float]]]:
    """Score of a text and its offending sentences (number, start, stop, score), places in code points."""
    clean, hits, number = math.log1p(-min(model.leak, 1 - 1e-12)), [], -1
    for number, (start, stop, found) in enumerate(_sentences(text)):
        here = lookup(found)
        if not here:
            clean -= plain
            continue
        z = model.bias + sum(map(weights.__getitem__, here))
        clean -= max(z, 0.0) + math.log1p(math.exp(-abs(z)))
        if z >= 0:
            hits.append((number, start, stop, 1.0 / (1.0 + math.exp(-z))))
    if hits:
        raw, at, points = text.encode("utf-8", "replace"), 0, 0
        for i, (n, *ends, p) in enumerate(hits):
            for k, end in enumerate(ends):  # in order, so that each byte is decoded once
                points, at = points + len(raw[at:end].decode("utf-8", "ignore")), end
                ends[k] = points
            hits[i] = (n, *ends, p)
    return -math.expm1(clean), hits


def _added(docs: DataFrame) -> tuple[str, str]:
    """Names of the columns that ``score`` adds, with ``_`` in front if ``docs`` has such a column."""
    return free_name(docs.columns, "tox_score"), free_name(docs.columns, "tox_sentences")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with tox_score and tox_sentences (number, start, stop, score of each sentence scored 0.5 or more).

    One scan, no shuffle; the model is a few kilobytes.  Null texts are empty, empty texts get the leak.  Rows are scored one by
    one; an added column whose name ``docs`` holds gets ``_`` in front.
    """
    others = [c for c in docs.columns if c != "text"]
    read = docs.select(F.struct(*others).alias("row"), "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup({f: i for i, f in enumerate(model.weights)})
        weights, plain = list(model.weights.values()), float(_softplus(model.bias))
        kind = pa.list_(pa.struct([("number", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        keys = ("number", "start", "stop", "score")
        for batch in batches:
            found = [_scored(t or "", model, weights, lookup, plain) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("text"), pa.array([s for s, _ in found], pa.float64()),
                pa.array([[dict(zip(keys, h)) for h in hits] for _, hits in found], kind)],
                ["row", "text", "score", "sentences"])

    spans = T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("start", T.IntegerType()),
                                      T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*read.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("sentences", spans)])
    scored = read.mapInArrow(apply, schema)
    names = _added(docs)
    return scored.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns],
                         F.col("score").alias(names[0]), F.col("sentences").alias(names[1]))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored 0.5 or more; all columns stay, null and empty texts pass."""
    return score(docs, train(docs, labels)).filter(F.col(_added(docs)[0]) < THRESHOLD).select(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, whether its label was held out, and its number of offending sentences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("tox_score").alias("score"),
                        (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"),
                        F.size("tox_sentences").cast("long").alias("n_offending"))
