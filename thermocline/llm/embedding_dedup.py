"""Embedding near-dedup: iterative quantisation to binary codes, multi-index Hamming tables, rerank by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .common import components, table

COSINE = 0.95
SAMPLE = 10_000  # vectors the rotation is learned from
BITS = 64
ROUNDS = 30
RECALL = 0.97  # of pairs exactly at the threshold, the hardest ones; closer pairs are found more often
SEED = 11


@dataclass
class Quantiser:
    """sign((x - mean) @ axes) as bits, cut into parts looked up within ``radius``; ``reach`` bounds the whole distance."""

    mean: np.ndarray
    axes: np.ndarray
    parts: list[tuple[int, int]]
    radius: int
    reach: int

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes > 0


def learn_rotation(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes: principal directions turned so that the signs lose least (alternating codes and rotation)."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    pca = vectors[:, ::-1][:, :bits]
    seen = centred @ pca
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((pca.shape[1],) * 2))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(seen @ turn).T @ seen)
        turn = right.T @ left.T
    return mean, pca @ turn


def _cut(bits: int, parts: int) -> list[tuple[int, int]]:
    ends = [round(bits * k / parts) for k in range(parts + 1)]
    return list(zip(ends[:-1], ends[1:]))


def learn(sample: np.ndarray, rows: int, cosine: float = COSINE, bits: int = BITS, recall: float = RECALL) -> Quantiser:
    """A quantiser for ``rows`` vectors from a sample of unit vectors.

    Parts have about log2(rows) bits, so that a table of random codes has a few rows per key.  The radius, and if need be
    shorter parts, are chosen so that pairs exactly at the threshold, made from the sample by turning vectors by that
    angle, share a key with probability ``recall``.
    """
    bits = min(bits, sample.shape[1])
    mean, axes = learn_rotation(sample, bits)
    rng = np.random.default_rng(SEED)
    base = sample[rng.permutation(len(sample))[:4000]]
    aside = rng.standard_normal(base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    turned = cosine * base + math.sqrt(1 - cosine**2) * aside
    first = Quantiser(mean, axes, [], 0, 0)
    wrong = first.bits(base) != first.bits(turned)
    reach = int(np.quantile(wrong.sum(axis=1), 0.999)) + 1
    fewest = max(1, round(bits / max(8.0, math.log2(max(rows, 2)))))
    tried = []
    for parts in range(fewest, max(fewest, bits // 6) + 1):
        cut = _cut(bits, parts)
        errors = np.stack([wrong[:, a:b].sum(axis=1) for a, b in cut])
        for radius in (0, 1, 2):
            probes = sum(sum(math.comb(b - a, k) for k in range(radius + 1)) for a, b in cut)
            chance = sum(sum(math.comb(b - a, k) for k in range(radius + 1)) / 2.0 ** (b - a) for a, b in cut)
            found = float((errors <= radius).any(axis=0).mean())
            tried.append((found >= recall, -(probes + rows * chance) if found >= recall else found, parts, radius))
    _, _, parts, radius = max(tried)
    return Quantiser(mean, axes, _cut(bits, parts), radius, reach)


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    x = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    first, last = column.offsets[0].as_py(), column.offsets[len(column)].as_py()
    x = x[first:last].reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encode(quantiser: Quantiser):
    """(id, code, own keys, probes) of each vector: a key is part number and the part's bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = quantiser.bits(_unit(batch.column("x")))
            powers = np.left_shift(np.uint64(1), np.arange(bits.shape[1], dtype=np.uint64))
            code = (bits * powers).sum(axis=1, dtype=np.uint64)
            own, probes = [], []
            for number, (a, b) in enumerate(quantiser.parts):
                part = (bits[:, a:b] * powers[:b - a]).sum(axis=1, dtype=np.uint64)
                # Parts have at most 56 bits, so the number fits above them.
                tagged = part | np.uint64(number << 57)
                own.append(tagged)
                masks = [sum(1 << i for i in flipped) for k in range(quantiser.radius + 1) for flipped in combinations(range(b - a), k)]
                probes.append(tagged[:, None] ^ np.array(masks, dtype=np.uint64)[None, :])
            own, probes = np.stack(own, axis=1).view(np.int64), np.concatenate(probes, axis=1).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))
                     for x in (own, probes)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(code.view(np.int64)), *lists], ["id", "code", "own", "probes"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = (_unit(batch.column("x")) * _unit(batch.column("y"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "cosine"])


def _filled(x, size: int):
    return F.concat(x.cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(size) - F.size(x)))


def different_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors that can have links, equal ones folded: (id, length, x, copies), id the smallest vec_id.

    Null, zero and empty vectors and those with null or non-finite components are left out, as are null ids.  Shorter
    vectors are filled with zeros; ``length`` keeps those of different length apart.
    """
    x = F.col("embedding")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))
    keyed = usable.select("vec_id", "embedding", F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))
    folded = keyed.select("vec_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    return keyed.withColumnRenamed("vec_id", "id").join(folded, ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"])


def near_pairs(reps: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """Verified links (a, b) between rows of ``reps`` (id, embedding), a < b.

    The rotation is learned from at most about ``sample`` rows drawn by a hash; every row is indexed.  A vector looks up
    its keys and those within the radius in every table, survivors of the whole Hamming distance meet their vectors.
    """
    stats = reps.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("size")).first()
    rows, size = stats["n"], stats["size"]
    if rows < 2:
        return reps.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    filled = reps.select("id", F.size("embedding").alias("length"), _filled(F.col("embedding"), size).alias("x"))
    share = min(1.0, sample / rows)
    drawn = filled.filter(F.pmod(F.xxhash64(F.lit("itq"), "id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select("x").toArrow()
    column = drawn.column("x").combine_chunks()
    known = _unit(column) if len(column) else np.eye(size)
    quantiser = learn(known, rows, cosine)
    coded = durable(filled.select("id", "x").mapInArrow(_encode(quantiser), "id long, code long, own array<long>, probes array<long>"))
    own = coded.select(F.col("id").alias("b"), F.col("code").alias("code_b"), F.explode("own").alias("key"))
    probes = coded.select(F.col("id").alias("a"), F.col("code").alias("code_a"), F.explode("probes").alias("key"))
    close = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= quantiser.reach
    candidates = probes.join(own, "key").filter((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    left = filled.select(F.col("id").alias("a"), F.col("length").alias("la"), "x")
    right = filled.select(F.col("id").alias("b"), F.col("length").alias("lb"), F.col("x").alias("y"))
    both = candidates.join(left, "a").join(right, "b").filter("la = lb").select("a", "b", "x", "y")
    return both.mapInArrow(_cosines, "a long, b long, cosine double").filter(F.col("cosine") >= cosine).select("a", "b").distinct()


def groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding).

    Equal vectors are folded before the search; their links among each other and to others are counted by arithmetic.
    Vectors that cannot be compared have no links and are kept.  Rows that repeat both id and vector are one vector; an
    id with several vectors has the links of each row's own vector and the smallest component of its id.
    """
    reps = durable(different_vectors(vectors))
    pairs = durable(near_pairs(reps.select("id", "embedding"), cosine))
    sized = reps.select("id", "copies")
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    linked = ends.join(sized.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.sum("copies").alias("linked"))
    found = components(sized.select("id"), pairs, "id")
    folded = reps.select("h1", "h2", "id", "copies").join(found, "id").join(linked, "id", "left").select(
        "h1", "h2", F.col("component").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    x = F.col("embedding")
    rows = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.xxhash64(x)).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))
    joined = rows.join(folded, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links, its component and whether it is kept."""
    vectors = table(spark, sf_dir, "embeddings")
    return groups(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
