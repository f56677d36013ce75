"""Near-duplicate documents by ProbMinHash: exponential arrivals of weighted shingles, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import components, counted, table, word_bytes

SHINGLE = 5  # words
SIMILARITY = 0.8  # probability Jaccard of shingle counts
BANDS, ROWS = 40, 7  # a pair at 0.8 is missed with probability (1 - 0.8**7)**40 < 1e-4, one at 0.85 with 1e-6
BATCH_ELEMENTS, BATCH_DOCUMENTS = 400_000, 2_000
BROADCAST_IDS = 500_000
BROADCAST_ELEMENTS = 2_000_000  # of eight bytes
REMEMBERED = 300_000  # words whose hash a task remembers before it starts afresh
ROUNDING = 1e-9
SKETCH_BITS = 4  # of each register, kept to estimate the similarity of a pair before its sets are fetched
LATITUDE = 4.5  # standard deviations a pair at the threshold may fall short of its expected agreement: P = 3e-6

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF95


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different runs of ``size`` words, in order, and how often each occurs; fewer words are one run."""
    n = max(len(hashes) - size + 1, min(len(hashes), 1))
    runs = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(hashes))):
        runs = _mixed(runs * _ODD + hashes[k:k + n] + np.uint64(k + 1))
    return np.unique(runs, return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures of ``n`` weighted sets given as flat elements, their weights and their sets.

    Every element arrives again and again, after exponential waits at the rate of its weight, each time in a register
    drawn at random; a register keeps the earliest arrival.  An element stops as soon as its next arrival is later than
    all registers of its set.  Two sets share a register with the probability of their probability Jaccard.
    Waits and registers depend on element and arrival number only.
    """
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, dtype=np.uint64)
    live, time, arrival = np.arange(len(elements)), np.zeros(len(elements)), 0
    while len(live):
        arrival += 1
        noise = _mixed(elements[live] + np.uint64(arrival * _STEP % 2**64))
        wait = -np.log1p(-(noise >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        time = time + wait / weights[live]
        place = owner[live] * registers + (_mixed(noise ^ _ODD) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(time < first[place])
        early = early[np.argsort(-time[early], kind="stable")]  # of several in one register the earliest is written last
        first[place[early]] = time[early]
        kept[place[early]] = elements[live[early]]
        latest = first.reshape(n, registers).max(axis=1)
        goes_on = time < latest[owner[live]]
        live, time = live[goes_on], time[goes_on]
    return kept.reshape(n, registers)


def sketches(registers: np.ndarray) -> np.ndarray:
    """The lowest SKETCH_BITS of a hash of each register, one bit of all registers after the other, packed into numbers."""
    low = _mixed(registers)
    planes = [np.packbits((low >> np.uint64(k)) & np.uint64(1) != 0, axis=1) for k in range(SKETCH_BITS)]
    spare = -planes[0].shape[1] % 8
    planes = [np.ascontiguousarray(np.pad(p, ((0, 0), (0, spare)))).view(np.int64) for p in planes]
    return np.ascontiguousarray(np.concatenate(planes, axis=1))


def _alike(a: Column, b: Column, threshold: float) -> Column:
    """Whether two sketches agree as often as those of a pair at the threshold do, less a wide margin."""
    registers = BANDS * ROWS
    words = -(-registers // 64)
    differ = None
    for w in range(words):
        mask = None
        for k in range(SKETCH_BITS):
            one = F.get(a, F.lit(k * words + w)).bitwiseXOR(F.get(b, F.lit(k * words + w)))
            mask = one if mask is None else mask.bitwiseOR(one)
        differ = F.bit_count(mask) if differ is None else differ + F.bit_count(mask)
    chance = (1.0 - threshold) * (1.0 - 2.0**-SKETCH_BITS)
    return differ <= registers * chance + LATITUDE * (registers * chance * (1 - chance)) ** 0.5


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list column without nulls as arrays on the column's own memory."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


class _WordHashes:
    """64-bit hashes of the words of a text, remembered for the words met so far."""

    def __init__(self):
        self.met = {}

    def __call__(self, text: str) -> np.ndarray:
        met, found = self.met, word_bytes(text)
        if len(met) > REMEMBERED:
            met.clear()
        for word in found:
            if word not in met:
                met[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(met.__getitem__, found), np.uint64, len(found))


def _identity(hashes: np.ndarray) -> tuple[int, int]:
    """Two hashes that together stand for a sequence of words."""
    whole = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h1, h2, bands): identity of the words and band hashes of each text that has words."""
    def bands(sets) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
        found = signatures(np.concatenate([e for e, _ in sets]), np.concatenate([c for _, c in sets]).astype(float), owner,
                           len(sets), BANDS * ROWS)
        drawn = sketches(found)
        found = found.reshape(len(sets), BANDS, ROWS)
        out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), 1))
        for r in range(ROWS):
            out = _mixed(out * _ODD + found[:, :, r])
        return out.view(np.int64), drawn

    def rows(ids, names, sets) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                 for x in bands(sets)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([a for a, _ in names], pa.int64()),
                                           pa.array([b for _, b in names], pa.int64()), *lists],
                                          ["doc_id", "h1", "h2", "bands", "sketch"])

    hashes_of = _WordHashes()
    ids, names, sets, size = [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            hashes = hashes_of(text)
            if not len(hashes):
                continue
            ids.append(doc_id)
            names.append(_identity(hashes))
            sets.append(shingles(hashes))
            size += len(sets[-1][0])
            if size >= BATCH_ELEMENTS or len(sets) >= BATCH_DOCUMENTS:
                yield rows(ids, names, sets)
                ids, names, sets, size = [], [], [], 0
    if sets:
        yield rows(ids, names, sets)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets of different elements: the sum over shared elements d of
    1 / sum over all e of max(x[e] / x[d], y[e] / y[d])."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    u, v = x[i].astype(float), y[j].astype(float)
    order = np.argsort(v / u, kind="stable")
    u, v = u[order], v[order]
    # For elements with a smaller ratio the first quotient is the larger one, for the others the second.
    below = x.sum() - u.sum() + np.cumsum(u)
    above = y.sum() - np.cumsum(v)
    return float((1.0 / (below / u + above / v)).sum())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of pairs of sets; a set whose counts are all 1 comes without them."""
    def weights(elements, counts):
        return counts if len(counts) else np.ones(len(elements))

    for batch in batches:
        found = [1.0 - similarity(a, weights(a, x), b, weights(b, y))
                 for a, x, b, y in zip(*(_lists(batch.column(c)) for c in ("a_set", "a_count", "b_set", "b_count")))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "distance"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first_id, h1, h2, set, count) of each text; ``count`` is empty if every run of words occurs once."""
    hashes_of = _WordHashes()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            hashes = hashes_of(text)
            if len(hashes):
                elements, counts = shingles(hashes)
                rows.append((doc_id, *_identity(hashes), elements.view(np.int64), counts if counts.max() > 1 else counts[:0]))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["first_id", "h1", "h2", "set", "count"])


def shares(sets: DataFrame) -> DataFrame:
    """(id, weight, shared, even): the set's weight, the part of it on elements that other sets have as well, and whether
    all counts are 1."""
    even = F.size("count") == 0
    elements = sets.select("id", even.alias("even"), F.explode(F.when(even, F.transform("set", lambda e: F.struct(
        e.alias("element"), F.lit(1).alias("n")))).otherwise(F.arrays_zip(F.col("set").alias("element"), F.col("count").alias("n")))).alias("e"))
    elements = elements.select("id", "even", "e.element", "e.n")
    several = elements.groupBy("element").count().filter("count > 1").select("element", F.lit(True).alias("several"))
    return elements.join(several, "element", "left").groupBy("id").agg(
        F.sum("n").cast("double").alias("weight"), F.sum(F.when(F.col("several"), F.col("n")).otherwise(0)).cast("double").alias("shared"),
        F.first("even").alias("even"))


def _may_link(threshold: float) -> Column:
    """Whether sets a and b can have that similarity, by the parts of them that other sets share.

    What a pair has in common is at most the smaller shared part; for sets without repetitions the similarity is the
    plain Jaccard, common over joint size, and else it is at most the common share of each set.
    """
    common = F.least("a.shared", "b.shared")
    plain = common >= (threshold - ROUNDING) * (F.col("a.weight") + F.col("b.weight") - common)
    return plain | ~F.col("a.even") | ~F.col("b.even")


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    several = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return members.join(several.select("bucket"), "bucket", "left_semi")


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, distance) of each pair (a, b).

    Many pairs of few sets, as in a large group of copies, stay where they are: the sets are broadcast if their counted
    elements are few.  Otherwise pairs meet their sets in two shuffles.
    """
    pairs = durable(pairs)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    used = durable(sets.join(ids, "id", "left_semi").select("id", "set", "count"))
    elements = used.agg(F.sum(F.size("set") + F.size("count"))).first()[0] or 0
    left, right = (used.select(F.col("id").alias(x), F.col("set").alias(f"{x}_set"), F.col("count").alias(f"{x}_count")) for x in "ab")
    if elements <= BROADCAST_ELEMENTS:
        left, right = F.broadcast(left), F.broadcast(right)
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "a_count", "b_set", "b_count")
    return durable(compared.mapInArrow(_compare, "a long, b long, distance double"))


def links(members: DataFrame, sets: DataFrame, drawn: DataFrame, threshold: float = SIMILARITY, estimate: bool = True) -> DataFrame:
    """Verified links (a, b); what chains of links inside buckets connect is connected here too.

    ``members``: (bucket, id); ``sets``: (id, set, count); ``drawn``: (id, sketch).  First every bucket is compared with its member that has most
    bucket mates, as a rule the original of a group of copies.  What that leaves apart is compared afterwards, each pair
    in the first bucket both are in, except for pairs that cannot matter:
    - both are in one component already, or neither is outside of the bucket's largest component;
    - one of them, or the pair, has too little in common with any other set (``_may_link``);
    - their signatures agree far too rarely (``_alike``), unless ``estimate`` is off;
    - their distances to the bucket's first member differ by more than the link distance: 1 - similarity is the
      probability of two hash values being different, so it obeys the triangle inequality.
    """
    reach = 1.0 - threshold + ROUNDING
    mates = members.groupBy("bucket").agg(F.count("*").alias("mates"))
    central = members.join(mates, "bucket").groupBy("id").agg(F.sum("mates").alias("central"))
    order = Window.partitionBy("bucket").orderBy(F.col("central").desc(), "id")
    first = members.join(central, "id").withColumn("place", F.row_number().over(order)).filter("place = 1")
    met = durable(members.join(first.select("bucket", F.col("id").alias("pivot")), "bucket").select(
        "bucket", "id", "pivot", F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")))
    known = _distances(met.filter("a <> b").select("a", "b").distinct(), sets)
    linked = known.filter(F.col("distance") <= reach).select("a", "b")

    found = components(members.select("id"), linked, "id")
    found = found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component")
    placed = met.join(known, ["a", "b"], "left").select("bucket", "id", F.coalesce("distance", F.lit(0.0)).alias("distance"))
    apart = durable(_open(placed.join(found, "id")))
    if apart.isEmpty():
        return linked
    parts = shares(sets.join(apart.select("id").distinct(), "id", "left_semi"))
    able = parts.filter(F.col("shared") >= (threshold - ROUNDING) * F.col("weight"))
    apart = durable(_open(apart.join(able, "id")))
    lists = apart.groupBy("id").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))  # at most BANDS each
    largest = apart.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("largest"))
    full = durable(apart.join(lists, "id").join(drawn, "id").join(largest.select("bucket", "largest.component").withColumnRenamed(
        "component", "largest"), "bucket"))
    a, b = full.filter("component <> largest").alias("a"), full.alias("b")
    once = (F.col("b.component") == F.col("b.largest")) | (F.col("a.id") < F.col("b.id"))
    near = F.abs(F.col("a.distance") - F.col("b.distance")) <= reach
    here = F.array_min(F.array_intersect("a.buckets", "b.buckets")) == F.col("a.bucket")
    pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.component") != F.col("b.component"))
                   & once & near & _may_link(threshold) & here
                   & (_alike(F.col("a.sketch"), F.col("b.sketch"), threshold) if estimate else F.lit(True)))
    pairs = pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    more = _distances(pairs.join(known, ["a", "b"], "left_anti"), sets)
    return durable(linked.union(more.filter(F.col("distance") <= reach).select("a", "b")))


def _same_document(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different texts of one doc_id."""
    spread = keyed.groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("h1", "h2")))
    several = counted(spread.filter("min_h1 <> max_h1 or min_h2 <> max_h2").select("doc_id"))
    rows = keyed.select("doc_id", "h1", "h2").join(several, "doc_id", "left_semi").distinct().join(
        texts.select("h1", "h2", "id"), ["h1", "h2"]).select("doc_id", "id")
    return rows.join(rows.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").filter("a <> id").select("a", F.col("id").alias("b"))


def classes(docs: DataFrame, threshold: float = SIMILARITY, estimate: bool = True) -> DataFrame:
    """(doc_id, class_id, copies): the class of near-duplicates of every document, named after its smallest doc_id.

    Two documents are linked at a probability Jaccard of ``threshold`` or more between the counts of their runs of five
    words; a class is what links connect.  ``copies`` is the number of rows with the same words.  Documents without
    words and null ids are left out.  The texts of an id that repeats are linked with each other.

    Equal texts are folded first, by a hash of their words, and numbered; signatures, buckets and links concern the numbers of
    different texts only, and doc_ids come back at the end.  Without ``estimate`` every pair that the buckets bring together and
    whose similarity is open is verified, however rarely its signatures agree.
    """
    read = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = durable(read.mapInArrow(_sign, "doc_id long, h1 long, h2 long, bands array<long>, sketch array<long>"))
    texts = durable(keyed.groupBy("h1", "h2", "bands", "sketch").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
                    .withColumn("id", F.monotonically_increasing_id()))
    members = texts.select(F.explode("bands").alias("bucket"), "id").distinct()
    several = members.groupBy("bucket").count().filter("count > 1").select("bucket")
    members = durable(members.join(several, "bucket", "left_semi"))
    wanted = durable(members.select("id").distinct().join(texts, "id").select("id", "first_id", "h1", "h2"))
    small = wanted.count() <= BROADCAST_IDS
    ids = wanted.select(F.col("first_id").alias("doc_id")).distinct()
    chosen = read.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    sets = chosen.mapInArrow(_sets, "first_id long, h1 long, h2 long, set array<long>, count array<int>")
    sets = durable(sets.join(wanted, ["first_id", "h1", "h2"]).select("id", "set", "count").dropDuplicates(["id"]))
    drawn = texts.join(wanted.select("id"), "id", "left_semi").select("id", "sketch")
    linked = links(members, sets, drawn, threshold, estimate).union(_same_document(keyed, texts))
    found = texts.select("id", "h1", "h2", "first_id", "copies").join(components(texts.select("id"), linked, "id"), "id")
    names = found.groupBy("component").agg(F.min("first_id").alias("class_id"))
    named = found.join(names, "component").select("h1", "h2", "class_id", "copies")
    return keyed.select("doc_id", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "class_id", "copies")


def dedup(docs: DataFrame, threshold: float = SIMILARITY, estimate: bool = True) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates, the one with the smallest id; all columns stay."""
    gone = classes(docs, threshold, estimate).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = counted(gone)
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates, its number of equal texts, and whether it stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classes(docs).groupBy(F.col("doc_id").alias("found_id")).agg(F.min("class_id").alias("class_id"), F.max("copies").alias("copies"))
    joined = docs.select("doc_id").join(found, F.col("doc_id") == F.col("found_id"), "left")
    class_id = F.coalesce("class_id", F.col("doc_id").cast("long"))
    return joined.select("doc_id", class_id.alias("class_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
                         class_id.eqNullSafe(F.col("doc_id")).alias("kept"))
