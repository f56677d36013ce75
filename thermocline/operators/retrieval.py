"""Measurements as text documents with metadata, nearest vectors, and what is said about the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import fixed_text, n_rows

TOP = 20
BLOCK_BYTES = 8 << 20  # query vectors compared in one pass over the documents
PAIRS = 1 << 22  # products at a time: 32 MB
MEASURED = 50_000  # gaps at a time: 25 MB of vectors of 64 components
ABSENT = "not available"


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _or_absent(value: Column, digits: int, unit: str) -> Column:
    return F.coalesce(F.when(value.isNotNull(), F.concat(fixed_text(value, digits), F.lit(unit))), F.lit(ABSENT))


def _sentence(there: Column, *parts: Column) -> Column:
    return F.coalesce(F.when(there, F.concat(*parts)), F.lit(""))


def _said(before: str, value: Column, digits: int, after: str, there: Column | None = None) -> Column:
    return _sentence(value.isNotNull() if there is None else there,
                     F.lit(before), fixed_text(value, digits), F.lit(after))


def measurement_text() -> Column:
    """The sentence for one measurement with its context; the wording is fixed."""
    c = F.col
    chlorophyll = c("chlorophyll").isNotNull() & (c("chlorophyll") > 0.01)
    return F.concat(
        F.lit("ARGO float "), c("float_id"), F.lit(" (WMO ID: "), c("wmo_id"), F.lit(") recorded measurements on "),
        _day("time"), F.lit(" during cycle "), c("cycle_number"), F.lit(". The float was located at latitude "),
        fixed_text(c("lat"), 3), F.lit("° and longitude "), fixed_text(c("lon"), 3), F.lit("°. At a depth of "),
        fixed_text(c("depth"), 1), F.lit(" meters, the temperature was "), _or_absent(c("temperature"), 2, "°C"),
        F.lit(" and the salinity was "), _or_absent(c("salinity"), 2, " PSU"), F.lit("."),
        _said(" The dissolved oxygen was ", c("oxygen"), 2, " ml/L."),
        _said(" The pH was ", c("ph"), 2, "."),
        _said(" The chlorophyll concentration was ", c("chlorophyll"), 3, " mg/m³.", chlorophyll),
        F.lit(" This measurement was part of a profile with "), c("n_levels"), F.lit(" depth levels."),
        F.lit(" The float was deployed on "), c("deployment_date").cast("string"), F.lit("."),
    )


def measurement_documents(context: DataFrame) -> DataFrame:
    return context.select(F.col("id").cast("string").alias("id"), measurement_text().alias("document"))


def measurement_metadata(context: DataFrame) -> DataFrame:
    """Nineteen fields per measurement; nulls vanish in the JSON form (``metadata_json``)."""
    bgc = F.col("oxygen").isNotNull() | F.col("ph").isNotNull() | F.col("chlorophyll").isNotNull()
    return context.select(
        F.col("id").alias("postgres_id"), "profile_id", F.col("float_id").cast("string").alias("float_id"), "wmo_id",
        "cycle_number", _day("time").alias("time"), _day("profile_date").alias("profile_date"),
        _day("profile_date").alias("date"), "depth", "lat", "lon", F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"), "n_levels", bgc.alias("has_bgc"), "temperature", "salinity", "oxygen",
        "chlorophyll",
    )


def metadata_json(metadata: DataFrame, key: str = "postgres_id") -> DataFrame:
    return metadata.select(F.col(key).cast("string").alias("id"), F.to_json(F.struct("*")).alias("metadata"))


def profile_documents(summary: DataFrame) -> DataFrame:
    """Text and metadata per profile, from the profile summary."""
    c = F.col

    def between(low: str, high: str, digits: int, unit: str, after: str) -> Column:
        text = F.concat(fixed_text(c(low), digits), F.lit(f"{unit} to "), fixed_text(c(high), digits), F.lit(after))
        return F.coalesce(F.when(c(low).isNotNull(), text), F.lit(ABSENT))

    document = F.concat(
        F.lit("ARGO float "), c("float_id"), F.lit(" (WMO "), c("wmo_id"), F.lit(") completed profile cycle "),
        c("cycle_number"), F.lit(" on "), _day("profile_date"), F.lit(" at location "), fixed_text(c("profile_lat"), 3),
        F.lit("°, "), fixed_text(c("profile_lon"), 3), F.lit("°. This profile contains "), c("n_levels"),
        F.lit(" measurements spanning depths from "), fixed_text(c("min_depth"), 0), F.lit("m to "),
        fixed_text(c("max_depth"), 0), F.lit("m. Temperature ranged from "),
        between("min_temp", "max_temp", 1, "°C", "°C"), F.lit(" and salinity from "),
        between("min_sal", "max_sal", 2, "", " PSU"), F.lit("."),
        _said(" Average oxygen was ", c("avg_oxygen"), 2, " ml/L."),
        _said(" Average pH was ", c("avg_ph"), 2, "."),
        _said(" Average chlorophyll was ", c("avg_chlorophyll"), 3, " mg/m³."),
    )
    return summary.select(
        F.concat(F.lit("profile_"), "profile_id").alias("id"), document.alias("document"), "profile_id",
        c("float_id").cast("string").alias("float_id"), "wmo_id", "cycle_number",
        _day("profile_date").alias("profile_date"), c("profile_lat").alias("lat"), c("profile_lon").alias("lon"),
        "n_levels", "min_depth", "max_depth", "min_temp", "max_temp", c("avg_oxygen").isNotNull().alias("has_bgc"),
    )


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Documents with stable ids in one distributed write."""
    documents.write.mode(mode).parquet(path)


def usable_vectors(documents: DataFrame, size: int | None = None, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector has no missing component and, if given, that many components."""
    whole = F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return documents.filter(whole if size is None else whole & (F.size(embedding) == size))


def rejected_vectors(documents: DataFrame, size: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Keys of the documents that a search with vectors of ``size`` components leaves out, and why."""
    reason = (F.when(F.col(embedding).isNull(), "no vector")
              .when(F.size(embedding) != size, "wrong length")
              .when(F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double"))), "missing component"))
    return documents.select(key, F.size(embedding).alias("components"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def squared_distance(column: Column, vector: list[float]) -> Column:
    """Squared Euclidean distance to a literal vector."""
    gaps = F.zip_with(column, F.array(*(F.lit(float(x)) for x in vector)),
                      lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x)


def vector_topk(documents: DataFrame, vector: list[float], k: int = TOP, key: str = "vec_id",
                embedding: str = "embedding") -> DataFrame:
    """The k nearest documents of one vector with their rank; every task keeps k rows.

    Documents without a complete vector of that length are left out; ``rejected_vectors`` lists them.
    """
    whole = usable_vectors(documents, len(vector), embedding)
    distance = squared_distance(F.col(embedding), vector)
    near = whole.withColumn("distance", distance).drop(embedding).orderBy("distance", key).limit(k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))  # k rows


class Nearest:
    """The k nearest of each query among vectors that come a piece at a time.

    Matrix products give all squared distances up to rounding, and what they rule out against a query's k-th nearest so
    far is left.  The others are measured as sums of squared gaps, so that the result does not depend on the products.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.norms = np.einsum("ij,ij->i", queries, queries)
        self.limits = np.full(len(queries), np.inf)  # distance of the k-th nearest
        self.found, self.waiting = [], 0  # (number of the query, distance, key) in pieces; rows since the last cut

    def add(self, keys: pa.Array, rows: np.ndarray, which: np.ndarray | None = None) -> None:
        """Compare ``rows`` with all queries, or with those numbered ``which``."""
        which = np.arange(len(self.queries)) if which is None else which
        norms = np.einsum("ij,ij->i", rows, rows)
        step = max(1, PAIRS // max(len(rows), 1))
        for start in range(0, len(which) if len(rows) else 0, step):
            mine = which[start:start + step]
            asked = self.queries[mine]
            with np.errstate(all="ignore"):  # what is not finite rules nothing out
                about = asked @ rows.T
                about *= -2
                about += norms
                unsure = 16 * (rows.shape[1] + 4) * np.finfo(float).eps * (self.norms[mine] + norms.max())
                limits = self.limits[mine] - self.norms[mine]
                first = np.flatnonzero(np.isinf(limits))
                if len(rows) > self.k and len(first):
                    limits[first] = np.partition(about[first], self.k - 1, axis=1)[:, self.k - 1]
                query, row = np.nonzero(~(about > (limits + unsure)[:, None]))
            for i in range(0, len(query), MEASURED):
                q, r = query[i:i + MEASURED], row[i:i + MEASURED]
                gap = rows[r] - asked[q]
                self.found.append((mine[q], np.einsum("ij,ij->i", gap, gap), keys.take(pa.array(r))))
            self.waiting += len(query)
            if self.waiting > max(MEASURED, self.k * len(self.queries)):
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The k nearest of each query so far, equal distances by key."""
        which, distance = (np.concatenate([f[i] for f in self.found]) for i in (0, 1))
        keys = pa.concat_arrays([f[2] for f in self.found])
        order = np.lexsort((pc.rank(keys, null_placement="at_start", tiebreaker="dense").to_numpy(), distance, which))
        place = np.arange(len(order)) - np.searchsorted(which[order], which[order])
        order, place = order[place < self.k], place[place < self.k]
        which, distance, keys = which[order], distance[order], keys.take(pa.array(order))
        self.limits[which[place == self.k - 1]] = distance[place == self.k - 1]
        self.found, self.waiting = [(which, distance, keys)], 0
        return which, distance, keys

    def rows(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.found:
            which, distance, keys = self.cut()
            for i in range(0, len(which), MEASURED):
                part = slice(i, i + MEASURED)
                yield pa.record_batch([names.take(pa.array(which[part])), keys[part], pa.array(distance[part])], ["query", "key", "distance"])


def _nearest_of_partition(shared, k: int):
    """A task's k nearest documents of every query, from column batches of (key, vector)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = {queries.shape[1]: (names, Nearest(queries, k)) for names, queries in shared.value}
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for size, (_, nearest) in by_size.items():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                nearest.add(part.column(0), np.asarray(part.column(1).flatten(), dtype="float64").reshape(part.num_rows, size))
        for names, nearest in by_size.values():
            yield from nearest.rows(names)

    return run


def vector_topk_batch(documents: DataFrame, queries: DataFrame, k: int = TOP, key: str = "vec_id",
                      embedding: str = "embedding", query_key: str = "query_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k nearest documents of every query vector.

    The queries are dealt by a hash of their key into blocks of about ``block_bytes``, so passes follow the bytes of the queries.  A
    block is broadcast to the tasks of one pass over the documents, which are dealt to as many tasks as run at once, however
    few files hold them: a task compares its column batches with all of it and hands on k rows per query, so the shuffle carries
    k rows per task and query.  A query meets the documents with a complete vector of its own
    length; a query whose vector is missing or incomplete has no neighbours.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((query_key, queries), (key, documents))}
    schema = f"query {kinds[query_key]}, key {kinds[key]}, distance double"
    query_type = to_arrow_type(queries.schema[query_key].dataType)
    wanted = usable_vectors(queries, None, "vector").select(query_key, "vector")
    context = documents.sparkSession.sparkContext
    whole = usable_vectors(documents, None, embedding).select(key, embedding).repartition(context.defaultParallelism, key)
    asked_bytes = wanted.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    blocks = -(-asked_bytes // block_bytes)
    near = documents.sparkSession.createDataFrame([], schema)
    for number in range(blocks):
        asked = wanted.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == number).collect()  # about ``block_bytes``
        if asked:
            sizes = sorted({len(q["vector"]) for q in asked})
            alike = [[q for q in asked if len(q["vector"]) == size] for size in sizes]
            shared = context.broadcast([(pa.array([q[query_key] for q in part], query_type), np.array([q["vector"] for q in part], dtype="float64"))
                                        for part in alike])
            near = near.union(whole.mapInArrow(_nearest_of_partition(shared, k), schema))
    spot = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
    best = near.withColumn("rank", spot).filter(F.col("rank") <= k)
    return best.withColumnsRenamed({"query": query_key, "key": key})


def hit_statistics(hits: DataFrame) -> DataFrame:
    """Average, least, greatest and number of temperatures and salinities among the hits."""
    return hits.agg(
        n_rows().alias("hits"),
        *(f(c).alias(f"{n}_{c}") for c in ("temperature", "salinity")
          for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max), ("count", F.count))),
    )


def statistics_text(statistics: DataFrame) -> DataFrame:
    """The statistics as lines of text, one per quantity that has readings."""
    def line(title: str, c: str, unit: str) -> Column:
        text = F.concat(
            F.lit(f"{title} — avg: "), fixed_text(F.col(f"avg_{c}"), 2), F.lit(f"{unit}, min: "),
            fixed_text(F.col(f"min_{c}"), 2), F.lit(f"{unit}, max: "), fixed_text(F.col(f"max_{c}"), 2),
            F.lit(f"{unit} ("), F.col(f"count_{c}"), F.lit(" readings)"))
        return F.when(F.col(f"count_{c}") > 0, text)

    lines = F.concat_ws("\n", line("Temperature", "temperature", "°C"), line("Salinity", "salinity", " PSU"))
    return statistics.select(
        F.coalesce(F.nullif(lines, F.lit("")), F.lit("No numeric data in retrieved results.")).alias("statistics"))


def context_lines(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """One line per hit, leaving out what is absent: ``[1] Float=7 | Date=… | Lat=…``."""
    def part(label: str, c: str, digits: int, unit: str = "") -> Column:
        value = F.col(c)
        return F.when(value.isNotNull(), F.concat(F.lit(f" | {label}="), fixed_text(value, digits), F.lit(unit)))

    def named(label: str, c: str) -> Column:
        return F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""),
                      F.concat(F.lit(label), F.col(c).cast("string")))

    parts = [
        named(" Float=", "float_id"), named(" | Date=", "date"), part("Lat", "latitude", 2),
        part("Lon", "longitude", 2), part("Depth", "depth", 0, "m"), part("Temp", "temperature", 2, "°C"),
        part("Sal", "salinity", 2, " PSU"), part("O2", "oxygen", 2, " ml/L"),
    ]
    line = F.concat(F.lit("["), F.col(rank), F.lit("]"), *(F.coalesce(p, F.lit("")) for p in parts))
    return hits.select(rank, line.alias("line"))
