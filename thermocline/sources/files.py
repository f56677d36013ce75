"""Tables, file listings and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import month_of, nan_to_null, safe_float, safe_timestamp

SEED = 42
NUMERIC = ("lat", "lon", "latitude", "longitude", "depth", "temperature", "salinity", "oxygen", "ph", "chlorophyll",
           "pressure")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; with a schema no file has to be opened to plan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_database(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int,
                  **options: str) -> DataFrame:
    """A database table read by many tasks at once, split by ranges of a numeric column."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        .option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper)
        .option("numPartitions", partitions).load()
    )


def schema_listing(tables: dict[str, DataFrame]) -> DataFrame:
    """Table, column, type, nullability and position of every column; no data is read."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, f.name, f.dataType.simpleString(), f.nullable, i)
        for name, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, data_type string, is_nullable boolean, ordinal int"
    )


def profile_index(spark: SparkSession, path: str) -> DataFrame:
    """Paths of profile files from index files: comments, blank lines, the header and other paths are left out."""
    lines = spark.read.option("comment", "#").option("header", False).csv(path, schema="path string")
    found = lines.select(F.trim("path").alias("path")).filter(F.col("path").endswith(".nc"))
    if found.isEmpty():
        raise ValueError(f"no profile path in {path}")
    return found


def snapshot_listing(spark: SparkSession, folder: str, pattern: str = "*_Sprof.nc") -> DataFrame:
    """Files below a folder by name pattern, in path order; only names and sizes are read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(folder).select("path", "length", "modificationTime")
    )
    if files.isEmpty():
        raise ValueError(f"no file like {pattern} below {folder}")
    return files.orderBy("path")


def seeded_files(files: DataFrame, limit: int, seed: int = SEED) -> DataFrame:
    """A repeatable choice of ``limit`` files; 0 means all."""
    if not limit:
        return files
    return files.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(limit)


def normalise_columns(df: DataFrame) -> DataFrame:
    """Alias columns latitude, longitude and date where missing; numbers and dates read leniently."""
    have = df.columns
    added = {}
    for short, full in (("lat", "latitude"), ("lon", "longitude")):
        if full not in have and short in have:
            added[full] = F.col(short)
    if "date" not in have:
        source = next((c for c in ("profile_date", "time") if c in have), None)
        if source:
            added["date"] = F.col(source)
    named = df.withColumns(added) if added else df
    types = dict(named.dtypes)
    fixed = {}
    for c in NUMERIC:
        if types.get(c) == "string":
            fixed[c] = safe_float(F.col(c))
        elif types.get(c) in ("double", "float"):
            fixed[c] = nan_to_null(F.col(c))
    for c in ("date", "time", "profile_date", "month"):
        if types.get(c) == "string":
            fixed[c] = safe_timestamp(F.col(c))
    return named.withColumns(fixed) if fixed else named


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by_month: str | None = None,
                sort: tuple[str, ...] = ()) -> None:
    """A table laid out by month, sorted inside its files so that readers can skip row groups.

    The engine sizes the files: rows are rebalanced by month, small months share a task, and a month that holds most rows
    is split among many.  Mode ``replace`` overwrites the months that ``df`` has and leaves the others, so a load can be repeated.
    """
    if by_month is None:
        rows = df.sortWithinPartitions(*sort) if sort else df
        rows.write.mode("overwrite" if mode == "replace" else mode).parquet(path)
        return
    rows = df.withColumn("month", F.date_format(month_of(F.col(by_month)), "yyyy-MM")).hint("rebalance", "month")
    writer = rows.sortWithinPartitions("month", *sort).write.partitionBy("month")
    if mode == "replace":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if mode == "replace" else mode).parquet(path)


def write_database(df: DataFrame, url: str, table: str, batch: int = 5000, mode: str = "append", **options: str) -> None:
    """Rows into a database table in batches, one connection per task."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=str(batch), **options).save()


def rebuild_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """All tables anew."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", by_month="time" if "time" in df.columns else None)


def append_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", "append", by_month="time" if "time" in df.columns else None)
