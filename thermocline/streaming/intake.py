"""New profile files into the three tables as they arrive.

Every micro-batch writes its own part of each table, named by its number, and nothing else: a replayed batch replaces
what it wrote before, and what is written follows the batch, not the tables.  Profile ids are made of the batch's number and
the place in it.  Floats are versions: readers take the newest row of each, and ``compact`` folds old versions into a base.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.profiles import profile_tables

ARRAYS = ("pres", "temp", "psal", "doxy", "ph", "chla", "nitrate")
PROFILE_FILE = T.StructType(
    [T.StructField("profile_seq", T.LongType()), T.StructField("platform", T.StringType()),
     T.StructField("cycle", T.IntegerType()), T.StructField("juld", T.TimestampNTZType()),
     T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]
    + [T.StructField(name, T.ArrayType(T.DoubleType())) for name in ARRAYS]
)
IDS_OF_A_BATCH = 1 << 40


def read_profile_files(spark: SparkSession, folder: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """A stream of profiles with the file each came from."""
    return (
        spark.readStream.format(fmt).schema(PROFILE_FILE).option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true").load(folder)
        .select("*", F.col("_metadata.file_path").alias("file_seq"))
    )


def run(profiles: DataFrame, folder: str, checkpoint: str, as_of: dt.date, **trigger) -> StreamingQuery:
    def step(batch: DataFrame, number: int) -> None:
        for name, df in profile_tables(batch, as_of, number * IDS_OF_A_BATCH + 1).items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    writer = profiles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _base(spark: SparkSession, folder: str) -> tuple[int, DataFrame | None]:
    """The number of the newest complete base and its floats; -1 and none without one."""
    if not _exists(spark, f"{folder}/floats_base"):
        return -1, None
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/floats_base")
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    numbers = [int(s.getPath().getName().removeprefix("upto=")) for s in listed]
    whole = [n for n in numbers if _exists(spark, f"{folder}/floats_base/upto={n}/_SUCCESS")]
    if not whole:
        return -1, None
    return max(whole), spark.read.parquet(f"{folder}/floats_base/upto={max(whole)}")


def current_floats(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The newest row of every float: the base and the batches after it, the later batch wins.  ``upto`` leaves out later batches."""
    number, base = _base(spark, folder)
    versions = spark.read.parquet(f"{folder}/floats").filter(F.col("batch") > number)
    if upto is not None:
        versions = versions.filter(F.col("batch") <= upto)
    if base is not None:
        versions = versions.unionByName(base.withColumn("batch", F.lit(number)))
    newest = versions.groupBy("float_id").agg(F.max("batch").alias("batch"))
    return versions.join(newest, ["float_id", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, folder: str, upto: int) -> None:
    """Write the floats after batch ``upto`` as the new base; readers use it once it is complete.

    Older bases and the batches it holds stay for readers that began before; they may be deleted afterwards.
    """
    current_floats(spark, folder, upto).write.mode("overwrite").parquet(f"{folder}/floats_base/upto={upto}")
