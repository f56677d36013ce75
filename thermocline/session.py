"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}

# The JVM does not compile methods of more than 8000 bytecodes.  A fused stage above that runs interpreted, several
# times slower than its operators one by one, so such stages are better not fused (a four-fold gain on text columns).
HUGE_METHOD, ENGINES_OWN = "spark.sql.codegen.hugeMethodLimit", "65535"
SETTINGS[HUGE_METHOD] = "8000"
# Splitting a hot join key is worth another shuffle when an aggregate follows on the same key.
SETTINGS["spark.sql.adaptive.forceOptimizeSkewedJoin"] = "true"

_STAGED: dict[str, list[str]] = {}  # folders to remove, by application


def build_session(app: str = "thermocline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; the cluster decides everything else."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def compiled(spark: SparkSession) -> None:
    """Give a session that was built elsewhere the limit above; a limit that someone has set stays."""
    if spark.conf.get(HUGE_METHOD, ENGINES_OWN) == ENGINES_OWN:
        spark.conf.set(HUGE_METHOD, SETTINGS[HUGE_METHOD])


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of this machine, which ``release`` removes; a cluster
    without it is refused.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="thermocline-")
        _STAGED.setdefault(context.applicationId, []).append(folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Needed where two passes must see the very same rows in the very same partitions; the written copy
    survives the loss of executors, which a cached one does not.  With the library's settings Spark removes it when
    nothing refers to it any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder; ``release`` removes what is written there."""
    path = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    For operators that pass over a joined view several times: the join runs once, later passes read only the
    columns they need, and the optimizer knows the size of what it reads.  ``release`` removes the copy.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove what ``staged`` wrote in this application; results that still read it must have been consumed.

    Called at the end of the program; a long-lived session calls it between jobs.
    """
    jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(settings).delete(where, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _STAGED:
        release(spark)
