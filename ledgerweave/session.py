"""Session settings and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles methods above 8,000 bytes. A plan that builds or parses transactions in one such method is
    # interpreted; above this limit Spark runs its operators one by one, each in methods that are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows that a Python worker gets at once. With texts of some kilobytes the default of 10,000 is tens of megabytes, held
    # by the JVM, by Arrow and as Python strings, for each task.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go with the query that wrote them
# Small test tables would all be broadcast; a low threshold keeps the shuffle plans of large ones.
LOCAL_SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "256k", "spark.ui.showConsoleProgress": "false"}


def local_session(cores: str = "8", partitions: int = 8, app: str = "ledgerweave") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**SETTINGS, **LOCAL_SETTINGS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """All instants are UTC; make the session agree before a query is built. Generated methods and batches are limited too."""
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        if spark.conf.get(key) != SETTINGS[key]:
            spark.conf.set(key, SETTINGS[key])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        named = tempfile.mkdtemp(prefix="ledgerweave-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder so later stages all see the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame) -> DataFrame:
    """As ``settled``, in compressed columns, and the shuffle files of the query are deleted behind it.

    A checkpoint holds rows as they are in memory, which is several times as much, and readers cannot skip columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_END, "false")
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_END, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def spool(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """As ``settled``, for wide frames that are done with at the end of the block: compressed columns, deleted behind it.

    A checkpoint holds rows as they are in memory. Columns of nested text take a small part of that, and readers skip those
    they do not name. Inside the block the shuffle files of a query are deleted when it ends, so a frame that is read more than
    once has to be held; else they lie until the driver collects garbage.
    """
    before = spark.conf.get(SHUFFLES_END, "false")
    spark.conf.set(SHUFFLES_END, "true")
    folder = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        spark.conf.set(SHUFFLES_END, before)
        remove(spark, folder)
