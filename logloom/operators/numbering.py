"""Dense numbers over a large relation, and the cut of long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tells Spark to remove the shuffle files of a query when it ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def dense_number(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name`` = 1, 2, … in the order of the unique whole-number column ``key``.

    Rows are sorted by ranges of the key that Spark samples, so a range holds about the same
    number of rows however the keys are spread, and stored with their position. The offsets are a
    running sum with one row per range.
    """
    ranged = df.repartitionByRange(key).sortWithinPartitions(key)
    stored = cut_lineage(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranges")
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    return stored.join(offsets, "_part").withColumn(name, (F.col("_at") + F.col("_offset")).cast("bigint")).drop("_part", "_at", "_offset")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        # One machine, one folder: only for a session without a cluster and without the setting.
        context.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


# Names and paths of the tables stored in the open scope of :func:`tables_go_after`; each thread has its own.
_SCOPE: ContextVar[list[tuple[str, str]] | None] = ContextVar("stored", default=None)


@contextmanager
def tables_go_after(spark: SparkSession, kept: tuple[str, ...]) -> Iterator[None]:
    """Tables stored inside are removed at the end, but for those named in ``kept``, which must not read the others when used."""
    stored: list[tuple[str, str]] = []
    outer = _SCOPE.set(stored)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name, path in stored:
            if name not in kept:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)


def cut_lineage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table outlives lost executors, and its true size guides the choice
    of later joins. Nothing reads the shuffles that made it again, so their files go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/logloom/{name}-{uuid.uuid4().hex}"
    stored = _SCOPE.get()
    if stored is not None:
        stored.append((name, path))
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
