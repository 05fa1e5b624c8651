"""What sources and operators keep between jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Partitions of a scan that hold less than this on average are read several at a time.
SMALL = 4 << 20
#: Tasks a core at least, whatever is joined.
WAVES = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session without it, as in tests, gets one of its own; on
    a cluster that would be another folder on each machine, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """A result written and read back, so that lineage ends and a lost executor costs nothing.

    Where there are many more shuffle partitions than cores, up to four go to one file: on a file system that sets
    permissions by a process of its own, files cost more than rows. What was written is left for whoever owns the
    folder to delete; plans that read it may run again at any time.
    """
    spark = df.sparkSession
    path = f"{path or _new(spark)}/{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = max(WAVES * spark.sparkContext.defaultParallelism, parts // 4)
    (df.coalesce(few) if parts >= 2 * few else df).write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _new(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/folioforge-{uuid.uuid4().hex}"


@contextmanager
def passing(df: DataFrame, name: str, **options: str) -> Iterator[DataFrame]:
    """What ``settled`` gives, for as long as the block lasts; then its files go."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(_new(spark))
    try:
        yield settled(df, name, place.toString(), **options)
    finally:
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is planned inside; then it is what it was."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def in_tasks(df: DataFrame) -> DataFrame:
    """A table as it is read, with its partitions joined if they are many and small; no shuffle, and nothing at all
    where partitions have the size that Spark gives them."""
    parts = df.rdd.getNumPartitions()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = max(WAVES * df.sparkSession.sparkContext.defaultParallelism, size // SMALL)
    return df.coalesce(few) if parts >= 2 * few else df
