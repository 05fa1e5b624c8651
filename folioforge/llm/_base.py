"""Shared pieces of the training-data operators.

Everything an operator has to keep between two jobs goes to the folder that the
session names in ``spark.checkpoint.dir`` (shared by driver and executors).
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.shared import in_tasks

#: A word: a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch: texts of a few megabytes at once are enough for any operator here, and each worker holds
#: several copies of a batch.
BATCH = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return in_tasks(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: lineage ends here and an executor may go."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return shared.settled(df, name)


def dealt(df: DataFrame, name: str, key: str, least: int) -> DataFrame:
    """Like ``settled``, in buckets by a column (at least ``least`` and as many as Spark's shuffle partitions, as far as
    Spark allows): joins and groups by that column read them where they lie and shuffle the other side only. The
    table's name is gone at once, its files stay."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    own = f"folioforge_{uuid.uuid4().hex}"
    path = f"{shared.shared_dir(spark)}/{own.replace('_', '-')}/{name}"
    buckets = min(max(least, int(spark.conf.get("spark.sql.shuffle.partitions"))), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(own)
    out = spark.table(own)
    spark.sql(f"DROP TABLE {own}")
    return out


def one_in(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def row_hashes(*cols: str | Column) -> tuple[Column, Column]:
    """Two independent hashes of a row, 128 bits together; a null differs from any value, in any column."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    nulls = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in cols))
    return F.xxhash64(F.lit(1), nulls, *cols), F.xxhash64(F.lit(2), nulls, *cols)


def n_words(text: str | Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text if isinstance(text, Column) else F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def by_batch(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None]):
    """A mapInArrow function from one that takes a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        give_back()

    return run


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every platform
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
