"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that lower-case A-Z and leave every other byte as it is.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


_held: tuple = ()


def hold(*caches: dict) -> None:
    """Keeps these caches in a Python worker; those of the operator that it ran before are emptied, as workers outlive operators."""
    global _held
    for old in _held:
        if not any(old is c for c in caches):
            old.clear()
    _held = caches
    trim()


def trim() -> None:
    """Gives what a Python worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if give_back is not None:
        give_back(0)


def rows_of(batch: pa.RecordBatch, most: int = 512) -> Iterator[tuple]:
    """The rows of a batch, so many at a time as Python objects."""
    for at in range(0, batch.num_rows, most):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, most).columns), strict=True)


@contextmanager
def small_batches(spark: SparkSession, most: int = 1000) -> Iterator[None]:
    """Tables written meanwhile pass to Python in batches of so many rows at most, which both sides hold whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share; own warehouse folder where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir()
    if isinstance(named, str) and named:
        return named.rstrip("/")
    found = None if isinstance(named, str) or named is None else named
    if found is not None and found.isDefined():
        return found.get().rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a fresh table in the shared folder and reads it back: lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(parts, name: str, key: str, buckets: int) -> DataFrame:
    """Appends frames to one table bucketed and sorted by a key, so that grouping by it later moves nothing.

    parts: callables, run one after the other; the shuffle files of each are let go before the next.
    """
    spark = None
    for part in parts:
        df = part()
        if spark is None:
            spark = df.sparkSession
            table = f"{name}_{uuid.uuid4().hex}"
            path = f"{scratch_root(spark)}/{table}"
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("append").option("path", path).saveAsTable(table)
        del df
        release(spark)
    out = spark.table(table)
    out.own_table = table
    return out


def release(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of finished jobs that nothing refers to any more."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # events of the last job refer to its plan
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(df: DataFrame) -> None:
    """Deletes a table of ours that nothing reads any more."""
    files = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    if (table := getattr(df, "own_table", None)) is not None:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    for file in files:
        if file.startswith(("file:", "hdfs:", "s3", "gs:", "abfs", "/")):
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Size of a table of ours in its files."""
    spark = df.sparkSession
    total = 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def sent_if_small(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """A stored table, to be broadcast where its files are known to hold at most so many bytes; beyond, joins with it shuffle."""
    return F.broadcast(df) if stored_bytes(df) <= most else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(c: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def map_columns(df: DataFrame, columns: list, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over only the columns that fn reads."""
    return df.select(*columns).mapInArrow(fn, schema)
