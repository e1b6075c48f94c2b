"""What the operators share: loading, shared intermediate tables, kernel plumbing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that goes to a Python worker; rows are never cut, so a longer text is a batch of its own.
BATCH_BYTES = "2m"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sitequarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession):
    """Kernels run meanwhile get batches of BATCH_BYTES.  By rows alone a batch is a whole split, held in the JVM's direct memory and in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    # Spark drops the shuffle files of a finished job when the driver's references to it are collected; waiting for that fills disks.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that `stored` has written and that nothing reads any more."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id, mod: int, rest: int):
    """crc32 of the id as text, modulo mod, is rest; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod) == rest, F.lit(False))


def text_key(text) -> Column:
    """SHA-256 of a text: what rows are told apart by where doc_id may be null or repeated; null for a null text."""
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def as_batch(columns: list, types: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def drained(batches):
    """The batches, with Arrow's free memory given back after each: workers live on, and executors are small."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows: the check before a broadcast.  It counts no further than needed."""
    return df.limit(rows + 1).count() <= rows


def light_enough(df: DataFrame, size: Column, most: int) -> bool:
    """Whether the sizes, in bytes, of the rows of df add up to `most` at most: the check before a broadcast of rows of any width."""
    return (df.agg(F.sum(size.cast("long"))).head()[0] or 0) <= most
