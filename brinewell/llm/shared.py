"""Helpers shared by the training-data operators: scratch tables in the folder all executors see, and folds."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.sources.scratch import scratch_path, shared_folder

__all__ = ["FOLDS", "HELD_OUT", "Scratch", "at_most", "bound_batches", "fold", "read", "release_memory", "row_key", "scratch_path", "shared_folder", "stash", "texts"]

#: Rows whose crc32(doc_id as text) has this remainder by FOLDS are held out of training.
HELD_OUT, FOLDS = 0, 5
SEED_LOW = 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text modulo FOLDS; a null id counts as fold 0, so it never trains anything."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % FOLDS, F.lit(0))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: computed once, and safe from lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stashed tables that go when the block ends; whatever outlives it must be stashed outside."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop_all_but(0)

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, newest: int) -> None:
        gone, self.paths = self.paths[: len(self.paths) - newest], self.paths[len(self.paths) - newest :]
        for path in gone:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def row_key(text: Column | str = "text") -> list[Column]:
    """128 bits of a text, as two longs: with doc_id, null or repeated as it may be, they name a row; only rows equal in both share a name."""
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("key_hi"), F.xxhash64(F.lit(SEED_LOW), text).alias("key_lo")]


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the bytes of the batches that Python workers get, unless the session names its own bound: rows may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def release_memory() -> None:
    """Hands memory that a Python worker no longer needs back to the system: idle workers stay beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string, for a Python worker."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
