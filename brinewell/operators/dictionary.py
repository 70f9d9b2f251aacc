"""Key dictionary: ids from 1 by first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.functions.ordering import row_numbers


def build(ops: DataFrame) -> DataFrame:
    """key, key_id."""
    return row_numbers(ops.groupBy("key").agg(F.min("seq").alias("seq")), "seq", "key_id").select("key", "key_id")


def encode(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows with key_id for key; 0 where the dictionary has none."""
    return rows.join(dictionary, "key", "left").withColumn("key_id", F.coalesce("key_id", F.lit(0)).cast("bigint")).drop("key")


def decode(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows with key for key_id; empty where the dictionary has none."""
    return rows.join(dictionary, "key_id", "left").withColumn("key", F.coalesce("key", F.lit(""))).drop("key_id")
