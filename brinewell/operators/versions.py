"""Versions of keys: snapshots, lookups, history, deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewell.sources import ABSENT, OK


def newest(ops: DataFrame) -> DataFrame:
    """The last operation of every key; deletes included. Partial aggregation keeps one row a key and task before the shuffle."""
    return ops.groupBy("key").agg(F.max_by(F.struct("seq", "value", "tombstone"), "seq").alias("x")).select("key", "x.seq", "x.value", "x.tombstone")


def snapshot(ops: DataFrame) -> DataFrame:
    """Live keys: deletes mask what came before them, so they go after resolution."""
    return newest(ops).where("not tombstone").select("key", "value", "seq")


def snapshot_as_of(ops: DataFrame, seq: int) -> DataFrame:
    return snapshot(ops.where(F.col("seq") <= seq))


def get(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """key, value, status for each wanted key, in the log or not. Only their operations are shuffled."""
    wanted = ops.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
    live = newest(ops.where(F.col("key").isin(list(keys)))).where("not tombstone and length(value) > 0")
    return wanted.join(live, "key", "left").select("key", "value", F.when(F.col("seq").isNull(), ABSENT).otherwise(OK).alias("status"))


def history(ops: DataFrame) -> DataFrame:
    """All versions with their number and neighbours."""
    w = Window.partitionBy("key").orderBy("seq")
    return ops.select("key", "seq", "value", "tombstone", F.row_number().over(w).cast("bigint").alias("version"), F.lag("seq").over(w).alias("prev_seq"), F.lead("seq").over(w).alias("next_seq"))


def deleted_keys(ops: DataFrame) -> DataFrame:
    return newest(ops).where("tombstone").select("key", "seq")


def deletes_of_missing(ops: DataFrame) -> DataFrame:
    """Deletes of keys that had no put before."""
    first_put = ops.groupBy("key").agg(F.min(F.when(~F.col("tombstone"), F.col("seq"))).alias("first_put"))
    return ops.where("tombstone").join(first_put, "key").where("first_put is null or first_put > seq").select("seq", "key")
