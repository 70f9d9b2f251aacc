"""Structured Streaming over the operation log: flushing runs and limiting requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brinewell.operators.control import TokenBucket
from brinewell.sources import LOG_SCHEMA
from brinewell.sources.store import flush_run


def read_log(spark: SparkSession, path: str, files_per_batch: int = 1, schema: str = LOG_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def flush_stream(ops: DataFrame, runs: str, checkpoint: str):
    """Every micro-batch becomes a run, numbered by the batch; a batch that is run again replaces its own run only."""

    def flush(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{runs}/gen={number}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        flush_run(batch, runs, number)

    return ops.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(ops: DataFrame, width: str, late: str) -> DataFrame:
    """Operations and deletes in windows of event time; rows later than the watermark are dropped."""
    return ops.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width).alias("w")).agg(F.count("*").alias("ops"), F.sum(F.col("tombstone").cast("bigint")).alias("deletes")).select("w.start", "w.end", "ops", "deletes")


def write_updates(rows: DataFrame, path: str, checkpoint: str):
    """Every micro-batch writes the rows that it changed to a folder of its own; a batch that is run again replaces its own only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The last version of each key in folders written by write_updates."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    names = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("x")).select(key, "x.*")


def limit_stream(requests: DataFrame, capacity: int, interval_us: int) -> DataFrame:
    """key, seq, allowed: a token bucket for each key, kept between micro-batches; within one, requests go by time and seq."""

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["at", "seq"], kind="stable")
        bucket = TokenBucket(capacity, interval_us, int(rows["at"].iloc[0]))
        if state.exists:
            bucket.tokens, bucket.last = state.get
        allowed = [bucket.allow(int(at), int(n)) for at, n in zip(rows["at"], rows["n"], strict=True)]
        state.update((bucket.tokens, bucket.last))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "allowed": allowed})

    return requests.groupBy("key").applyInPandasWithState(decide, "key string, seq long, allowed boolean", "tokens long, last long", "append", GroupStateTimeout.NoTimeout)
