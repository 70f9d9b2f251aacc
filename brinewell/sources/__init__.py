"""Operation logs: their schema, views of tables as logs, validation, and the stored log and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions import trim_space
from brinewell.functions.ordering import row_numbers

LOG_SCHEMA = "seq bigint, ts timestamp_ntz, key string, value string, tombstone boolean"
#: Status codes of commands.
OK, EMPTY_KEY, EMPTY_VALUE, TOO_LARGE, UNKNOWN, ABSENT, LIMITED = range(7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, a file or a folder, as a stream of its files. A pattern is taken as it is; a plain path would have to be a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def as_ops(events: DataFrame) -> DataFrame:
    """events, batch or stream, as an operation log: a key for each user, error events are deletes."""
    dead = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("seq"), "ts", F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.when(dead, "").otherwise(F.col("props")).alias("value"), dead.alias("tombstone"),
    )


def as_requests(events: DataFrame) -> DataFrame:
    """Requests that cost a token: everything but puts (purchases)."""
    return events.where("event_type <> 'purchase'").select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit(1).alias("n")
    )


def kv_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ops(table(spark, sf_dir, "events"))


def kv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a key space that is only inserted into; without seq."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("key"), F.col("o_orderstatus").alias("value"), F.lit(False).alias("tombstone"))


def kv_orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kv_orders with seq by order key."""
    return row_numbers(kv_orders(spark, sf_dir), "key", "seq")


def kv_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("key"), F.col("page_id").cast("string").alias("value"), F.lit(False).alias("tombstone"))


def put_status(key: Column, value: Column, limit: int) -> Column:
    """Status of a put, by its first fault."""
    size = F.octet_length(key) + F.octet_length(value)
    return F.when(F.length(trim_space(F.coalesce(key, F.lit("")))) == 0, EMPTY_KEY).when(F.length(F.coalesce(value, F.lit(""))) == 0, EMPTY_VALUE).when(size > limit, TOO_LARGE).otherwise(OK)


def validate(ops: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with the key trimmed, and rejected rows with their code."""
    marked = ops.withColumn("code", put_status(F.col("key"), F.col("value"), limit))
    return marked.where(f"code = {OK}").drop("code").withColumn("key", trim_space(F.col("key"))), marked.where(f"code <> {OK}")
