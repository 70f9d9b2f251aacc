"""The stored log and its runs as Parquet: segments and runs are partitions, sorted within."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions import entry_crc

# The components of a run, one file each or merged in one.
COMPONENTS = ("data", "index", "summary", "metadata", "bloomfilter", "blocksize", "merge", "compression")
MERGED_COMPONENTS = ("data", "blocksize", "merge", "compression")


def append_log(ops: DataFrame, path: str, segment_ops: int) -> None:
    """Appends operations, with their checksum, to segments of so many sequence numbers."""
    rows = ops.withColumns({"crc": entry_crc(F.col("key"), F.col("value")), "segment": F.floor(F.col("seq") / segment_ops)})
    rows.repartition("segment").sortWithinPartitions("segment", "seq").write.mode("append").partitionBy("segment").parquet(path)


def put(spark: SparkSession, path: str, seq: int, key: str, value: str, segment_ops: int) -> None:
    append_log(spark.createDataFrame([(seq, key, value, False)], "seq bigint, key string, value string, tombstone boolean"), path, segment_ops)


def delete(spark: SparkSession, path: str, seq: int, key: str, segment_ops: int) -> None:
    append_log(spark.createDataFrame([(seq, key, "", True)], "seq bigint, key string, value string, tombstone boolean"), path, segment_ops)


def replay(spark: SparkSession, path: str, segment: int | None = None) -> DataFrame:
    """Operations of the log, or of one segment (only its files are read)."""
    log = spark.read.parquet(path)
    return log if segment is None else log.where(F.col("segment") == segment)


def split_corrupt(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose checksum holds, and those to quarantine."""
    actual = entry_crc(F.col("key"), F.col("value"))
    return log.where(F.col("crc") == actual), log.where(~F.col("crc").eqNullSafe(actual))


def reassemble(fragments: DataFrame) -> DataFrame:
    """entry_id and payload of entries stored in pieces: fragments(entry_id, frag_no, bytes)."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("frag_no", "bytes"))), lambda x: F.hex(x["bytes"]))
    return fragments.groupBy("entry_id").agg(F.unhex(F.array_join(pieces, "")).alias("payload"))


def delete_segments(spark: SparkSession, path: str, watermark: int) -> list[int]:
    """Deletes the segments up to the watermark; returns their numbers."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, gone = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for entry in fs.listStatus(hadoop):
        name = entry.getPath().getName()
        if name.startswith("segment=") and int(name.split("=")[1]) <= watermark:
            fs.delete(entry.getPath(), True)
            gone.append(int(name.split("=")[1]))
    return sorted(gone)


def flush_run(rows: DataFrame, path: str, gen: int, single_file: bool = False) -> None:
    """Writes a run, newest version of each key in key order, with a Parquet Bloom filter on the key."""
    newest = rows.groupBy("key").agg(F.max_by(F.struct("seq", "value", "tombstone"), "seq").alias("x")).select("key", "x.*").withColumn("gen", F.lit(gen).cast("bigint"))
    dealt = newest.coalesce(1) if single_file else newest.repartitionByRange("key")
    dealt.sortWithinPartitions("key").write.mode("append").option("parquet.bloom.filter.enabled#key", "true").partitionBy("gen").parquet(path)


def runs(spark: SparkSession, path: str, capacity: int | None = None) -> DataFrame:
    """All runs, or the newest so many."""
    found = spark.read.parquet(path)
    if capacity is None:
        return found
    newest = found.select(F.max("gen")).first()[0]
    return found.where(F.col("gen") > (newest if newest is not None else 0) - capacity)


def next_gen(spark: SparkSession, path: str) -> int:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return 0
    gens = [int(e.getPath().getName().split("=")[1]) for e in fs.listStatus(hadoop) if e.getPath().getName().startswith("gen=")]
    return max(gens, default=-1) + 1


def save(df: DataFrame, path: str) -> DataFrame:
    """Writes a derived table (index, summary, sketch, dictionary, checksums) and reads it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def describe_run(spark: SparkSession, path: str, gen: int, block_size: int, merged: bool, compressed: bool) -> None:
    """Writes the properties of a run, one row of JSON, beside those of the others."""
    row = (block_size, merged, compressed, list(MERGED_COMPONENTS if merged else COMPONENTS))
    spark.createDataFrame([row], "block_size bigint, merged boolean, compressed boolean, components array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/gen={gen}")


def run_properties(spark: SparkSession, path: str, gen: int | None = None) -> DataFrame:
    """Properties of all runs, or of one by its number (only its file is read)."""
    found = spark.read.schema("block_size bigint, merged boolean, compressed boolean, components array<string>, gen bigint").json(path)
    return found if gen is None else found.where(F.col("gen") == gen)
