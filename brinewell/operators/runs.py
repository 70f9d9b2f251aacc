"""Runs of a log-structured store: generations, merging, indexes, pruning, compaction, encoded sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewell.functions import entry_crc, varint_length
from brinewell.operators.sketches import bloom_bits, bloom_probe


def generations(inserts: DataFrame, entries: int) -> DataFrame:
    """Generation of each insert of a new key: so many keys each. inserts: key and seq = 1, 2, ..."""
    return inserts.withColumn("gen", F.floor((F.col("seq") - 1) / entries))


def greedy_generations(ops: DataFrame, entries: int, shards: int) -> DataFrame:
    """Generation of every operation when a memtable is full at so many distinct keys, for each shard of the keys.

    Filling is sequential within a shard, so rows stream through in order of seq with one memtable of keys as state.
    """

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, gen, keys = None, 0, set()
        for pdf in parts:
            out = []
            for s, key in zip(pdf["shard"], pdf["key"], strict=True):
                if s != shard:
                    shard, gen, keys = s, 0, set()
                if len(keys) >= entries:  # full: the next table, whatever the key
                    gen, keys = gen + 1, set()
                keys.add(key)
                out.append(gen)
            yield pdf[["shard", "seq", "key"]].assign(gen=out)

    dealt = ops.select(F.pmod(F.crc32(F.encode("key", "UTF-8")), F.lit(shards)).cast("bigint").alias("shard"), "seq", "key")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "seq").mapInPandas(fill, "shard long, seq long, key string, gen long")


def with_gen(ops: DataFrame, run_ops: int) -> DataFrame:
    """Generation by sequence number: a flush after so many operations."""
    return ops.withColumn("gen", F.floor(F.col("seq") / run_ops))


def flushed(ops: DataFrame) -> DataFrame:
    """The runs: the newest version of each key in each generation."""
    return ops.groupBy("gen", "key").agg(F.max_by(F.struct("seq", "value", "tombstone"), "seq").alias("x")).select("gen", "key", "x.seq", "x.value", "x.tombstone")


def run_bounds(runs: DataFrame) -> DataFrame:
    return runs.groupBy("gen").agg(F.count("*").alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def merge(runs: DataFrame, drop_deletes: bool = True) -> DataFrame:
    """Rows of all runs, the newest run winning."""
    best = runs.groupBy("key").agg(F.max_by(F.struct("gen", "seq", "value", "tombstone"), "gen").alias("x")).select("key", "x.*")
    return best.where("not tombstone") if drop_deletes else best


def compact(runs: DataFrame, low: int, high: int) -> DataFrame:
    """Runs low to high as one, numbered high; deletes go only if no older run is left that they could mask."""
    oldest = runs.agg(F.min("gen").alias("oldest"))
    chosen = merge(runs.where(F.col("gen").between(low, high)), drop_deletes=False).join(F.broadcast(oldest)).where((F.lit(low) > F.col("oldest")) | ~F.col("tombstone"))
    return chosen.select(F.lit(high).cast("bigint").alias("gen"), "key", "seq", "value", "tombstone").unionByName(runs.where(~F.col("gen").between(low, high)))


def encoded_size() -> Column:
    """Bytes of an encoded entry: checksum, time (as seq), flags, sizes, key, value; deletes have no value size."""
    key, value = F.octet_length("key").cast("bigint"), F.octet_length("value").cast("bigint")
    body = varint_length(entry_crc(F.col("key"), F.col("value"))) + varint_length(F.col("seq")) + 2 + varint_length(key) + key
    return F.when(F.col("tombstone"), body).otherwise(body + varint_length(value) + value)


def index(runs: DataFrame) -> DataFrame:
    """Place and number of each entry in its run. Runs are bounded by the flush, so a window over one is."""
    w = Window.partitionBy("gen").orderBy("key")
    sized = runs.withColumn("size", encoded_size())
    return sized.select("gen", "key", "size", F.row_number().over(w).cast("bigint").alias("rn"), F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("offset"))


def summary(indexed: DataFrame, thinning: int) -> DataFrame:
    """The sparse index: the first entry of each run and every thinning-th after it."""
    return indexed.where((F.col("rn") - 1) % thinning == 0).select("gen", "key", "rn", "offset")


def bracket(samples: DataFrame, bounds: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe key and each run whose bounds hold it: the samples around it (lower <= key < upper)."""
    within = probes.join(F.broadcast(bounds), (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key"))).select("gen", "key", F.lit(True).alias("probe"))
    both = within.unionByName(samples.select("gen", "key", F.lit(False).alias("probe")))
    w = Window.partitionBy("gen").orderBy("key", "probe")
    sample = F.when(~F.col("probe"), F.col("key"))
    lower = F.last(sample, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upper = F.first(sample, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return both.select("gen", "key", "probe", lower.alias("lower"), upper.alias("upper")).where("probe").drop("probe")


def prune_by_bounds(bounds: DataFrame, probes: DataFrame) -> DataFrame:
    """key and gen of runs that may hold the key by their least and greatest keys. Bounds are one row a run."""
    return probes.join(F.broadcast(bounds), F.col("key").between(F.col("min_key"), F.col("max_key"))).select("key", "gen")


def prune_by_bloom(runs: DataFrame, probes: DataFrame, bits: int, hashes: int) -> DataFrame:
    """key and gen of runs whose Bloom filter doesn't rule the key out."""
    filters = bloom_bits(runs.select("gen", F.col("key").alias("item")), bits, hashes, by=("gen",))
    return bloom_probe(filters, probes.select(F.col("key").alias("item")), bits, hashes, by=("gen",)).where("maybe").select(F.col("item").alias("key"), "gen")
