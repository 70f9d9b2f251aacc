"""Token buckets and caches over traces of requests. Both are sequential, so rows stream in order with a small state."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewell.functions.ordering import _bounds, _bucket


class TokenBucket:
    """Starts full; whole intervals since the last refill add tokens up to the capacity."""

    def __init__(self, capacity: int, interval: int, now: int) -> None:
        self.capacity = capacity if capacity > 0 else 1
        self.interval, self.tokens, self.last = max(1, interval), self.capacity, now

    def allow(self, now: int, n: int = 1) -> bool:
        if n <= 0:
            return True
        gained = max(0, now - self.last) // self.interval
        if gained > 0:
            self.tokens = min(self.capacity, self.tokens + gained)
            self.last += gained * self.interval
        if self.tokens >= n:
            self.tokens -= n
            return True
        return False


def bucket_decisions(requests: DataFrame, capacity: int, interval_us: int, partitions: int | None = None) -> DataFrame:
    """key, seq, allowed for requests(key, seq, at in microseconds, n): a bucket for each key, requests by time and seq.

    Keys are dealt to partitions and rows stream through in order: a hot key takes time but no memory.
    """

    def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bucket = None, None
        for pdf in parts:
            out = []
            for key, at, n in zip(pdf["key"], pdf["at"], pdf["n"], strict=True):
                if key != now:
                    now, bucket = key, TokenBucket(capacity, interval_us, at)
                out.append(bucket.allow(at, n))
            yield pdf[["key", "seq"]].assign(allowed=out)

    rows = requests.select("key", "seq", "at", "n")
    dealt = rows.repartition("key") if partitions is None else rows.repartition(partitions, "key")
    return dealt.sortWithinPartitions("key", "at", "seq").mapInPandas(decide, "key string, seq long, allowed boolean")


def bucket_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("key").agg(F.count("*").alias("requests"), F.sum(F.col("allowed").cast("bigint")).alias("allowed"), F.sum((~F.col("allowed")).cast("bigint")).alias("denied"))


class LruCache:
    def __init__(self, capacity: int, keys: list[str] | None = None) -> None:
        self.capacity, self.keys = capacity, OrderedDict.fromkeys(keys or [])

    def get(self, key: str, held: bool = True) -> bool:
        """Whether the key was there; it is the most recent afterwards, if it was there or the store holds it."""
        hit = key in self.keys
        if hit:
            self.keys.move_to_end(key)
        elif held:
            if len(self.keys) >= self.capacity:
                self.keys.popitem(last=False)
            self.keys[key] = None
        return hit

    def refresh_if_present(self, key: str) -> None:
        if key in self.keys:
            self.keys.move_to_end(key)


def lru_hits(gets: DataFrame, capacity: int, chunks: int = 64) -> DataFrame:
    """seq, key, hit for a trace of gets(seq, key) through one cache.

    The state of a cache is its last distinct keys, and those of a stretch of the trace follow from the stretch and the
    state before it. So chunks are summed up in parallel, the states between them are chained from the summaries
    (chunks times capacity keys), and then all chunks are replayed in parallel.
    """
    trace = gets.select("seq", "key")
    trace = trace.withColumn("chunk", _bucket("seq", _bounds(trace, "seq", chunks)))
    last = trace.groupBy("chunk", "key").agg(F.max("seq").alias("seq"))
    recent = last.withColumn("r", F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("seq")))).where(F.col("r") <= capacity)
    found: dict[int, list[str]] = {}
    for r in recent.orderBy("chunk", F.desc("r")).collect():
        found.setdefault(r.chunk, []).append(r.key)
    states, state = [], []
    for chunk in sorted(found):
        states.append((chunk, state))
        state = ([k for k in state if k not in set(found[chunk])] + found[chunk])[-capacity:]
    begun = trace.sparkSession.createDataFrame(states, "chunk int, state array<string>")

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache = None, None
        for pdf in parts:
            out = []
            for chunk, key, state in zip(pdf["chunk"], pdf["key"], pdf["state"], strict=True):
                if chunk != now:
                    now, cache = chunk, LruCache(capacity, list(state))
                out.append(cache.get(key))
            yield pdf[["seq", "key"]].assign(hit=out)

    first = F.row_number().over(Window.partitionBy("chunk").orderBy("seq")) == 1
    dealt = trace.join(F.broadcast(begun), "chunk").withColumn("state", F.when(first, F.col("state")).otherwise(F.array()))
    return dealt.select("chunk", "seq", "key", "state").sortWithinPartitions("chunk", "seq").mapInPandas(replay, "seq long, key string, hit boolean")


def lru_mixed(ops: DataFrame, capacity: int, shards: int) -> DataFrame:
    """shard, seq, hit of the gets among ops(seq, key, op): a cache for each shard of the keys.

    Only a get of a key that the store holds at that time, put and not deleted since, fills the cache; puts and deletes
    refresh keys that are present. Gets of absent keys miss and fill nothing.
    """

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache = None, None
        for pdf in parts:
            rows = []
            for shard, seq, key, op, held in zip(pdf["shard"], pdf["seq"], pdf["key"], pdf["op"], pdf["held"], strict=True):
                if shard != now:
                    now, cache = shard, LruCache(capacity)
                if op == "GET":
                    rows.append((shard, seq, cache.get(key, held)))
                else:
                    cache.refresh_if_present(key)
            yield pd.DataFrame(rows, columns=["shard", "seq", "hit"]).astype({"shard": "int64", "seq": "int64", "hit": "bool"})

    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(F.when(F.col("op") != "GET", F.col("op") == "PUT"), ignorenulls=True).over(before), F.lit(False))
    dealt = ops.select(F.pmod(F.crc32(F.encode("key", "UTF-8")), F.lit(shards)).cast("bigint").alias("shard"), "seq", "key", "op", held.alias("held"))
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "seq").mapInPandas(replay, "shard long, seq long, hit boolean")


class FifoPool:
    """Blocks in the order in which they came; a lookup moves nothing, a miss adds the block and the oldest goes."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.blocks = max(1, capacity), OrderedDict()

    def get(self, block: str) -> bool:
        if block in self.blocks:
            return True
        if len(self.blocks) >= self.capacity:
            self.blocks.popitem(last=False)
        self.blocks[block] = None
        return False


def fifo_hits(gets: DataFrame, capacity: int, shards: int) -> DataFrame:
    """shard, seq, hit for lookups gets(seq, key) of blocks: a pool for each shard of the keys, rows streaming in order."""

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pool = None, None
        for pdf in parts:
            out = []
            for shard, key in zip(pdf["shard"], pdf["key"], strict=True):
                if shard != now:
                    now, pool = shard, FifoPool(capacity)
                out.append(pool.get(key))
            yield pdf[["shard", "seq"]].assign(hit=out)

    dealt = gets.select(F.pmod(F.crc32(F.encode("key", "UTF-8")), F.lit(shards)).cast("bigint").alias("shard"), "seq", "key")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "seq").mapInPandas(replay, "shard long, seq long, hit boolean")


def hit_rate(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("gets"), F.sum(F.col("hit").cast("bigint")).alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))
