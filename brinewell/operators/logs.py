"""Segments of the log: which may go, and how entries are packed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.ordering import running_sum


def expired_segments(log: DataFrame, flushed: DataFrame) -> DataFrame:
    """Segments, all but the newest, whose every operation is flushed; log(segment, seq), flushed(seq)."""
    left = log.select("segment", "seq").join(flushed.select("seq", F.lit(1).alias("done")), "seq", "left").groupBy("segment").agg(F.count("*").alias("entries"), F.count("done").alias("done"))
    newest = left.agg(F.max("segment").alias("newest"))
    return left.join(F.broadcast(newest)).where("segment < newest and entries = done").select("segment", "entries")


def low_watermark(log: DataFrame, flushed: DataFrame) -> DataFrame:
    """The last segment of the unbroken expired prefix; -1 for none. One row."""
    segments = log.select("segment").distinct()
    kept = segments.join(expired_segments(log, flushed), "segment", "left_anti").agg(F.min("segment").alias("first_kept"))
    return segments.join(F.broadcast(kept)).agg(F.coalesce(F.max(F.when(F.col("segment") < F.col("first_kept"), F.col("segment"))), F.lit(-1)).cast("bigint").alias("low_watermark"))


def pack(ops: DataFrame, size: Column, segment_bytes: int) -> DataFrame:
    """seq, offset, segment: entries laid end to end in segments of so many bytes, an entry belonging where it begins."""
    placed = running_sum(ops.withColumn("size", size.cast("bigint")), "seq", F.col("size"), "offset", inclusive=False)
    return placed.select("seq", "size", "offset", F.floor(F.col("offset") / segment_bytes).alias("segment"))


class Packer:
    """Places entries in blocks of a segment: every piece has a header, headers aren't split, an entry stays in one segment."""

    def __init__(self, block: int, blocks: int, header: int) -> None:
        self.block, self.blocks, self.header = block, blocks, header
        self.segment = self.at = self.end = 0

    def place(self, size: int) -> tuple[int, int, int, int]:
        """Segment, block, offset and pieces of the next entry, of so many bytes beside headers."""
        room = self.block - self.header
        at, begin = (self.at, self.end) if self.end <= room else (self.at + 1, 0)
        more = -(-max(0, size - (room - begin)) // room)
        if at + more >= self.blocks:  # it goes to a new segment
            self.segment, at, begin = self.segment + 1, 0, 0
            more = -(-max(0, size - room) // room)
        rest = size - (room - begin)
        self.at, self.end = at + more, self.header + rest - (more - 1) * room if more else begin + self.header + size
        return self.segment, at, begin, more + 1


def pack_greedy(ops: DataFrame, size: Column, block: int, blocks: int, header: int, shards: int) -> DataFrame:
    """shard, seq, segment, block, offset, pieces of entries, as each shard of the keys fills its own segments.

    An entry begins where the last one ended, so this is sequential in a shard: rows stream through in order of seq with
    one position as state. Entries that no segment can hold are left out, as their command is refused.
    """

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, packer = None, None
        for pdf in parts:
            out = []
            for s, n in zip(pdf["shard"], pdf["size"], strict=True):
                if s != shard:
                    shard, packer = s, Packer(block, blocks, header)
                out.append(packer.place(n))
            placed = pd.DataFrame(out, columns=["segment", "block", "offset", "pieces"], index=pdf.index).astype("int64")
            yield pd.concat([pdf[["shard", "seq"]], placed], axis=1)

    shard = F.pmod(F.crc32(F.encode("key", "UTF-8")), F.lit(shards)).cast("bigint").alias("shard")
    dealt = ops.select(shard, "seq", size.cast("bigint").alias("size")).where(F.col("size") <= blocks * (block - header))
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "seq").mapInPandas(fill, "shard long, seq long, segment long, block long, offset long, pieces long")


def add_flushed(flushed: DataFrame, more: DataFrame) -> DataFrame:
    """The set of checksums of flushed entries with those of a run."""
    return flushed.unionByName(more).distinct()


def remove_flushed(flushed: DataFrame, gone: DataFrame) -> DataFrame:
    """The set without the checksums of segments that are deleted."""
    return flushed.exceptAll(gone.distinct())
