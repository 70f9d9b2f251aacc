"""Merkle trees over blocks of rows, and what differs between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.ordering import row_numbers

_NIL = b"\0" * 32


def blocks(rows: DataFrame, order: str, columns: list[str], size: int) -> DataFrame:
    """idx, data: so many rows each in ascending order, as lines of columns joined by U+0001."""
    numbered = row_numbers(rows, order, "rn").withColumn("idx", F.floor((F.col("rn") - 1) / size))
    line = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"])
    return numbered.groupBy("idx").agg(F.encode(F.array_join(parts, "\n"), "UTF-8").alias("data"))


def _hash(level: Column | int, *data: Column) -> Column:
    prefix = F.lit(bytes([level])) if isinstance(level, int) else level
    return F.sha2(F.concat(prefix, *data), 256)


def leaves(blocked: DataFrame) -> DataFrame:
    """level, idx, hash of the leaves: a block's hash under the prefix of level 1."""
    return blocked.select(F.lit(1).cast("bigint").alias("level"), "idx", _hash(1, F.col("data")).alias("hash"))


def parents(level: DataFrame, number: int) -> DataFrame:
    """The level above: pairs under its own number; a node without a partner under the number below, after zeros."""
    side = lambda i: F.unhex(F.max(F.when(F.col("idx") % 2 == i, F.col("hash"))))
    paired = level.groupBy(F.floor(F.col("idx") / 2).alias("idx")).agg(side(0).alias("left"), side(1).alias("right"))
    whole = F.when(F.col("right").isNull(), _hash(number - 1, F.lit(_NIL), F.col("left"))).otherwise(_hash(number, F.col("left"), F.col("right")))
    return paired.select(F.lit(number).cast("bigint").alias("level"), "idx", whole.alias("hash"))


def build(base: DataFrame) -> list[DataFrame]:
    """All levels from the leaves to the root. Halving is by aggregation; the number of levels follows from the count of leaves."""
    n, levels = base.count(), [base]
    while n > 1:
        levels.append(parents(levels[-1], len(levels) + 1))
        n = -(-n // 2)
    return levels


def root(base: DataFrame) -> DataFrame:
    top = build(base)[-1]
    return top.select("level", "hash")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """idx of leaves that differ or are missing on one side."""
    both = a.select("idx", F.col("hash").alias("x")).join(b.select("idx", F.col("hash").alias("y")), "idx", "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("idx")


def matches(level: DataFrame, idx: int, digest: str) -> DataFrame:
    return level.where((F.col("idx") == idx) & (F.col("hash") == digest))
