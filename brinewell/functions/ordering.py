"""Row numbers and running sums over a whole table without a window over one partition.

Rows are dealt to buckets by boundary keys from a small hash sample; each bucket is ordered on its own, and the sums of
the buckets before it, a few hundred numbers, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256
_SAMPLE = 16


def _bounds(df: DataFrame, order: str, buckets: int) -> list:
    """At most buckets - 1 boundary keys. The sample depends on the keys alone, so every evaluation agrees."""
    n = df.count()
    if n < 4 * buckets:
        return []
    step = max(1, n // (buckets * _SAMPLE))
    keys = sorted(r[0] for r in df.select(order).where(F.col(order).isNotNull() & (F.pmod(F.xxhash64(order), F.lit(step)) == 0)).distinct().limit(buckets * _SAMPLE * 8).collect())
    return sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)}) if keys else []


def _bucket(order: str, bounds: list) -> Column:
    if not bounds:
        return F.lit(0)
    levels = len(bounds).bit_length()
    at = F.array(*map(F.lit, bounds))
    halves = F.array(*[F.lit(1 << (levels - 1 - k)) for k in range(levels)])
    key = F.col(order)
    found = F.aggregate(halves, F.lit(0), lambda i, step: F.when((i + step <= len(bounds)) & (F.get(at, i + step - 1) <= key), i + step).otherwise(i))
    return F.when(key.isNull(), 0).otherwise(found)


def running_sum(df: DataFrame, order: str, value: Column, out: str, inclusive: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """df with out: the sum of value over rows up to this one (or before it) in ascending order of a unique column."""
    df = df.withColumn("_v", value.cast("bigint")).withColumn("_b", _bucket(order, _bounds(df, order, buckets)))
    totals = df.groupBy("_b").agg(F.sum("_v").alias("_t"))  # no more rows than buckets
    before = totals.select(F.col("_b").alias("_k"), F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    summed = df.join(F.broadcast(before), F.col("_b") == F.col("_k")).withColumn(out, F.col("_o") + F.coalesce(F.sum("_v").over(w), F.lit(0)))
    return summed.drop("_v", "_b", "_k", "_o")


def row_numbers(df: DataFrame, order: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """df with out: 1, 2, ... in ascending order of a unique column."""
    return running_sum(df, order, F.lit(1), out, buckets=buckets)
