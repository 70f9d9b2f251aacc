"""Sketches with fixed hash functions: Bloom filters, Count-Min, HyperLogLog, SimHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions import STOP_WORDS, first_set_bit, seeded_slot, u64_bits, u64_hex, words


def _slots(item: Column, m: int, k: int) -> Column:
    return F.array(*[seeded_slot(item, i, m) for i in range(k)])


def bloom_bits(items: DataFrame, m: int, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Set bits (by, bit) of a filter over items(by, item). Items are hashed where they lie: a task sends m bits of a filter at most."""
    return items.select(*by, F.explode(_slots(F.col("item"), m, k)).alias("bit")).distinct()


def bloom_probe(bits: DataFrame, probes: DataFrame, m: int, k: int, by: Sequence[str] = ()) -> DataFrame:
    """item (and by) with maybe: whether all its bits are set. Filters without any of its bits are not listed."""
    asked = probes.select("item").distinct().select("item", F.array_distinct(_slots(F.col("item"), m, k)).alias("slots")).select("item", F.size("slots").alias("n"), F.explode("slots").alias("bit"))
    hit = asked.join(bits, "bit").groupBy("item", "n", *by).agg(F.count("*").alias("found"))
    if by:
        return hit.select("item", *by, (F.col("found") == F.col("n")).alias("maybe"))
    return probes.select("item").distinct().join(hit, "item", "left").select("item", (F.coalesce(F.col("found"), F.lit(0)) == F.coalesce(F.col("n"), F.lit(-1))).alias("maybe"))


def count_min_cells(items: DataFrame, width: int, depth: int) -> DataFrame:
    """Cells (row, col, count). Items are hashed where they lie: a task sends width times depth cells at most."""
    cells = items.select(F.posexplode(_slots(F.col("item"), width, depth)).alias("row", "col"))
    return cells.groupBy(F.col("row").cast("bigint").alias("row"), "col").agg(F.count("*").alias("count"))


def count_min_estimate(cells: DataFrame, probes: DataFrame, width: int, depth: int) -> DataFrame:
    """item, estimate: the least of its cells, a missing cell being 0."""
    asked = probes.select("item").distinct().select("item", F.posexplode(_slots(F.col("item"), width, depth)).alias("row", "col")).withColumn("row", F.col("row").cast("bigint"))
    return asked.join(cells, ["row", "col"], "left").groupBy("item").agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


def hll_registers(items: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """Registers (by, bucket, rank) of items(by, item) that are not empty."""
    p = min(16, max(4, p))
    h = u64_hex(F.encode("item", "UTF-8"))
    hashed = items.select(*by, F.shiftrightunsigned(u64_bits(h), 64 - p).alias("bucket"), first_set_bit(h).alias("rank"))
    return hashed.groupBy(*by, "bucket").agg(F.max("rank").alias("rank"))


def hll_merge(*registers: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, registers).groupBy("bucket").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, p: int, by: Sequence[str] = ()) -> DataFrame:
    """by, registers (not empty), estimate: harmonic mean with linear counting below and the 32-bit correction above."""
    m = 1 << min(16, max(4, p))
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = registers.groupBy(*by).agg(F.count("*").alias("registers"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"))
    empty = F.lit(m) - F.col("registers")
    raw = F.lit(alpha * m * m) / (empty + F.coalesce("s", F.lit(0.0)))
    top = F.lit(2.0**32)
    fixed = F.when((raw <= 2.5 * m) & (empty > 0), F.lit(float(m)) * F.log(F.lit(float(m)) / empty)).when(raw > top / 30, -top * F.log(1 - raw / top)).otherwise(raw)
    return sums.select(*by, "registers", F.round(fixed, 6).alias("estimate"))


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fp: 64 bits as a long. A document's tokens are hashed and added up in its own row, so nothing is shuffled; a batch hashes each distinct token once."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in them:
            lists = b.column("words")
            known, at = lists.values.dictionary_encode(), lists.offsets.to_numpy()
            # Bit j of byte i of a hash is position 8 i + j.
            digests = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest()[:8] for t in known.dictionary.to_pylist()), np.uint8).reshape(-1, 8)
            votes, where = 2 * np.unpackbits(digests, axis=1, bitorder="little").astype(np.int8) - 1, known.indices.to_numpy()
            votes[[i for i, t in enumerate(known.dictionary.to_pylist()) if t in STOP_WORDS]] = 0
            ones = np.array([votes[where[a:z]].sum(axis=0, dtype=np.int64) > 0 for a, z in zip(at, at[1:], strict=False)], bool).reshape(-1, 64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(np.packbits(ones, axis=1, bitorder="little").view("<i8").reshape(-1))})

    cleaned = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    return cleaned.mapInArrow(batches, "doc_id bigint, fp bigint")


def near_fingerprints(marked: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b, bits) of different fingerprints at most max_bits apart; each fingerprint stands for all its documents.

    One of max_bits + 1 bands is equal in such a pair. A pair is reported at its first equal band only.
    """
    bands = max_bits + 1
    cuts = [(64 * i // bands, 64 * (i + 1) // bands) for i in range(bands)]
    part = lambda fp, i: F.shiftrightunsigned(fp, cuts[i][0]).bitwiseAND(F.lit((1 << (cuts[i][1] - cuts[i][0])) - 1))
    nodes = marked.select("fp").distinct()
    keyed = nodes.select("fp", F.posexplode(F.array(*[part(F.col("fp"), i) for i in range(bands)])).alias("band", "key"))
    other = keyed.withColumnRenamed("fp", "fp2")
    first = F.coalesce(*[F.when(part(F.col("fp"), i) == part(F.col("fp2"), i), i) for i in range(bands)])
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits) & (F.col("band") == first)
    return keyed.join(other, ["band", "key"]).where(near).select(F.col("fp").alias("a"), F.col("fp2").alias("b"), F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))).cast("bigint").alias("bits"))
