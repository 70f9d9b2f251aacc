"""Document fingerprints by one-permutation MinHash, with DataFrame expressions only.

Every shingle of five words is hashed once; the hash's first byte is its bin, and each bin keeps its least hash. An
empty bin borrows from the first filled bin along its own random cycle through all bins (optimal densification). Of
each bin the lowest four bits are stored, packed sixteen to a long. Equal bins by chance (one in sixteen) are taken
off again when fingerprints are compared.

The report joins every document with the next by doc_id. Documents are dealt by quantiles of doc_id; within a bucket
the next row is at hand, and only the first document of each bucket is sent to the bucket before it.

Defined cases: a null text is empty; a text without words has fingerprint zero, is fully like another such and not at
all like one with words; fewer than five words are one shingle; a null doc_id sorts first; rows with equal doc_id are
ordered by text; the next of the last document is the first, of a single document itself; only doc_id and text are
read. Texts are never cut.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
BINS = 256
BITS = 4
_PER_LONG = 64 // BITS
_LOW = (1 << 56) - 1
_TRIES = 6
_BLANK = "\\u0020\\u0009-\\u000D"


def _cycles(seed: int = 5) -> tuple[list[int], list[int], list[int]]:
    """For each bin: where its cycle begins, its odd step, and the step's inverse modulo BINS."""
    rng = random.Random(seed)
    begins, steps = [rng.randrange(BINS) for _ in range(BINS)], [rng.randrange(1, BINS, 2) for _ in range(BINS)]
    return begins, steps, [pow(s, -1, BINS) for s in steps]


def _literal(values: list[int], kind: str = "int") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _sentinels() -> Column:
    """The greatest hash of each bin, in the order of signed longs; it marks the bin as empty."""
    return F.array(*[F.lit((b << 56) | _LOW).cast("long") for b in range(-128, 128)])


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: the packed fingerprint of the text column, array<long>; null for a text without words."""
    words, hashes, dense, filled, low = (f"_{out}_{x}" for x in ("words", "hashes", "dense", "filled", "low"))
    w, n = F.col(words), F.size(words)
    trimmed = F.regexp_replace(F.lower(F.col(text)), rf"^[{_BLANK}]+|[{_BLANK}]+$", "")
    df = df.withColumn(words, F.split(trimmed, f"[{_BLANK}]+"))
    shingles = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*[w[i + j] for j in range(WIDTH)]))
    df = df.withColumn(hashes, F.when((n == 1) & (w[0] == ""), F.lit(None)).when(n < WIDTH, F.array(F.xxhash64(w))).otherwise(shingles)).drop(words)
    h = F.col(hashes)
    df = df.withColumn(hashes, F.when(h.isNotNull(), F.sort_array(F.concat(h, _sentinels()))))
    first = F.filter(hashes, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(h[F.greatest(i - 1, F.lit(0))], 56)))
    df = df.withColumn(dense, F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(_LOW)) != _LOW, x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))).drop(hashes)
    df = df.withColumn(filled, F.filter(F.transform(dense, lambda x, i: F.when(x.isNotNull(), i * (1 << BITS) + x)), lambda x: x.isNotNull()))

    begins, steps, inverses = map(_literal, _cycles())
    d, mask = F.col(dense), F.lit(BINS - 1)

    def borrowed(i: Column) -> Column:
        tries = [d[(begins[i] + t * steps[i]).bitwiseAND(mask)] for t in range(_TRIES)]
        nearest = F.array_min(F.transform(filled, lambda e: ((F.shiftright(e, BITS) - begins[i]) * inverses[i]).bitwiseAND(mask) * (1 << BITS) + e.bitwiseAND(F.lit((1 << BITS) - 1))))
        return F.coalesce(*tries, nearest.bitwiseAND(F.lit((1 << BITS) - 1)))

    df = df.withColumn(low, F.when(F.size(filled) == BINS, d).otherwise(F.transform(dense, lambda x, i: F.coalesce(x, borrowed(i))))).drop(dense, filled)
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)),
        lambda g: F.aggregate(F.slice(low, g * _PER_LONG + 1, _PER_LONG), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.cast("long"))),
    )
    return df.withColumn(out, F.when(F.col(low).isNotNull(), packed)).drop(low)


def digits(packed: Column) -> Column:
    """A fingerprint as a string of hexadecimal digits, one for each bin."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), _PER_LONG, "0")), ""), F.lit("0" * BINS))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, freed of chance matches; 0 to 1."""

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    off = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, x: acc + x)
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (1 - off / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.round(estimate, 6))


def _buckets(docs: DataFrame, rows: int, most: int) -> DataFrame:
    """docs with bucket: the number of quantiles of doc_id that doc_id reaches, found by halving; -1 for null."""
    n = docs.where("doc_id is not null").count()
    levels = max(0, min(most, n // rows)).bit_length()
    grid = [i / (1 << levels) for i in range(1, 1 << levels)]
    bounds = docs.agg(F.percentile_approx("doc_id", grid, 1 << 17).alias("at")).first()["at"] if grid and n else []
    if not bounds:
        return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    at, halves = _literal(bounds, "bigint"), _literal([1 << (levels - 1 - k) for k in range(levels)])
    found = F.aggregate(halves, F.lit(0), lambda i, step: F.when(at[i + step - 1] <= F.col("doc_id"), i + step).otherwise(i))
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(found))


def with_next(docs: DataFrame, bucket_rows: int = 256, most_buckets: int = 1 << 13) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp: each document beside the next by doc_id."""
    docs = _buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), bucket_rows, most_buckets)
    firsts = docs.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))  # no more rows than buckets
    order = Window.orderBy("bucket")
    ahead = firsts.select("bucket", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    heads = docs.join(F.broadcast(firsts.withColumnRenamed("bucket", "b")), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    heads = with_fingerprint(heads.groupBy("bucket").agg(F.min("text").alias("head_text")), "head_text", "head_fp")
    bridge = ahead.join(heads.withColumnRenamed("bucket", "then"), "then").select(F.col("bucket").alias("b"), "head_text", "head_fp")

    w = Window.partitionBy("bucket").orderBy("doc_id", "text")
    own = with_fingerprint(docs, "text", "fp").select("bucket", "doc_id", "text", "fp", F.lead("text").over(w).alias("t"), F.lead("fp").over(w).alias("f"), F.lead(F.lit(1)).over(w).alias("more"))
    both = own.join(bridge.hint("merge"), (F.col("bucket") == F.col("b")) & F.col("more").isNull(), "left")
    inside = F.col("more").isNotNull()
    return both.select("doc_id", "text", "fp", F.when(inside, F.col("t")).otherwise(F.col("head_text")).alias("next_text"), F.when(inside, F.col("f")).otherwise(F.col("head_fp")).alias("next_fp"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half (rounded down) replaced by as many code points from the start of the next text.
    """
    both = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))).drop("text", "next_text")
    both = with_fingerprint(both, "edited", "edited_fp")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digits(F.col("fp")).alias("fingerprint"), digits(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
