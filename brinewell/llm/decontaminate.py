"""Benchmark decontamination by spaced-seed hashing, with DataFrame expressions only.

A mask keeps six of its span's token positions and ignores the others, so a seed survives a substitution at an
ignored position. The three masks meet every way to change 4 words of 20, and 454 of the 455 ways to change 3 of 15. The seeds of all benchmark items are joined by equality with the seeds at every position of every
document; around each hit, a window of tokens of document and item is compared place by place, and a share of equal
tokens of min_similarity or more confirms the overlap.

Documents are not shuffled: their seeds are streamed past the benchmark's. Those are broadcast in blocks of at most
block_seeds hashes, one pass over the documents for each block, so what is broadcast stays bounded for benchmarks of
any size. Only hits, with their window of bounded length, are joined with the items themselves.

Defined cases: tokens are runs of letters and digits of any script in lower case; items shorter than the shortest span
(7), down to SHORTEST_ITEM tokens, must occur whole and unchanged, still shorter ones never match; null texts have no
tokens; items with equal tokens are searched once and reported under their smallest item_id; rows that share a doc_id,
or have none, but differ in text are found and dropped on their own, and reported a row each; rows equal in both are
reported once; only doc_id and text, item_id and text are read. Texts are never cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.llm.shared import Scratch, at_most, row_key, stash

#: 1: the token counts; 0: it is ignored.
MASKS = ("1101111", "111001000101", "1110001011")
WINDOW = 20
MIN_SIMILARITY = 0.8
BLOCK_SEEDS = 2_000_000
SHORTEST_ITEM = 5
_SHORTEST = min(map(len, MASKS))


def _tokens(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _seeds(words: str, at: str, n: str, masks: tuple[str, ...]) -> Column:
    """The hashes of all masks that fit at a place; the mask's number is part of the hash."""
    w, i = F.col(words), F.col(at)
    return F.array(*[F.when(i + len(m) <= F.col(n), F.xxhash64(F.lit(k), *[w[i + j] for j, c in enumerate(m) if c == "1"])) for k, m in enumerate(masks)])


def _places(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """A row for each place of a word at which the shortest mask fits. The outer form keeps the tokens from being made twice."""
    shortest = min(map(len, masks))
    spots = F.when(F.col("n") >= shortest, F.sequence(F.lit(0), F.col("n") - shortest))
    return df.withColumn("i", F.explode_outer(spots)).where("i is not null")


def _spread(places: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """A row for each place and mask: keep, i, k (the mask), seed."""
    return places.select(*keep, "i", F.posexplode(_seeds("words", "i", "n", masks)).alias("k", "seed")).where("seed is not null")


def _overlaps(docs: DataFrame, benchmark: DataFrame, keep: Scratch, window: int = WINDOW, min_similarity: float = MIN_SIMILARITY, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """doc_id, key_hi, key_lo, item_id, first_word, similarity, hits."""
    items = benchmark.select(F.col("item_id").alias("item_id"), _tokens("text").alias("item")).groupBy("item").agg(F.min("item_id").alias("item_id")).select("item_id", "item", F.size("item").alias("m"))
    items = keep.stash(items, "decontam-items")
    short = [r.m for r in items.where(F.col("m").between(SHORTEST_ITEM, _SHORTEST - 1)).select("m").distinct().collect()]  # a few lengths at most
    masks = (*MASKS, *["1" * m for m in sorted(short)])

    def span(k: str) -> Column:
        return F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col(k) + 1)

    planted = _spread(_places(items.select("item_id", F.col("item").alias("words"), F.col("m").alias("n")), masks), masks, "item_id", "n").select("item_id", F.col("i").alias("p"), "k", "seed", "n")
    planted = planted.where((F.col("k") < len(MASKS)) | (F.col("n") == span("k"))).drop("n")  # only items too short for the others are sought whole
    planted = keep.stash(planted, "decontam-seeds")
    blocks = max(1, -(-planted.count() // block_seeds))

    row = ("doc_id", "key_hi", "key_lo")
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), _tokens("text").alias("words")).select(*row, "words", F.size("words").alias("n"))
    seeds = _spread(_places(words, masks), masks, *row, "words", "n")
    lo, hi = F.greatest(F.col("i") + span("k") - window, F.lit(0)), F.least(F.col("i") + window, F.col("n"))

    def hits(block: int) -> DataFrame:
        wanted = planted.where(F.pmod("seed", F.lit(blocks)) == block).select("seed").distinct()
        return seeds.join(F.broadcast(wanted), "seed").select(*row, "n", "i", "seed", lo.alias("at"), F.slice("words", lo + 1, hi - lo).alias("near"))

    found = reduce(DataFrame.unionByName, [hits(b) for b in range(blocks)])
    both = found.join(planted.join(items, "item_id").hint("merge"), "seed")  # hits may be many: never broadcast them
    c = F.col
    length = F.least(F.lit(window), c("m"), c("n"))
    shift = c("i") - c("p")
    a = F.greatest(F.lit(0), -shift, c("p") + span("k") - window)
    b = F.least(c("m"), c("n") - shift, c("p") + window)
    both = both.withColumns({"shift": shift, "a": a, "len": length}).withColumn("size", b - c("a"))
    same = F.zip_with(F.slice("item", c("a") + 1, c("size")), F.slice("near", c("a") + c("shift") - c("at") + 1, c("size")), lambda x, y: F.when(x == y, "1").otherwise("0"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), c("size") - c("len")), lambda s: F.length(F.replace(F.substr(c("same"), s + 1, c("len")), F.lit("0"), F.lit("")))))
    scored = both.where("size >= len").withColumn("same", F.array_join(same, "")).withColumn("similarity", F.round(best / c("len"), 4)).where(c("similarity") >= min_similarity)
    return scored.groupBy(*row, "item_id").agg(F.min("i").cast("long").alias("first_word"), F.max("similarity").alias("similarity"), F.count("*").alias("hits"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, first_word (of the first confirmed hit in the document), similarity (the best window's), hits."""
    with Scratch(docs.sparkSession) as keep:
        found = stash(_overlaps(docs, benchmark, keep, **options), "decontam-found")
    return found.select("doc_id", "item_id", "first_word", "similarity", "hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 200_000, **options) -> DataFrame:
    """The rows of docs, all columns, that overlap with no benchmark item. What is to go is broadcast only while it is little."""
    with Scratch(docs.sparkSession) as keep:
        bad = stash(_overlaps(docs, benchmark, keep, **options).select("doc_id", "key_hi", "key_lo").distinct(), "decontam-rows")
    hi, lo = row_key(docs["text"])
    same = docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (hi == bad["key_hi"]) & (lo == bad["key_lo"])
    return docs.join(F.broadcast(bad) if at_most(bad, broadcast_rows) else bad, same, "left_anti")
