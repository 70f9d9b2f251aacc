"""Every registered query over the reference tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell import streaming
from brinewell.functions import entry_crc, tokens, varint, varint_value
from brinewell.operators import control, dictionary, integrity, logs, runs, scans, sketches, versions
from brinewell.plans.options import bloom_size, count_min_size
from brinewell.plans.oracle import SQL as SQL
from brinewell.sources import LIMITED, OK, UNKNOWN, as_ops, as_requests, kv_ops, kv_orders, kv_orders_log, kv_urls, put_status, store, stream_of, table
from brinewell.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

#: Operations in a run and in a segment of the log, keys in a memtable, rows in a Merkle block and in a page.
RUN_OPS, SEGMENT_OPS, MEMTABLE, BLOCK_ROWS, PAGE = 1000, 400, 500, 16, 100
THINNING, SHARDS, CACHE = 8, 8, 20
SEGMENT_BYTES, HEADER = 65_536, 30
PAYLOAD_LIMIT = 4096
#: Bytes of a block of the log and blocks of a segment that is filled greedily; bytes of a fragment; properties of runs.
BLOCK_BYTES, SEGMENT_BLOCKS = 512, 16
FRAGMENT = 4096
BLOOM = bloom_size(150, 0.02)
COUNT_MIN = count_min_size(0.01, 0.01)
HLL_P = 10
CAPACITY, INTERVAL_US = 5, 12 * 3600 * 1_000_000
AS_OF, LOW_USER, HIGH_USER = 5000, "user:000020", "user:000060"
WANTED = ("user:000001", "user:000007", "user:000042", "user:000149", "user:999999")

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- versions


@query
def kv_snapshot(spark, d):
    return versions.snapshot(kv_ops(spark, d))


@query
def kv_get_point(spark, d):
    return versions.get(kv_ops(spark, d), ["user:000042"])


@query
def kv_multi_get(spark, d):
    return versions.get(kv_ops(spark, d), WANTED)


@query
def kv_snapshot_as_of(spark, d):
    return versions.snapshot_as_of(kv_ops(spark, d), AS_OF)


@query
def kv_version_history(spark, d):
    return versions.history(kv_ops(spark, d))


@query
def kv_deleted_keys(spark, d):
    return versions.deleted_keys(kv_ops(spark, d))


@query
def kv_delete_of_missing(spark, d):
    return versions.deletes_of_missing(kv_ops(spark, d))


# ---- scans


@query
def kv_range_scan(spark, d):
    return scans.range_scan(kv_ops(spark, d), LOW_USER, HIGH_USER)


@query
def kv_prefix_scan(spark, d):
    return scans.prefix_scan(kv_urls(spark, d), "https://")


@query
def kv_scan_page(spark, d):
    return scans.page(kv_orders(spark, d).select("key", "value"), 3, PAGE)


@query
def kv_scan_pages_numbered(spark, d):
    return scans.numbered_pages(kv_orders(spark, d).select("key", "value"), PAGE)


@query
def kv_scan_keyset(spark, d):
    return scans.next_page(kv_orders(spark, d).select("key", "value"), "order:0000000500", PAGE)


# ---- commands


def _code():
    """Status of an event as a command, before limits."""
    op = F.create_map(*[F.lit(x) for x in ("click", "GET", "view", "RANGE", "purchase", "PUT", "signup", "DELETE")])
    return F.when(op[F.col("event_type")].isNull(), UNKNOWN).when(op[F.col("event_type")] == "PUT", put_status(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.col("props"), 24)).otherwise(OK)


@query
def kv_status_codes(spark, d):
    return table(spark, d, "events").select(_code().alias("code")).groupBy("code").agg(F.count("*").alias("commands"))


@query
def kv_limited_commands(spark, d):
    """Every command with its status; one that its key's bucket refuses is limited, whatever else it would be."""
    refused = control.bucket_decisions(_requests(spark, d), CAPACITY, INTERVAL_US).where("not allowed").select("seq", F.lit(LIMITED).alias("limited"))
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), _code().alias("own")).join(refused, "seq", "left").select("seq", F.coalesce("limited", "own").alias("code"))


@query
def kv_validate_rejects(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("value"))
    return docs.select("key", put_status(F.col("key"), F.col("value"), PAYLOAD_LIMIT).alias("code")).where("code <> 0")


@query
def kv_crc(spark, d):
    return kv_ops(spark, d).select("key", "value").distinct().select("key", "value", entry_crc(F.col("key"), F.col("value")).alias("crc"))


@query
def kv_crc_quarantine(spark, d):
    stored = table(spark, d, "events").select("event_id", "event_type", "props").join(kv_ops(spark, d), F.col("event_id") == F.col("seq"))
    return stored.where(entry_crc(F.col("key"), F.col("props")) != entry_crc(F.col("key"), F.col("value"))).select("seq", "key", entry_crc(F.col("key"), F.col("value")).alias("crc"))


# ---- memtables and runs


@query
def mem_generations_distinct(spark, d):
    filled = runs.generations(kv_orders_log(spark, d), MEMTABLE)
    return filled.groupBy("gen").agg(F.count("*").alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query
def mem_generations_greedy(spark, d):
    return runs.greedy_generations(kv_ops(spark, d), 16, SHARDS)


def _ops(spark, d):
    return runs.with_gen(kv_ops(spark, d), RUN_OPS)


def _runs(spark, d):
    return runs.flushed(_ops(spark, d))


def _probes(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("user:"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 6, "0")).alias("key"))


@query
def sst_runs(spark, d):
    return _runs(spark, d)


@query
def sst_run_minmax(spark, d):
    return runs.run_bounds(_runs(spark, d))


@query
def sst_merge_runs(spark, d):
    return runs.merge(_runs(spark, d)).select("key", "gen", "seq", "value")


@query
def sst_sparse_index(spark, d):
    return runs.summary(runs.index(_runs(spark, d)), THINNING)


@query
def sst_summary_bracket(spark, d):
    found = _runs(spark, d)
    return runs.bracket(runs.summary(runs.index(found), THINNING), runs.run_bounds(found), _probes(spark, d))


@query
def sst_index_offsets(spark, d):
    return runs.index(_runs(spark, d)).select("gen", "key", "rn", "offset")


@query
def sst_encoded_size(spark, d):
    return _runs(spark, d).groupBy("gen").agg(F.sum(runs.encoded_size()).alias("bytes"), F.count("*").alias("entries"))


@query
def sst_prune_minmax(spark, d):
    return runs.prune_by_bounds(runs.run_bounds(_runs(spark, d)), _probes(spark, d))


@query
def sst_prune_bloom(spark, d):
    return runs.prune_by_bloom(_ops(spark, d), _probes(spark, d), *BLOOM)


@query
def sst_compaction(spark, d):
    return runs.compact(_runs(spark, d), 0, 4)


@query
def sst_compaction_partial(spark, d):
    return runs.compact(_runs(spark, d), 3, 6)


# ---- dictionary and log


@query
def dict_encode(spark, d):
    ops = kv_ops(spark, d)
    return dictionary.encode(ops.select("seq", "key"), dictionary.build(ops))


@query
def dict_decode(spark, d):
    ids = table(spark, d, "supplier").select((F.col("s_suppkey") * 2).cast("bigint").alias("key_id"))
    return ids.select("key_id", F.col("key_id").alias("asked")).transform(lambda x: dictionary.decode(x, dictionary.build(kv_ops(spark, d)))).select(F.col("asked").alias("key_id"), "key")


def _log(spark, d):
    return kv_ops(spark, d).select("seq", "key", "value", F.floor(F.col("seq") / SEGMENT_OPS).alias("segment"))


def _flushed(spark, d):
    """All generations but the last two, which are still memtables."""
    ops = _ops(spark, d).select("seq", "gen")
    newest = ops.agg(F.max("gen").alias("newest"))
    return ops.join(F.broadcast(newest)).where("gen < newest - 1").select("seq")


@query
def wal_expired_segments(spark, d):
    return logs.expired_segments(_log(spark, d), _flushed(spark, d))


@query
def wal_low_watermark(spark, d):
    return logs.low_watermark(_log(spark, d), _flushed(spark, d))


@query
def wal_segment_pack_nominal(spark, d):
    return logs.pack(kv_ops(spark, d), F.lit(HEADER) + F.octet_length("key") + F.octet_length("value"), SEGMENT_BYTES)


@query
def wal_segment_pack_greedy(spark, d):
    return logs.pack_greedy(kv_ops(spark, d), F.octet_length("key") + F.octet_length("value"), BLOCK_BYTES, SEGMENT_BLOCKS, HEADER, SHARDS)


def _crcs(ops):
    return ops.select(entry_crc(F.col("key"), F.col("value")).alias("crc"))


@query
def wal_flushed_add(spark, d):
    ops = _ops(spark, d)
    return logs.add_flushed(_crcs(ops.where("gen < 3")).distinct(), _crcs(ops.where("gen = 3")))


@query
def wal_flushed_remove(spark, d):
    ops = _ops(spark, d)
    return logs.remove_flushed(_crcs(ops.where("gen < 4")).distinct(), _crcs(_log(spark, d).where("segment = 0")))


# ---- the stored log and stored runs: written to the shared folder, then read


def _stored_log(spark, d):
    at = scratch_path(spark, "log")
    store.append_log(kv_ops(spark, d).select("seq", "key", "value", "tombstone"), at, SEGMENT_OPS)
    return at


_ENTRY = ("seq", "key", "value", "tombstone", "crc")


@query
def wal_replay(spark, d):
    return store.replay(spark, _stored_log(spark, d)).select(*_ENTRY)


@query
def wal_replay_segment(spark, d):
    return store.replay(spark, _stored_log(spark, d), 3).select(*_ENTRY)


@query
def wal_quarantine(spark, d):
    """Entries of a stored log whose value was damaged after it was written, every 97th."""
    damaged = store.replay(spark, _stored_log(spark, d)).withColumn("value", F.when(F.col("seq") % 97 == 0, F.concat("value", F.lit("~"))).otherwise(F.col("value")))
    return store.split_corrupt(damaged)[1].select("seq", "key", "crc")


@query
def wal_fragments(spark, d):
    """Texts cut in pieces of so many bytes and put together again."""
    entries = table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("b") / FRAGMENT).cast("int") - 1)
    cut = entries.select("entry_id", "b", F.explode(F.sequence(F.lit(0), last)).alias("frag_no")).select("entry_id", "frag_no", F.substring("b", F.col("frag_no") * FRAGMENT + 1, F.lit(FRAGMENT)).alias("bytes"))
    return store.reassemble(cut).select(F.col("entry_id").alias("doc_id"), F.octet_length("payload").cast("bigint").alias("n_bytes"), F.sha2("payload", 256).alias("sha256"))


@query
def wal_retention(spark, d):
    """The stored log after its segments up to the watermark are deleted."""
    at = _stored_log(spark, d)
    store.delete_segments(spark, at, logs.low_watermark(_log(spark, d), _flushed(spark, d)).first().low_watermark)
    return store.replay(spark, at).select("seq", "key")


@query
def sst_stored_runs(spark, d):
    """Three runs flushed under the next free number, one as a single file; the newest two are read."""
    at, ops = scratch_path(spark, "runs"), _ops(spark, d)
    for _ in range(3):
        gen = store.next_gen(spark, at)
        store.flush_run(ops.where(F.col("gen") == gen), at, gen, single_file=gen == 1)
    return store.runs(spark, at, capacity=2).select(F.col("gen").cast("bigint").alias("gen"), "key", "seq", "value", "tombstone")


@query
def sst_manifest(spark, d):
    """Properties of three runs, one of them merged, read back together with those of the run asked for."""
    at = scratch_path(spark, "manifest")
    for gen in range(3):
        store.describe_run(spark, at, gen, BLOCK_BYTES, merged=gen == 1, compressed=gen == 2)
    asked = store.run_properties(spark, at, 1).select("gen", F.lit(True).alias("asked"))
    return store.run_properties(spark, at).join(F.broadcast(asked), "gen", "left").select("gen", "block_size", "merged", "compressed", F.array_join("components", ",").alias("components"), F.coalesce("asked", F.lit(False)).alias("asked"))


@query
def kv_varint(spark, d):
    x = table(spark, d, "orders").select((F.col("o_orderkey").cast("bigint") * F.col("o_orderkey")).alias("x")).withColumn("data", varint(F.col("x")))
    return x.select("x", F.hex("data").alias("encoded"), varint_value(F.col("data")).alias("decoded"))


# ---- sketches


def _users(spark, d, *more):
    return table(spark, d, "events").select(*more, F.col("user_id").cast("string").alias("item"))


def _asked(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item"))


@query
def bloom_bits(spark, d):
    return sketches.bloom_bits(_users(spark, d), *BLOOM)


@query
def bloom_probe(spark, d):
    return sketches.bloom_probe(sketches.bloom_bits(_users(spark, d), *BLOOM), _asked(spark, d), *BLOOM)


@query
def cms_cells(spark, d):
    return sketches.count_min_cells(_users(spark, d), *COUNT_MIN)


@query
def cms_estimate(spark, d):
    return sketches.count_min_estimate(sketches.count_min_cells(_users(spark, d), *COUNT_MIN), _asked(spark, d), *COUNT_MIN)


@query
def cms_vs_exact(spark, d):
    users = _users(spark, d)
    exact = users.groupBy("item").agg(F.count("*").alias("exact"))
    return sketches.count_min_estimate(sketches.count_min_cells(users, *COUNT_MIN), users, *COUNT_MIN).join(exact, "item").select("item", "exact", "estimate", (F.col("estimate") - F.col("exact")).alias("excess"))


@query
def hll_registers(spark, d):
    return sketches.hll_registers(_users(spark, d), HLL_P)


@query
def hll_estimate(spark, d):
    return sketches.hll_estimate(sketches.hll_registers(_users(spark, d), HLL_P), HLL_P)


@query
def hll_by_group(spark, d):
    items = _users(spark, d, "event_type")
    return sketches.hll_estimate(sketches.hll_registers(items, HLL_P, by=("event_type",)), HLL_P, by=("event_type",))


@query
def approx_distinct_native(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("users"))


@query
def cms_native(spark, d):
    return table(spark, d, "events").agg(F.length(F.count_min_sketch("user_id", F.lit(0.01), F.lit(0.99), F.lit(42))).alias("bytes"))


@query
def doc_tokens_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query
def simhash_docs(spark, d):
    return sketches.simhash(table(spark, d, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))


@query
def simhash_near_dups(spark, d):
    pairs = sketches.near_fingerprints(sketches.simhash(table(spark, d, "documents")), 3)
    a, b = (F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("a", "b"))
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "bits")


# ---- integrity


def _leaves(rows):
    return integrity.leaves(integrity.blocks(rows, "key", ["key", "value"], BLOCK_ROWS))


@query
def merkle_leaves(spark, d):
    return _leaves(kv_orders(spark, d))


@query
def merkle_root(spark, d):
    return integrity.root(_leaves(kv_orders(spark, d)))


@query
def merkle_diff(spark, d):
    """Against a copy in which the most expensive orders have another status."""
    changed = table(spark, d, "orders").select(F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("key"), F.when(F.col("o_totalprice") > 499_000, "X").otherwise(F.col("o_orderstatus")).alias("value"))
    return integrity.diff(_leaves(kv_orders(spark, d)), _leaves(changed))


# ---- control


def _requests(spark, d):
    return as_requests(table(spark, d, "events"))


@query
def token_bucket_decisions(spark, d):
    return control.bucket_decisions(_requests(spark, d), CAPACITY, INTERVAL_US)


@query
def token_bucket_summary(spark, d):
    return control.bucket_summary(control.bucket_decisions(_requests(spark, d), CAPACITY, INTERVAL_US))


@query
def lru_hits(spark, d):
    return control.lru_hits(kv_ops(spark, d).select("seq", "key"), CACHE)


@query
def lru_hit_rate(spark, d):
    return control.hit_rate(control.lru_hits(kv_ops(spark, d).select("seq", "key"), CACHE))


@query
def lru_mixed(spark, d):
    op = F.when(F.col("tombstone"), "DELETE").when(F.col("seq") % 3 == 0, "PUT").otherwise("GET")
    return control.lru_mixed(kv_ops(spark, d).select("seq", "key", op.alias("op")), CACHE // 4, SHARDS)


@query
def fifo_pool(spark, d):
    return control.fifo_hits(kv_ops(spark, d).select("seq", "key"), CACHE // 4, SHARDS)


# ---- streams: every micro-batch that is there is processed, then the result is read


@query
def stream_kv_snapshot(spark, d):
    """The log as a stream, a run flushed for each micro-batch, and the runs merged."""
    at = scratch_path(spark, "stream-snapshot")
    streaming.flush_stream(as_ops(stream_of(spark, d, "events")), f"{at}/runs", f"{at}/checkpoint").awaitTermination()
    return runs.merge(store.runs(spark, f"{at}/runs")).select("key", "value", "seq")


@query
def stream_token_bucket(spark, d):
    """Requests as a stream through buckets kept as state."""
    at = scratch_path(spark, "stream-limit")
    limited = streaming.limit_stream(as_requests(stream_of(spark, d, "events")), CAPACITY, INTERVAL_US)
    limited.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, seq long, allowed boolean").parquet(f"{at}/out")


@query
def stream_windowed_counts(spark, d):
    """Operations a day by event time; the last windows, still open at the watermark, are counted too."""
    at = scratch_path(spark, "stream-counts")
    counts = streaming.windowed_counts(as_ops(stream_of(spark, d, "events")), "1 day", "1 hour").select(F.unix_micros("start").alias("day_us"), "ops", "deletes")
    streaming.write_updates(counts, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return streaming.latest(spark, f"{at}/out", "day_us", "day_us bigint, ops bigint, deletes bigint")
