"""Fixtures, edge cases, and random logs against a dictionary."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from brinewell.functions import trim_space, varint, varint_length, varint_value
from brinewell.functions.ordering import row_numbers, running_sum
from brinewell.operators import control, dictionary, integrity, logs, runs, scans, sketches, versions
from brinewell.plans.options import Options, bloom_size, count_min_size
from brinewell.sources import store, validate

LOG = "seq bigint, key string, value string, tombstone boolean"


def frame(spark, rows, schema=LOG):
    return spark.createDataFrame(rows, schema)


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def random_log(n=400, keys=30, seed=1):
    rng = random.Random(seed)
    return [(i, f"k{rng.randrange(keys):03d}", "" if dead else f"v{i}", dead) for i in range(n) if [dead := rng.random() < 0.3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_log_against_a_dictionary(spark, seed):
    rows = random_log(seed=seed)
    live, masked = {}, set()
    for seq, key, value, dead in rows:
        live.pop(key, None)
        masked.discard(key)
        if dead:
            masked.add(key)
        else:
            live[key] = value
    ops = frame(spark, rows)
    assert values(versions.snapshot(ops), "key", "value") == sorted(live.items())
    assert {r[0] for r in values(versions.deleted_keys(ops), "key")} == masked
    assert values(scans.range_scan(ops, "k005", "k020"), "key") == [(k,) for k in sorted(live) if "k005" <= k <= "k020"]
    assert values(scans.prefix_scan(ops, "k01"), "key") == [(k,) for k in sorted(live) if k.startswith("k01")]
    run_rows = runs.flushed(runs.with_gen(ops, 50))
    assert values(runs.merge(run_rows), "key", "value") == sorted(live.items())
    for low, high in ((0, 3), (2, 5)):
        assert values(runs.merge(runs.compact(run_rows, low, high)), "key", "value") == sorted(live.items())
    status = {r.key: r.status for r in versions.get(ops, [*list(live)[:3], *list(masked)[:2], "nobody"]).collect()}
    assert all(s == (0 if k in live else 5) for k, s in status.items())


def test_delete_masks_older_runs_and_prefix_edges(spark):
    ops = frame(spark, [(0, "a", "1", False), (1, "a￿", "2", False), (2, "ab", "3", False), (3, "b", "4", False), (100, "ab", "", True), (101, "ab", "5", False), (200, "ab", "", True)])
    assert values(scans.prefix_scan(ops, "a"), "key") == [("a",), ("a￿",)]
    assert values(scans.prefix_scan(ops, "a￿"), "key") == [("a￿",)]
    assert values(scans.range_scan(ops, "aa", "zz"), "key") == [("a￿",), ("b",)]
    with pytest.raises(ValueError):
        scans.range_scan(ops, "b", "a")
    assert values(versions.deletes_of_missing(frame(spark, [(1, "x", "", True), (2, "x", "v", False), (3, "x", "", True)])), "seq", "key") == [(1, "x")]


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_pages(spark, size):
    live = frame(spark, [(f"k{i:02d}", str(i)) for i in range(23)], "key string, value string")
    keys = sorted(r.key for r in live.collect())
    paged = {r.key: r.page for r in scans.numbered_pages(live, size).collect()}
    assert paged == {k: i // size + 1 for i, k in enumerate(keys)}
    assert [r.key for r in scans.page(live, 2, size).collect()] == keys[size : 2 * size]
    if size == 7:
        pager = scans.Pager(live, size, 3)
        first, second = pager.next(), pager.next()
        assert [r.key for r in pager.back()] == [r.key for r in first] and [r.key for r in pager.next()] == [r.key for r in second]
        pager.next(), pager.next()
        assert pager.next() == []


def test_validation_codes(spark):
    limit = Options().payload_limit
    assert limit == 100
    ops = frame(spark, [(1, " \t ", "v", False), (2, "k", "", False), (3, "k", "v" * 99, False), (4, "k", "v" * 100, False), (5, "\tk ", "v", False), (6, None, "v", False), (7, "k", None, False)])
    good, bad = validate(ops, limit)
    assert values(bad, "seq", "code") == [(1, 1), (2, 2), (4, 3), (6, 1), (7, 2)]
    assert values(good, "seq", "key") == [(3, "k"), (5, "k")]


def test_scalar_functions(spark):
    df = frame(spark, [(0, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), ((1 << 32) - 1, 5)], "x bigint, n int")
    assert all(r.n == r.got for r in df.select("n", varint_length(F.col("x")).alias("got")).collect())
    assert frame(spark, [("\t a b\n",)], "s string").select(trim_space(F.col("s"))).first()[0] == "a b"


def test_row_numbers_over_many_buckets(spark):
    df = spark.range(5000).select((F.xxhash64("id")).alias("k"), (F.col("id") % 7).alias("v"))
    got = {r.k: (r.rn, r.total) for r in running_sum(row_numbers(df, "k", "rn", buckets=16), "k", F.col("v"), "total", buckets=16).collect()}
    total = 0
    for i, r in enumerate(sorted(df.collect(), key=lambda r: r.k)):
        total += r.v
        assert got[r.k] == (i + 1, total)


def test_memtable_fixture(spark):
    keys = [1, 2, 4, 3, 5, 6, 7, 8, 9, 10, 11]
    ops = frame(spark, [(i, f"{k}", "\0" * k if k < 11 else "", False) for i, k in enumerate(keys)] + [(11, "10", "\0\0", False), (12, "2", "", True), (13, "11", "", True), (14, "asdafas", "", True)])
    newest = {r.key: r for r in versions.newest(ops).collect()}
    assert len(newest["10"].value) == 2 and newest["2"].tombstone and newest["asdafas"].tombstone and len(newest["7"].value) == 7
    gens = values(runs.greedy_generations(frame(spark, [(i, f"{k}", "", False) for i, k in enumerate(keys)]), 4, 1), "seq", "gen")
    assert [g for _, g in gens] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_greedy_generations_against_a_fold(spark):
    rows = random_log(300, 40, 3)
    shard, expected = {}, {}
    got = {(r.shard, r.seq): r.gen for r in runs.greedy_generations(frame(spark, rows), 5, 3).collect()}
    import zlib

    for seq, key, _, _ in rows:
        s = zlib.crc32(key.encode()) % 3
        gen, held = shard.get(s, (0, set()))
        if len(held) >= 5:
            gen, held = gen + 1, set()
        shard[s] = (gen, held | {key})
        expected[s, seq] = gen
    assert got == expected


def test_bloom_and_count_min_fixtures(spark, tmp_path):
    items = frame(spark, [("hello",), ("world",), ("!",)], "item string")
    m, k = bloom_size(100, 0.01)
    assert (m, k) == (959, 7) and bloom_size(6, 0.02) == (49, 6)
    bits = store.save(sketches.bloom_bits(items, m, k), str(tmp_path / "bloom"))
    asked = frame(spark, [("hello",), ("world",), ("!",), ("foo",), ("bar",)], "item string")
    assert {r.item: r.maybe for r in sketches.bloom_probe(bits, asked, m, k).collect()} == {"hello": True, "world": True, "!": True, "foo": False, "bar": False}
    width, depth = count_min_size(0.01, 0.01)
    assert (width, depth) == (272, 6)
    fruit = frame(spark, [(x,) for x in ["apple"] * 3 + ["banana"] * 2 + ["orange"]], "item string")
    cells = store.save(sketches.count_min_cells(fruit, width, depth), str(tmp_path / "cms"))
    wanted = frame(spark, [("apple",), ("banana",), ("orange",), ("grape",)], "item string")
    got = {r.item: r.estimate for r in sketches.count_min_estimate(cells, wanted, width, depth).collect()}
    assert got["apple"] >= 3 and got["banana"] >= 2 and got["orange"] >= 1 and got["grape"] == 0


def test_hyperloglog_fixture(spark, tmp_path):
    items = spark.range(1, 100_000).select(F.col("id").cast("string").alias("item"))
    registers = store.save(sketches.hll_registers(items, 16), str(tmp_path / "hll"))
    estimate = sketches.hll_estimate(registers, 16).first().estimate
    assert abs(estimate - 100_000) < 1000
    half = items.where("cast(item as int) % 2 = 0"), items.where("cast(item as int) % 2 = 1")
    assert sketches.hll_estimate(sketches.hll_merge(*(sketches.hll_registers(h, 16) for h in half)), 16).first().estimate == estimate


def test_simhash_against_python(spark):
    import re

    from brinewell.functions import STOP_WORDS

    texts = ["The quick brown fox", "", "a the an", "fox fox dog fóx _x 9"]

    def expected(text):
        sums = [0] * 64
        for w in re.findall(r"[0-9A-Za-z_]+", text.lower()):
            if w not in STOP_WORDS:
                h = hashlib.md5(w.encode()).digest()
                for i in range(64):
                    sums[i] += 1 if h[i // 8] >> (i % 8) & 1 else -1
        return sum(1 << i for i in range(64) if sums[i] > 0)

    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in sketches.simhash(frame(spark, list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}


def test_merkle_fixture(spark):
    def leaves(data):
        return integrity.leaves(frame(spark, [(i, bytes(d)) for i, d in enumerate(data)], "idx bigint, data binary"))

    a = [[1, 2, 3, 2]] * 5
    b = [[1, 2, 3, 0x12], [1, 2, 3, 2], [0x21, 2, 3, 2], [1, 2, 3, 2]]
    assert values(integrity.diff(leaves(a), leaves(b)), "idx") == [(0,), (2,), (4,)]
    assert values(integrity.diff(leaves(a), leaves(a)), "idx") == []

    def root(data):
        level, n = [hashlib.sha256(b"\1" + bytes(d)).digest() for d in data], 1
        while len(level) > 1:
            n += 1
            level = [hashlib.sha256(bytes([n]) + level[i] + level[i + 1]).digest() if i + 1 < len(level) else hashlib.sha256(bytes([n - 1]) + b"\0" * 32 + level[i]).digest() for i in range(0, len(level), 2)]
        return n, level[0].hex()

    for data in (a, b, a[:1], a[:3]):
        r = integrity.root(leaves(data)).first()
        assert (r.level, r.hash) == root(data)
    levels = integrity.build(leaves(b))
    assert integrity.matches(levels[-1], 0, root(b)[1]).count() == 1


def test_token_bucket_fixture(spark):
    ms = 1000
    requests = frame(spark, [("a", 1, 0, 1), ("a", 2, 0, 1), ("a", 3, 0, 1), ("a", 4, 120 * ms, 1), ("b", 5, 0, 0), ("b", 6, 0, 3), ("b", 7, 0, 2)], "key string, seq bigint, at bigint, n int")
    got = dict(values(control.bucket_decisions(requests, 2, 100 * ms), "seq", "allowed"))
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True}
    assert dict(values(control.bucket_decisions(requests, 0, 100 * ms), "seq", "allowed"))[2] is False


@pytest.mark.parametrize(("capacity", "chunks"), [(1, 4), (5, 16), (50, 8)])
def test_lru_against_one_cache(spark, capacity, chunks):
    rng = random.Random(capacity)
    trace = [(i, f"k{int(rng.expovariate(0.1))}") for i in range(1500)]
    cache = control.LruCache(capacity)
    expected = [(i, cache.get(k)) for i, k in trace]
    assert values(control.lru_hits(frame(spark, trace, "seq bigint, key string"), capacity, chunks), "seq", "hit") == expected


def test_only_held_keys_fill_the_cache(spark):
    rng, store_keys, caches, expected, ops = random.Random(4), set(), {}, [], []
    import zlib

    for i in range(600):
        key, op = f"k{rng.randrange(12)}", rng.choice(["GET", "GET", "GET", "PUT", "DELETE"])
        ops.append((i, key, op))
        cache = caches.setdefault(zlib.crc32(key.encode()) % 2, [])
        hit = key in cache
        if hit:
            cache.remove(key)
        if hit or op == "GET" and key in store_keys:
            cache.append(key)
        del cache[:-3]
        if op == "GET":
            expected.append((i, hit))
        elif op == "PUT":
            store_keys.add(key)
        else:
            store_keys.discard(key)
    got = values(control.lru_mixed(frame(spark, ops, "seq bigint, key string, op string"), 3, 2), "seq", "hit")
    assert got == expected and {h for _, h in got} == {True, False}


def test_dictionary_round_trip(spark):
    ops = frame(spark, random_log(100))
    names = dictionary.build(ops)
    assert values(names, "key_id") == [(i + 1,) for i in range(names.count())]
    assert values(dictionary.decode(dictionary.encode(ops, names), names), "seq", "key") == values(ops, "seq", "key")
    assert dictionary.encode(frame(spark, [("nobody",)], "key string"), names).first().key_id == 0
    assert dictionary.decode(frame(spark, [(10_000,)], "key_id bigint"), names).first().key == ""


def test_watermark_is_an_unbroken_prefix(spark):
    log = frame(spark, [(s * 10 + i, s) for s in range(5) for i in range(3)], "seq bigint, segment bigint")
    flushed = frame(spark, [(s * 10 + i,) for s in (0, 2, 3, 4) for i in range(3)], "seq bigint")
    assert values(logs.expired_segments(log, flushed), "segment") == [(0,), (2,), (3,)]
    assert logs.low_watermark(log, flushed).first().low_watermark == 0
    assert logs.low_watermark(log, flushed.where("seq > 10")).first().low_watermark == -1


def test_store(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "runs")
    rows = random_log(200)
    store.append_log(frame(spark, rows), log, 50)
    store.put(spark, log, 200, "k000", "new", 50)
    store.delete(spark, log, 201, "k001", 50)
    everything = store.replay(spark, log)
    assert everything.count() == 202
    assert values(store.replay(spark, log, 4), "seq") == [(200,), (201,)]
    good, bad = store.split_corrupt(everything.withColumn("value", F.when(F.col("seq") == 200, "bad").otherwise(F.col("value"))))
    assert values(bad, "seq") == [(200,)] and good.count() == 201
    assert store.next_gen(spark, root) == 0
    for gen in range(3):
        store.flush_run(everything.where(f"seq between {gen * 70} and {gen * 70 + 69}"), root, gen, single_file=gen == 1)
    assert store.next_gen(spark, root) == 3
    assert values(runs.merge(store.runs(spark, root)), "key", "value") == values(versions.snapshot(everything), "key", "value")
    assert {r.gen for r in store.runs(spark, root, capacity=2).collect()} == {1, 2}
    assert store.delete_segments(spark, log, 1) == [0, 1]
    assert store.replay(spark, log).count() == 102


def test_fragments(spark):
    parts = frame(spark, [(1, 2, b"c"), (1, 0, b"a\0"), (1, 1, b"b"), (2, 0, b"z")], "entry_id bigint, frag_no int, bytes binary")
    assert {r.entry_id: bytes(r.payload) for r in store.reassemble(parts).collect()} == {1: b"a\0bc", 2: b"z"}


def test_options(tmp_path):
    path = tmp_path / "o.json"
    path.write_text('{"page_size": 9}')
    assert Options.load(str(path)).page_size == 9 and Options.load(str(path)).cache_capacity == 20
    path.write_text('{"colour": 1}')
    with pytest.raises(ValueError):
        Options.load(str(path))


def placed_by_bytes(sizes, block, blocks, header):
    """Start (segment, block, offset) and pieces of entries, writing byte by byte; a segment that an entry overflows is closed."""

    def write(at, offset, size):
        first, pieces, left = None, 0, size
        while True:
            if offset + header > block:
                at, offset = at + 1, 0
            if at >= blocks:
                return None
            first = first or (at, offset)
            pieces, offset = pieces + 1, offset + header
            while left and offset < block:
                left, offset = left - 1, offset + 1
            if not left:
                return first, pieces, at, offset

    segment = at = offset = 0
    for size in sizes:
        done = write(at, offset, size)
        if done is None:
            segment, done = segment + 1, write(0, 0, size)
        first, pieces, at, offset = done
        yield segment, *first, pieces


@pytest.mark.parametrize(("block", "blocks", "header"), [(50, 5, 30), (40, 3, 39), (64, 8, 7)])
def test_greedy_packing_against_bytes(spark, block, blocks, header):
    rng, limit = random.Random(block), blocks * (block - header)
    sizes = [rng.randint(1, limit) if rng.random() < 0.5 else rng.randint(1, max(1, limit // 8)) for _ in range(400)]
    packer = logs.Packer(block, blocks, header)
    expected = list(placed_by_bytes(sizes, block, blocks, header))
    assert [packer.place(n) for n in sizes] == expected
    ops = frame(spark, [(i, "k", "v" * (n - 1), False) for i, n in enumerate(sizes)] + [(400, "k", "v" * limit, False)])
    got = values(logs.pack_greedy(ops, F.octet_length("key") + F.octet_length("value"), block, blocks, header, 1), "seq", "segment", "block", "offset", "pieces")
    assert got == [(i, *e) for i, e in enumerate(expected)]


def test_fifo_pool_against_a_list(spark):
    rng, pool, expected = random.Random(5), [], []
    trace = [(i, f"b{rng.randrange(9)}") for i in range(500)]
    for i, block in trace:
        expected.append((i, block in pool))
        if block not in pool:
            pool = [*pool, block][-4:]
    got = values(control.fifo_hits(frame(spark, trace, "seq bigint, key string"), 4, 1), "seq", "hit")
    assert got == expected and {h for _, h in got} == {True, False}


def test_varint_bytes(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, (1 << 32) - 1, (1 << 63) - 1, -1]

    def encoded(x):
        out, x = [], x & (1 << 64) - 1
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    got = frame(spark, [(x,) for x in numbers], "x bigint").withColumn("data", varint(F.col("x"))).select("x", "data", varint_value(F.col("data")).alias("back")).collect()
    assert {r.x: bytes(r.data) for r in got} == {x: encoded(x) for x in numbers} and all(r.back == r.x for r in got)
    assert frame(spark, [(None,), (b"",)], "b binary").select(varint_value(F.col("b"))).collect() == [(None,), (None,)]


def test_pages_kept_are_bounded_and_not_read_again(spark):
    live = frame(spark, [(f"k{i:02d}", str(i)) for i in range(23)], "key string, value string")
    pager = scans.Pager(live, 5, 2)
    assert pager.back() == []
    pages = [[r.key for r in pager.next()] for _ in range(5)]
    assert pages == [[f"k{i:02d}" for i in range(n, min(n + 5, 23))] for n in range(0, 25, 5)]
    assert pager.next() == [] and pager.number == 5 and sorted(pager.pages) == [4, 5]
    kept = pager.pages[4]
    assert pager.back() is kept
    for n in (3, 2, 1):
        assert [r.key for r in pager.back()] == pages[n - 1] and len(pager.pages) <= 2
    assert pager.back() == [] and [r.key for r in pager.next()] == pages[1]
    nothing = scans.Pager(live.where("false"), 5, 2)
    assert nothing.next() == [] and nothing.back() == [] and nothing.next() == []


def test_flushed_sets_and_run_properties(spark, tmp_path):
    crcs = lambda *x: frame(spark, [(i,) for i in x], "crc bigint")
    assert values(logs.add_flushed(crcs(1, 2), crcs(2, 3, 3)), "crc") == [(1,), (2,), (3,)]
    assert values(logs.remove_flushed(crcs(1, 2, 3), crcs(2, 2, 9)), "crc") == [(1,), (3,)]
    at = str(tmp_path / "manifest")
    store.describe_run(spark, at, 0, 50, merged=False, compressed=True)
    store.describe_run(spark, at, 1, 50, merged=True, compressed=False)
    store.describe_run(spark, at, 1, 60, merged=True, compressed=False)
    assert values(store.run_properties(spark, at), "gen", "block_size", "merged", "compressed") == [(0, 50, False, True), (1, 60, True, False)]
    assert store.run_properties(spark, at, 1).first().components == list(store.MERGED_COMPONENTS)
    path = str(tmp_path / "options.json")
    Options(page_size=7).save(path)
    assert Options.load(path) == Options(page_size=7)
