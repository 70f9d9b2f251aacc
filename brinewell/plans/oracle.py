"""DuckDB SQL of the registered queries. The parameters repeat those of the catalog as literals."""

from __future__ import annotations

from brinewell.functions import STOP_WORDS, seed_bytes
from brinewell.plans.options import bloom_size, count_min_size

_KV = "kv_ops AS (SELECT event_id AS seq, ts, 'user:' || lpad(user_id::VARCHAR, 6, '0') AS key, CASE WHEN event_type = 'error' THEN '' ELSE props END AS value, event_type = 'error' AS tombstone FROM events)"
_NEWEST = "newest AS (SELECT * FROM kv_ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
_ORDERS = "kv_orders AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS seq, 'order:' || lpad(o_orderkey::VARCHAR, 10, '0') AS key, o_orderstatus AS value, o_totalprice FROM orders)"
_OPS = "ops AS (SELECT *, seq // 1000 AS gen FROM kv_ops)"
_RUNS = "runs AS (SELECT gen, key, seq, value, tombstone FROM ops QUALIFY row_number() OVER (PARTITION BY gen, key ORDER BY seq DESC) = 1)"
_BOUNDS = "bounds AS (SELECT gen, count(*) AS entries, min(key) AS min_key, max(key) AS max_key FROM runs GROUP BY gen)"
_PROBES = "probes AS (SELECT 'user:' || lpad((s_suppkey * 3)::VARCHAR, 6, '0') AS key FROM supplier)"


def _crc(s: str) -> str:
    """CRC-32 of a text: a fold over its bytes."""
    data = f"list_transform(range(1, octet_length(encode({s})) + 1), lambda i: ('0x' || substr(hex(encode({s})), (2 * i - 1)::BIGINT, 2))::UBIGINT)"
    step = "list_reduce(list_concat([xor(a, b)], range(0, 8)::UBIGINT[]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {data}), lambda a, b: {step}), 4294967295::UBIGINT)::BIGINT"


def _varint(x: str) -> str:
    return f"greatest(1, ceil(length(bin(({x})::BIGINT)) / 7.0))::BIGINT"


_CRCS = f"crcs AS (SELECT key, value, {_crc('kv')} AS crc FROM (SELECT DISTINCT key, value, key || value AS kv FROM kv_ops))"
_SIZED = (
    f"sized AS (SELECT r.*, {_varint('c.crc')} + {_varint('r.seq')} + 2 + {_varint('octet_length(encode(r.key))')} + octet_length(encode(r.key)) + CASE WHEN tombstone THEN 0 ELSE {_varint('octet_length(encode(r.value))')} + octet_length(encode(r.value)) END AS size "
    "FROM runs r JOIN crcs c ON r.key = c.key AND r.value = c.value)"
)
_INDEX = "idx AS (SELECT gen, key, row_number() OVER w AS rn, coalesce(sum(size) OVER (PARTITION BY gen ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM sized WINDOW w AS (PARTITION BY gen ORDER BY key))"


def _with(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(parts[:-1]) + " " + parts[-1]


def _slot(item: str, i: int, m: int) -> str:
    seed = "".join(f"\\x{b:02x}" for b in seed_bytes(i))
    return f"(('0x' || substr(md5(encode({item}) || '{seed}'::BLOB), 1, 16))::UBIGINT % {m})::BIGINT"


def _slots(item: str, m: int, k: int) -> str:
    return "[" + ", ".join(_slot(item, i, m) for i in range(k)) + "]"


def _bloom(name: str, source: str, by: str = "") -> str:
    m, k = bloom_size(150, 0.02)
    return f"{name} AS (SELECT DISTINCT {by} unnest({_slots('item', m, k)}) AS bit FROM (SELECT DISTINCT {by} item FROM {source}))"


def _asked(source: str) -> str:
    m, k = bloom_size(150, 0.02)
    return f"asked AS (SELECT item, len(slots) AS n, unnest(slots) AS bit FROM (SELECT item, list_distinct({_slots('item', m, k)}) AS slots FROM (SELECT DISTINCT item FROM {source})))"


_WIDTH, _DEPTH = count_min_size(0.01, 0.01)
_USERS = "users AS (SELECT user_id::VARCHAR AS item, event_type FROM events)"
_CUSTOMERS = "customers AS (SELECT c_custkey::VARCHAR AS item FROM customer)"


def _cells(name: str, source: str, aggregate: bool = True) -> str:
    spread = f"SELECT item, unnest(range(0, {_DEPTH}))::BIGINT AS row, unnest({_slots('item', _WIDTH, _DEPTH)}) AS col, n FROM (SELECT item, count(*) AS n FROM {source} GROUP BY item)"
    return f"{name} AS (SELECT row, col, sum(n)::BIGINT AS count FROM ({spread}) GROUP BY row, col)" if aggregate else f"{name} AS ({spread})"


_REGISTERS = "SELECT {by} (h >> 54)::BIGINT AS bucket, max(CASE WHEN h = 0 THEN 65 ELSE instr(reverse(bin(h)), '1') END)::BIGINT AS rank FROM (SELECT DISTINCT {by} ('0x' || substr(md5(item), 1, 16))::UBIGINT AS h FROM users) GROUP BY {by} bucket"


def _estimate(by: str = "") -> str:
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return (
        f"SELECT {by} registers, round(CASE WHEN raw <= 2560 AND registers < 1024 THEN 1024::DOUBLE * ln(1024::DOUBLE / (1024 - registers)) WHEN raw > pow(2::DOUBLE, 32) / 30 THEN -pow(2::DOUBLE, 32) * ln(1 - raw / pow(2::DOUBLE, 32)) ELSE raw END, 6) AS estimate "
        f"FROM (SELECT {by} count(*) AS registers, (0.7213::DOUBLE / (1 + 1.079::DOUBLE / 1024)) * 1024 * 1024 / ((1024 - count(*)) + sum(pow(2::DOUBLE, -rank))) AS raw FROM regs {group})"
    )


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TOKENS = f"toks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[0-9A-Za-z_]+'), lambda w: NOT list_contains({_STOP}, w)) AS ws FROM documents)"
_BYTE = "('0x' || substr(h, (2 * (i // 8) + 1)::BIGINT, 2))::UBIGINT"
_SIMHASH = (
    "counted AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM toks) GROUP BY doc_id, w), "
    "words AS (SELECT w, md5(w) AS h FROM (SELECT DISTINCT w FROM counted)), "
    f"bits AS (SELECT w, i, ({_BYTE} >> (i % 8)::UBIGINT) & 1 AS bit FROM words, (SELECT unnest(range(0, 64)) AS i)), "
    "sums AS (SELECT doc_id, i, sum(CASE WHEN bit = 1 THEN n ELSE -n END) AS s FROM counted JOIN bits USING (w) GROUP BY doc_id, i), "
    "fps AS (SELECT d.doc_id, coalesce(f.fp, 0)::UBIGINT AS fp FROM documents d LEFT JOIN (SELECT doc_id, sum(CASE WHEN s > 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS fp FROM sums GROUP BY doc_id) f USING (doc_id))"
)


def _leaf(name: str, value: str) -> str:
    return (
        f"{name} AS (SELECT (rn - 1) // 16 AS idx, sha256('\\x01'::BLOB || encode(string_agg(key || chr(1) || v, chr(10) ORDER BY rn))) AS hash FROM "
        f"(SELECT key, {value} AS v, row_number() OVER (ORDER BY key) AS rn FROM kv_orders) GROUP BY idx)"
    )


_LEVELS = (
    "t(lvl, hs) AS (SELECT 1::BIGINT, list(hash ORDER BY idx) FROM leaf UNION ALL SELECT lvl + 1, list_transform(range(1, (len(hs) + 1) // 2 + 1), lambda i: "
    "CASE WHEN 2 * i <= len(hs) THEN sha256(from_hex(lpad(hex(lvl + 1), 2, '0')) || from_hex(hs[2 * i - 1]) || from_hex(hs[2 * i])) "
    "ELSE sha256(from_hex(lpad(hex(lvl), 2, '0')) || from_hex(repeat('00', 32)) || from_hex(hs[2 * i - 1])) END) FROM t WHERE len(hs) > 1)"
)
_REQUESTS = "req AS (SELECT 'user:' || lpad(user_id::VARCHAR, 6, '0') AS key, event_id AS seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type <> 'purchase')"
_GAIN = "(q.us - s.used) // 43200000000"
_BUCKET = (
    "s(key, rn, seq, tokens, used, allowed) AS (SELECT key, rn, seq, 4::BIGINT, us, true FROM req WHERE rn = 1 UNION ALL "
    f"SELECT q.key, q.rn, q.seq, (least(5, s.tokens + {_GAIN}) - CASE WHEN least(5, s.tokens + {_GAIN}) >= 1 THEN 1 ELSE 0 END)::BIGINT, s.used + {_GAIN} * 43200000000, least(5, s.tokens + {_GAIN}) >= 1 FROM s JOIN req q ON q.key = s.key AND q.rn = s.rn + 1)"
)
_LRU = (
    "acc AS (SELECT seq, key, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev FROM kv_ops), "
    "dist AS (SELECT a.seq, count(DISTINCT b.key) AS n FROM acc a JOIN kv_ops b ON b.seq > a.prev AND b.seq < a.seq GROUP BY a.seq), "
    "hits AS (SELECT a.seq, a.key, a.prev IS NOT NULL AND coalesce(d.n, 0) < 20 AS hit FROM acc a LEFT JOIN dist d USING (seq))"
)
_SHARDS = f"shards AS (SELECT key, {_crc('key')} % 8 AS shard FROM (SELECT DISTINCT key FROM kv_ops))"
_HELD = "coalesce(last_value(CASE WHEN op <> 'GET' THEN op = 'PUT' END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"
_TRACE = (
    f"trace AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn FROM (SELECT shard, seq, key, op, {_HELD} AS held, octet_length(encode(key)) + octet_length(encode(value)) AS size "
    "FROM (SELECT *, CASE WHEN tombstone THEN 'DELETE' WHEN seq % 3 = 0 THEN 'PUT' ELSE 'GET' END AS op FROM kv_ops) JOIN shards USING (key)))"
)
_START = "SELECT DISTINCT shard, 0::BIGINT AS rn, 0::BIGINT AS seq"
_STEP = "FROM s JOIN trace q ON q.shard = s.shard AND q.rn = s.rn + 1"
_IN, _LAST = "list_contains(s.keys, q.key)", "list_slice({0}, greatest(1, len({0}) - 4), len({0}))".format("list_append(s.keys, q.key)")
_LRU_MIXED = (
    f"s(shard, rn, seq, op, keys, hit) AS ({_START}, '' AS op, []::VARCHAR[] AS keys, false AS hit FROM trace UNION ALL SELECT q.shard, q.rn, q.seq, q.op, "
    f"CASE WHEN {_IN} THEN list_append(list_filter(s.keys, lambda k: k <> q.key), q.key) WHEN q.op = 'GET' AND q.held THEN {_LAST} ELSE s.keys END, {_IN} {_STEP})"
)
_FIFO = f"s(shard, rn, seq, keys, hit) AS ({_START}, []::VARCHAR[] AS keys, false AS hit FROM trace UNION ALL SELECT q.shard, q.rn, q.seq, CASE WHEN {_IN} THEN s.keys ELSE {_LAST} END, {_IN} {_STEP})"
_GREEDY = (
    f"s(shard, rn, seq, key, gen, keys) AS ({_START}, '' AS key, 0::BIGINT AS gen, []::VARCHAR[] AS keys FROM trace UNION ALL SELECT q.shard, q.rn, q.seq, q.key, CASE WHEN len(s.keys) >= 16 THEN s.gen + 1 ELSE s.gen END, "
    f"CASE WHEN len(s.keys) >= 16 THEN [q.key] WHEN {_IN} THEN s.keys ELSE list_append(s.keys, q.key) END {_STEP})"
)
_MORE = "ceil(greatest(0, size - (482 - p)) / 482.0)::BIGINT"
_PACK = (
    f"s(shard, rn, seq, segment, b, p, size, pieces, eb, ep) AS ({_START}, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM fits UNION ALL "
    f"SELECT shard, rn, seq, segment, b, p, size, {_MORE} + 1, b + {_MORE}, CASE WHEN {_MORE} = 0 THEN p + 30 + size ELSE 30 + size - (482 - p) - ({_MORE} - 1) * 482 END FROM ("
    f"SELECT shard, rn, seq, size, CASE WHEN b + {_MORE} >= 16 THEN segment + 1 ELSE segment END AS segment, CASE WHEN b + {_MORE} >= 16 THEN 0 ELSE b END AS b, CASE WHEN b + {_MORE} >= 16 THEN 0 ELSE p END AS p FROM ("
    "SELECT q.shard, q.rn, q.seq, q.size::BIGINT AS size, s.segment, CASE WHEN s.ep > 482 THEN s.eb + 1 ELSE s.eb END AS b, CASE WHEN s.ep > 482 THEN 0 ELSE s.ep END AS p FROM s JOIN fits q ON q.shard = s.shard AND q.rn = s.rn + 1)))"
)
_FITS = "fits AS (SELECT shard, seq, size, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn FROM trace WHERE size <= 7712)"
_FLUSHED = "SELECT DISTINCT c.crc FROM ops o JOIN crcs c ON o.key = c.key AND o.value = c.value"
_STORED = "SELECT o.seq, o.key, o.value, o.tombstone, c.crc FROM kv_ops o JOIN crcs c ON o.key = c.key AND o.value = c.value"
_CODE = (
    "CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 4 WHEN event_type <> 'purchase' THEN 0 WHEN length(coalesce(props, '')) = 0 THEN 2 "
    "WHEN octet_length(encode('user:' || user_id::VARCHAR)) + octet_length(encode(props)) > 24 THEN 3 ELSE 0 END"
)
_DIGIT = "lpad(hex(((x >> (7 * i)) & 127) + CASE WHEN i < n - 1 THEN 128 ELSE 0 END), 2, '0')"
_LOG = "log AS (SELECT seq, seq // 400 AS segment FROM kv_ops), done AS (SELECT seq FROM ops WHERE gen < (SELECT max(gen) FROM ops) - 1)"
_EXPIRED = "expired AS (SELECT segment, count(*) AS entries FROM log LEFT JOIN done USING (seq) WHERE segment < (SELECT max(segment) FROM log) GROUP BY segment HAVING count(*) = count(done.seq))"
_DICT = "dict AS (SELECT key, row_number() OVER (ORDER BY s) AS key_id FROM (SELECT key, min(seq) AS s FROM kv_ops GROUP BY key))"
_BRACKET = "max(CASE WHEN s.key <= p.key THEN s.key END) AS lower, min(CASE WHEN s.key > p.key THEN s.key END) AS upper"
_CHOSEN = "best AS (SELECT * FROM runs WHERE gen BETWEEN {low} AND {high} QUALIFY row_number() OVER (PARTITION BY key ORDER BY gen DESC) = 1)"


def _compaction(low: int, high: int) -> str:
    keep = f"(NOT tombstone OR {low} > (SELECT min(gen) FROM runs))"
    return _with(_KV, _OPS, _RUNS, _CHOSEN.format(low=low, high=high), f"SELECT {high}::BIGINT AS gen, key, seq, value, tombstone FROM best WHERE {keep} UNION ALL SELECT gen, key, seq, value, tombstone FROM runs WHERE gen NOT BETWEEN {low} AND {high}")


def _get(keys: tuple[str, ...]) -> str:
    rows = ", ".join(f"('{k}')" for k in keys)
    return _with(_KV, _NEWEST, f"SELECT w.key, n.value, CASE WHEN n.seq IS NULL THEN 5 ELSE 0 END AS status FROM (VALUES {rows}) w(key) LEFT JOIN (SELECT * FROM newest WHERE NOT tombstone AND length(value) > 0) n ON n.key = w.key")


SQL: dict[str, str] = {
    "kv_snapshot": _with(_KV, _NEWEST, "SELECT key, value, seq FROM newest WHERE NOT tombstone"),
    "kv_get_point": _get(("user:000042",)),
    "kv_multi_get": _get(("user:000001", "user:000007", "user:000042", "user:000149", "user:999999")),
    "kv_snapshot_as_of": _with(_KV, "SELECT key, value, seq FROM (SELECT * FROM kv_ops WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone"),
    "kv_version_history": _with(_KV, "SELECT key, seq, value, tombstone, row_number() OVER w AS version, lag(seq) OVER w AS prev_seq, lead(seq) OVER w AS next_seq FROM kv_ops WINDOW w AS (PARTITION BY key ORDER BY seq)"),
    "kv_deleted_keys": _with(_KV, _NEWEST, "SELECT key, seq FROM newest WHERE tombstone"),
    "kv_delete_of_missing": _with(_KV, "SELECT seq, key FROM kv_ops o WHERE tombstone AND NOT EXISTS (SELECT 1 FROM kv_ops p WHERE p.key = o.key AND NOT p.tombstone AND p.seq < o.seq)"),
    "kv_range_scan": _with(_KV, _NEWEST, "SELECT key, value FROM newest WHERE NOT tombstone AND key BETWEEN 'user:000020' AND 'user:000060'"),
    "kv_prefix_scan": "SELECT url AS key, page_id::VARCHAR AS value FROM pages WHERE starts_with(url, 'https://') QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1",
    "kv_scan_page": _with(_ORDERS, "SELECT key, value FROM kv_orders ORDER BY key LIMIT 100 OFFSET 200"),
    "kv_scan_pages_numbered": _with(_ORDERS, "SELECT key, value, (seq - 1) // 100 + 1 AS page FROM kv_orders"),
    "kv_scan_keyset": _with(_ORDERS, "SELECT key, value FROM kv_orders WHERE key > 'order:0000000500' ORDER BY key LIMIT 100"),
    "kv_status_codes": (
        "SELECT CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 4 WHEN event_type <> 'purchase' THEN 0 WHEN length(coalesce(props, '')) = 0 THEN 2 "
        "WHEN octet_length(encode('user:' || user_id::VARCHAR)) + octet_length(encode(props)) > 24 THEN 3 ELSE 0 END AS code, count(*) AS commands FROM events GROUP BY code"
    ),
    "kv_validate_rejects": "SELECT key, code FROM (SELECT 'doc:' || doc_id::VARCHAR AS key, CASE WHEN length(coalesce(text, '')) = 0 THEN 2 WHEN octet_length(encode('doc:' || doc_id::VARCHAR)) + octet_length(encode(text)) > 4096 THEN 3 ELSE 0 END AS code FROM documents) WHERE code <> 0",
    "kv_crc": _with(_KV, _CRCS, "SELECT key, value, crc FROM crcs"),
    "kv_crc_quarantine": _with(_KV, _CRCS, "SELECT o.seq, o.key, c.crc FROM kv_ops o JOIN crcs c ON o.key = c.key AND o.value = c.value JOIN events e ON e.event_id = o.seq WHERE e.props <> o.value"),
    "mem_generations_distinct": _with(_ORDERS, "SELECT (seq - 1) // 500 AS gen, count(*) AS entries, min(key) AS min_key, max(key) AS max_key FROM kv_orders GROUP BY gen"),
    "sst_runs": _with(_KV, _OPS, _RUNS, "SELECT gen, key, seq, value, tombstone FROM runs"),
    "sst_run_minmax": _with(_KV, _OPS, _RUNS, _BOUNDS, "SELECT * FROM bounds"),
    "sst_merge_runs": _with(_KV, _OPS, _RUNS, "SELECT key, gen, seq, value FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY gen DESC) = 1) WHERE NOT tombstone"),
    "sst_sparse_index": _with(_KV, _OPS, _RUNS, _CRCS, _SIZED, _INDEX, 'SELECT gen, key, rn, "offset" FROM idx WHERE (rn - 1) % 8 = 0'),
    "sst_summary_bracket": _with(
        _KV, _OPS, _RUNS, _BOUNDS, _PROBES, "smp AS (SELECT gen, key FROM (SELECT gen, key, row_number() OVER (PARTITION BY gen ORDER BY key) AS rn FROM runs) WHERE (rn - 1) % 8 = 0)",
        f"SELECT b.gen, p.key, {_BRACKET} FROM probes p JOIN bounds b ON p.key BETWEEN b.min_key AND b.max_key JOIN smp s ON s.gen = b.gen GROUP BY b.gen, p.key",
    ),
    "sst_index_offsets": _with(_KV, _OPS, _RUNS, _CRCS, _SIZED, _INDEX, 'SELECT gen, key, rn, "offset" FROM idx'),
    "sst_encoded_size": _with(_KV, _OPS, _RUNS, _CRCS, _SIZED, "SELECT gen, sum(size)::BIGINT AS bytes, count(*) AS entries FROM sized GROUP BY gen"),
    "sst_prune_minmax": _with(_KV, _OPS, _RUNS, _BOUNDS, _PROBES, "SELECT p.key, b.gen FROM probes p JOIN bounds b ON p.key BETWEEN b.min_key AND b.max_key"),
    "sst_prune_bloom": _with(
        _KV, _OPS, _PROBES, "it AS (SELECT gen, key AS item FROM ops), pr AS (SELECT key AS item FROM probes)", _bloom("bits", "it", "gen,"), _asked("pr"),
        "SELECT item AS key, gen FROM asked JOIN bits USING (bit) GROUP BY item, n, gen HAVING count(*) = n",
    ),
    "sst_compaction": _compaction(0, 4),
    "sst_compaction_partial": _compaction(3, 6),
    "dict_encode": _with(_KV, _DICT, "SELECT seq, key_id FROM kv_ops JOIN dict USING (key)"),
    "dict_decode": _with(_KV, _DICT, "SELECT (s_suppkey * 2)::BIGINT AS key_id, coalesce(d.key, '') AS key FROM supplier LEFT JOIN dict d ON d.key_id = s_suppkey * 2"),
    "wal_expired_segments": _with(_KV, _OPS, _LOG, _EXPIRED, "SELECT segment, entries FROM expired"),
    "wal_low_watermark": _with(_KV, _OPS, _LOG, _EXPIRED, "SELECT coalesce(max(segment), -1)::BIGINT AS low_watermark FROM log WHERE segment < (SELECT min(segment) FROM log WHERE segment NOT IN (SELECT segment FROM expired))"),
    "wal_segment_pack_nominal": _with(
        _KV, "z AS (SELECT seq, (30 + octet_length(encode(key)) + octet_length(encode(value)))::BIGINT AS size FROM kv_ops)",
        'SELECT seq, size, o AS "offset", o // 65536 AS segment FROM (SELECT seq, size, coalesce(sum(size) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM z)',
    ),
    "bloom_bits": _with(_USERS, _bloom("bits", "users"), "SELECT bit FROM bits"),
    "bloom_probe": _with(_USERS, _CUSTOMERS, _bloom("bits", "users"), _asked("customers"), "SELECT item, count(bits.bit) = any_value(n) AS maybe FROM asked LEFT JOIN bits USING (bit) GROUP BY item"),
    "cms_cells": _with(_USERS, _cells("cells", "users"), "SELECT row, col, count FROM cells"),
    "cms_estimate": _with(_USERS, _CUSTOMERS, _cells("cells", "users"), _cells("asked", "customers", False), "SELECT a.item, min(coalesce(c.count, 0))::BIGINT AS estimate FROM asked a LEFT JOIN cells c ON a.row = c.row AND a.col = c.col GROUP BY a.item"),
    "cms_vs_exact": _with(
        _USERS, _cells("cells", "users"), _cells("asked", "users", False),
        "SELECT a.item, any_value(a.n) AS exact, min(coalesce(c.count, 0))::BIGINT AS estimate, (min(coalesce(c.count, 0)) - any_value(a.n))::BIGINT AS excess FROM asked a LEFT JOIN cells c ON a.row = c.row AND a.col = c.col GROUP BY a.item",
    ),
    "hll_registers": _with(_USERS, _REGISTERS.format(by="")),
    "hll_estimate": _with(_USERS, f"regs AS ({_REGISTERS.format(by='')})", _estimate()),
    "hll_by_group": _with(_USERS, f"regs AS ({_REGISTERS.format(by='event_type,')})", _estimate("event_type, ")),
    "doc_tokens_clean": _with(_TOKENS, "SELECT doc_id, len(ws)::BIGINT AS tokens FROM toks"),
    "simhash_docs": _with(_TOKENS, _SIMHASH, "SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint FROM fps"),
    "simhash_near_dups": _with(
        _TOKENS, _SIMHASH, "nodes AS (SELECT DISTINCT fp FROM fps)",
        "SELECT lpad(lower(hex(a.fp)), 16, '0') AS a, lpad(lower(hex(b.fp)), 16, '0') AS b, bit_count(xor(a.fp, b.fp))::BIGINT AS bits FROM nodes a JOIN nodes b ON a.fp < b.fp WHERE bit_count(xor(a.fp, b.fp)) <= 3",
    ),
    "merkle_leaves": _with(_ORDERS, _leaf("leaf", "value"), "SELECT 1::BIGINT AS level, idx, hash FROM leaf"),
    "merkle_root": _with(_ORDERS, _leaf("leaf", "value"), _LEVELS, "SELECT lvl AS level, hs[1] AS hash FROM t WHERE len(hs) = 1", recursive=True),
    "merkle_diff": _with(_ORDERS, _leaf("x", "value"), _leaf("y", "CASE WHEN o_totalprice > 499000 THEN 'X' ELSE value END"), "SELECT coalesce(x.idx, y.idx) AS idx FROM x FULL JOIN y ON x.idx = y.idx WHERE x.hash IS DISTINCT FROM y.hash"),
    "token_bucket_decisions": _with(_REQUESTS, _BUCKET, "SELECT key, seq, allowed FROM s", recursive=True),
    "token_bucket_summary": _with(_REQUESTS, _BUCKET, "SELECT key, count(*) AS requests, sum(allowed::BIGINT)::BIGINT AS allowed, sum((NOT allowed)::BIGINT)::BIGINT AS denied FROM s GROUP BY key", recursive=True),
    "lru_hits": _with(_KV, _LRU, "SELECT seq, key, hit FROM hits"),
    "lru_hit_rate": _with(_KV, _LRU, "SELECT count(*) AS gets, sum(hit::BIGINT)::BIGINT AS hits, round(avg(hit::INTEGER), 6) AS hit_rate FROM hits"),
}
SQL |= {
    "kv_limited_commands": _with(_REQUESTS, _BUCKET, f"SELECT e.event_id AS seq, CASE WHEN NOT s.allowed THEN 6 ELSE {_CODE} END AS code FROM events e LEFT JOIN s ON s.seq = e.event_id", recursive=True),
    "kv_varint": f"SELECT x, array_to_string(list_transform(range(0, n), lambda i: {_DIGIT}), '') AS encoded, x AS decoded FROM (SELECT x, {_varint('x')} AS n FROM (SELECT o_orderkey::BIGINT * o_orderkey AS x FROM orders))",
    "mem_generations_greedy": _with(_KV, _SHARDS, _TRACE, _GREEDY, "SELECT shard, seq, key, gen FROM s WHERE rn > 0", recursive=True),
    "lru_mixed": _with(_KV, _SHARDS, _TRACE, _LRU_MIXED, "SELECT shard, seq, hit FROM s WHERE op = 'GET'", recursive=True),
    "fifo_pool": _with(_KV, _SHARDS, _TRACE, _FIFO, "SELECT shard, seq, hit FROM s WHERE rn > 0", recursive=True),
    "wal_segment_pack_greedy": _with(_KV, _SHARDS, _TRACE, _FITS, _PACK, 'SELECT shard, seq, segment, b AS block, p AS "offset", pieces FROM s WHERE rn > 0', recursive=True),
    "wal_flushed_add": _with(_KV, _OPS, _CRCS, f"{_FLUSHED} WHERE gen < 4"),
    "wal_flushed_remove": _with(_KV, _OPS, _CRCS, f"{_FLUSHED} WHERE gen < 4 EXCEPT {_FLUSHED} WHERE o.seq < 400"),
    "wal_replay": _with(_KV, _CRCS, _STORED),
    "wal_replay_segment": _with(_KV, _CRCS, f"{_STORED} WHERE o.seq // 400 = 3"),
    "wal_quarantine": _with(_KV, _CRCS, f"SELECT seq, key, crc FROM ({_STORED}) WHERE seq % 97 = 0"),
    "wal_fragments": "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "wal_retention": _with(_KV, _OPS, _LOG, _EXPIRED, "SELECT seq, key FROM kv_ops WHERE seq // 400 > coalesce((SELECT max(segment) FROM log WHERE segment < (SELECT min(segment) FROM log WHERE segment NOT IN (SELECT segment FROM expired))), -1)"),
    "sst_stored_runs": _with(_KV, _OPS, _RUNS, "SELECT gen, key, seq, value, tombstone FROM runs WHERE gen IN (1, 2)"),
    "sst_manifest": (
        "SELECT gen::BIGINT AS gen, 512::BIGINT AS block_size, gen = 1 AS merged, gen = 2 AS compressed, CASE WHEN gen = 1 THEN 'data,blocksize,merge,compression' ELSE 'data,index,summary,metadata,bloomfilter,blocksize,merge,compression' END AS components, "
        "gen = 1 AS asked FROM (VALUES (0), (1), (2)) g(gen)"
    ),
    "stream_kv_snapshot": SQL["kv_snapshot"],
    "stream_token_bucket": SQL["token_bucket_decisions"],
    "stream_windowed_counts": "SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS day_us, count(*) AS ops, sum((event_type = 'error')::BIGINT)::BIGINT AS deletes FROM events GROUP BY 1",
}
