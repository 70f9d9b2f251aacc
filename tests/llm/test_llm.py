"""The training-data operators against brute force, exact round trips and held-out rows, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brinewell.llm import chat, decontaminate, langid, licenses, minhash, mixture, pii, quality, queries, simhash, tokenfiles
from brinewell.llm.components import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a very long one, ties, repeated rows, null ids and sources, and columns named as the operators name theirs."""
    long = "alpha beta gamma delta " * 12_000
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "  \n\t", None, "a", 3), (4, "one", "en", "b", 3), (5, long, "en", "a", len(long)), (6, long, "en", "b", len(long)),
        (7, "same words here now", "de", "a", 1), (7, "same words here now", "de", "a", 1), (None, "no id at all", "de", "b", 1), (8, "ÀÉ ünïcode ĀŞ 中文 é", None, None, None), (9, "!!! ... 123", "fr", "c", 5),
    ]
    extra = ["members", "key_hi", "_key_hi", "_id", "near", "root", "row", "many", "score", "fp", "bucket", "words", "part", "_size", "_drop", "key", "i", "n", "stats", "seed", "_row", "_repeats", "component_id", "taken", "ids", "target"]
    return frame(spark, rows).withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


# ---- all of them on odd rows


def odd_results(odd, labels, benchmark, path):
    return {
        "quality": lambda d: quality.quality_scores(d, labels),
        "decontaminate": lambda d: decontaminate.find_overlaps(d, benchmark),
        "licenses": licenses.license_report,
        "simhash": simhash.simhash_report,
        "langid": langid.language_report,
        "pii": pii.pii_report,
        "mixture": mixture.mixture_report,
        "minhash": minhash.fingerprint_report,
        "tokens": lambda d: tokenfiles.token_file_report(d, path),
        "keep_good": lambda d: quality.keep_good(d, labels),
        "keep_one": simhash.keep_one_of_each,
        "drop_contaminated": lambda d: decontaminate.drop_contaminated(d, benchmark),
        "take_mix": mixture.take_mix,
    }


@pytest.mark.parametrize("name", ["quality", "decontaminate", "licenses", "simhash", "langid", "pii", "mixture", "minhash", "tokens", "keep_good", "keep_one", "drop_contaminated", "take_mix"])
def test_odd_rows_and_empty_tables(spark, odd, labels, name):
    import public_tokenizers

    benchmark = frame(spark, [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (2, None), (3, "")], "item_id long, text string")
    run = odd_results(odd, labels, benchmark, public_tokenizers.path("word_bpe_49k.json"))[name]
    rows = run(odd).collect()
    if name in ("keep_good", "keep_one", "drop_contaminated", "take_mix"):
        assert set(rows[0].asDict()) == set(odd.columns) and all(r.score == "x" and r._size == "x" for r in rows)
    elif name != "decontaminate":
        assert len(rows) == odd.count()
    assert run(odd.limit(0)).count() == 0


def test_everything_empty(spark, odd, labels):
    assert quality.quality_scores(odd, labels.limit(0)).where("score <> 0.5").count() == 0
    assert decontaminate.find_overlaps(odd, frame(spark, [], "item_id long, text string")).count() == 0
    assert chat.chat_report(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 1


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got["predicted"] == got["quality"]).mean()) > 0.95
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()


def test_quality_against_a_plain_fit(spark):
    """One dense system, and isotonic levels by their min-max formula."""
    import zlib

    d = "/root/testdata/sf0.01"
    documents, marks = (spark.read.parquet(f"{d}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    x = np.array([quality.statistics(t) for t in documents["text"]])
    ids = documents["doc_id"].tolist()
    quality_of = {int(k): float(q) for k, q in zip(marks["doc_id"], marks["quality"], strict=True) if q == q}
    part = lambda k: zlib.crc32(str(k).encode()) % 5
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    rng = np.random.default_rng(17)
    directions, shifts = rng.normal(size=(x.shape[1], 256)) / 4.0, rng.uniform(0, 2 * np.pi, 256)
    z = np.clip((x - mean) / spread, -6, 6)
    f = np.hstack([np.sqrt(2 / 256) * np.cos(z @ directions + shifts), z, np.ones((len(z), 1))])
    fit = [i for i, k in enumerate(ids) if k in quality_of and part(k) not in (0, 1)]
    held = [i for i, k in enumerate(ids) if k in quality_of and part(k) == 1]
    penalty = np.sqrt(1e-3 * len(fit) * np.r_[np.ones(f.shape[1] - 1), 1e-6])
    weights = np.linalg.lstsq(np.vstack([f[fit], np.diag(penalty)]), np.r_[[quality_of[ids[i]] for i in fit], np.zeros(f.shape[1])], rcond=None)[0]
    raw = f @ weights
    bins = {}
    for i in held:
        bins.setdefault(int(np.clip((raw[i] + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1)), []).append(quality_of[ids[i]])
    order = sorted(bins)
    y, w = np.array([np.mean(bins[b]) for b in order]), np.array([float(len(bins[b])) for b in order])
    average = lambda a, b: (y[a:b] * w[a:b]).sum() / w[a:b].sum()
    levels = np.array([max(min(average(a, b) for b in range(i + 1, len(y) + 1)) for a in range(i + 1)) for i in range(len(y))]).round(12)
    centre = (np.array(order) + 0.5) * 2 / quality.BINS - 0.5
    pools = [np.flatnonzero(levels == v) for v in np.unique(levels)]
    scores = np.interp(raw, [(centre[p] * w[p]).sum() / w[p].sum() for p in pools], [levels[p[0]] for p in pools])
    got = {r.doc_id: r.score for r in queries.op1_quality_classifier(spark, d).collect()}
    assert len(got) == len(ids)
    assert np.mean([abs(got[k] - s) < 1e-3 for k, s in zip(ids, scores, strict=True)]) > 0.98


def test_quality_does_not_learn_from_held_out_labels(spark, docs, labels):
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, wrong))
    assert all(abs(a[k] - b[k]) < 1e-4 for k in a)


def test_isotonic():
    knots, levels = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert levels.tolist() == [0, 0.5, 1] and knots.tolist() == [0, 1.5, 3]


# ---- 2


def brute_overlaps(texts, items, window=decontaminate.WINDOW, share=decontaminate.MIN_SIMILARITY):
    word = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    docs, bench, out = {k: word(t) for k, t in texts.items()}, {k: word(t) for k, t in items.items()}, set()
    for i, item in bench.items():
        least, wanted = (7, share) if len(item) >= 7 else (len(item), 1.0)
        if len(item) < decontaminate.SHORTEST_ITEM:
            continue
        for k, d in docs.items():
            size = min(window, len(item), len(d))
            for shift in range(-len(item) + size, len(d) - size + 1):
                same = [0 <= p + shift < len(d) and d[p + shift] == item[p] for p in range(len(item))]
                run = [0 <= p + shift < len(d) for p in range(len(item))]
                if size >= least and any(sum(same[s : s + size]) >= wanted * size and all(run[s : s + size]) for s in range(len(item) - size + 1)):
                    out.add((k, i))
                    break
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = {i: " ".join(rng.choices(vocabulary, k=rng.choice([4, 5, 6, 8, 15, 25, 40]))) for i in range(12)}
    texts = {}
    for k in range(60):
        body = rng.choices(vocabulary, k=rng.choice([0, 30]))
        if k % 3:
            words = items[rng.randrange(12)].split()
            for j in rng.sample(range(len(words)), k % 5 * len(words) // 40):
                words[j] = "other"
            body[5:5] = [w.upper() + "," for w in words]
        texts[k] = " ".join(body)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(frame(spark, list(texts.items()), "doc_id long, text string"), frame(spark, list(items.items()), "item_id long, text string")).collect()}
    expected = brute_overlaps(texts, items)
    assert got <= expected and len(got) >= 0.98 * len(expected) and expected
    blocks = decontaminate.find_overlaps(frame(spark, list(texts.items()), "doc_id long, text string"), frame(spark, list(items.items()), "item_id long, text string"), block_seeds=200)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got


# ---- 3


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_places(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places = sorted((i, label) for label, phrase in licenses.BASE for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_license_places_against_brute_force(spark, texts):
    rng = random.Random(1)
    parts = ["mit", "MIT", " ", "license", "License", ".", "apache", "general", "public", "é", "\n", "x", "{", "İ", "9"]
    texts = dict(texts) | {10_000 + i: "".join(rng.choices(parts, k=30)) for i in range(2000)}
    for r in licenses.license_report(frame(spark, list(texts.items()), "doc_id long, text string")).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_places(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}), ("Licensed under the Apache License,\n Version 2.0", {"apache-2.0"}), ("under CC BY-NC 4.0.", {"cc-by-nc-4.0"}), ("see https://opensource.org/licenses/MIT", {"mit"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}), ("nothing of the kind", set()), ("Mozilla Public\nLicense 2.0", {"mpl-2.0"}), ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
    ],
)
def test_license_rules(text, labels):
    assert {d[1] for d in licenses.detect(text.encode().lower())[1]} == labels


def test_license_gates_hold():
    assert len(licenses.rules()) >= 300 and all(k and k == k.lower() for r in licenses.rules() for k in r.keywords)


# ---- 4


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """Representative of each fingerprint by single linkage."""
    fps, parent = list(fps), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    return {x: find(x) for x in fps}


def test_simhash_against_brute_force(spark, docs, texts):
    fps = {k: brute_fingerprint(t) for k, t in texts.items()}
    roots, least = brute_components(set(fps.values())), {}
    for k, f in fps.items():
        least[roots[f]] = min(k, least.get(roots[f], k))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_report(docs).collect()}
    assert got == {k: (f"{f:016x}", least[roots[f]]) for k, f in fps.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_brute_force(spark, seed):
    rng, fps = random.Random(seed), set()
    for n in (1, 3, 30, 200):
        cluster = [rng.getrandbits(64)]
        for _ in range(n):
            x = rng.choice(cluster)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            cluster.append(x)
        fps |= set(cluster)
    shared = rng.getrandbits(22)
    fps |= {rng.getrandbits(42) << 22 | shared for _ in range(200)}
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    groups, got = {}, {}
    for x, r in brute_components(fps).items():
        groups.setdefault(r, set()).add(signed[x])
    for r in simhash.link_components(frame(spark, [(x,) for x in signed.values()], "fp long")).collect():
        got.setdefault(r.comp, set()).add(r.fp)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values())) and all(c == min(g) for c, g in got.items())


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (1, 0)]
    got = {r.node: r.root for r in connected_components(frame(spark, edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}


# ---- 5


def test_cross_parsing_against_brute_force(texts):
    sample = {"x": "the cat sat on the mat and the dog sat too", "y": "le chat est sur la table et le chien aussi"}
    parser = langid.Parser(sample)

    def phrases(codes, model):
        n = 0
        for at in range(0, len(codes), langid.SEGMENT):
            part, i = codes[at : at + langid.SEGMENT], 0
            while i < len(part):
                size = 1
                while i + size < len(part) and part[i : i + size + 1] in model:
                    size += 1
                i, n = i + (size if part[i] in model else 1), n + 1
        return n

    as_text = lambda t: "".join(map(chr, parser.codes([t])[0]))
    for t in list(texts.values())[:25]:
        rates = parser.rates([t])[0]
        code = as_text(t)
        assert [round(r * len(code) / b) for r, b in zip(rates, parser.bits, strict=True)] == [phrases(code, as_text(sample[k])) for k in parser.languages]


def test_interleaved_transitions():
    rng = random.Random(3)
    for width, n in ((5, 200), (3000, 4000), (60, 3000)):
        nxt = langid.automaton([rng.randrange(width) for _ in range(n)])
        held, place = langid.interleaved(nxt, width)
        assert len(set(place.tolist())) == len(place) and len(held) < 4 * (n + width) + 2 * sum(map(len, nxt))
        for s, moves in enumerate(nxt):
            row = held[place[s] : place[s] + width]
            mine = np.flatnonzero(row >> 32 == place[s])
            assert {int(c): int(row[c] & 0xFFFFFFFF) for c in mine} == {c: int(place[x]) for c, x in moves.items()}


def test_three_hundred_languages_and_rare_letters(spark):
    """Every language has words of its own; half of them letters of its own that are rare over all."""
    rng = random.Random(7)
    words = {}
    for k in range(300):
        letters = "abcdefghijklmnop" if k % 2 else [chr(0x4E00 + 60 * k + i) for i in range(60)]
        words[f"l{k:03d}"] = ["".join(rng.choices(letters, k=rng.randint(3, 6))) for _ in range(40)]
    rows = [(i * 300 + k, " ".join(rng.choices(words[lang], k=30)), lang) for i in range(10) for k, lang in enumerate(words)]
    got = langid.language_report(frame(spark, rows, "doc_id long, text string, lang string")).where("held_out").collect()
    lang = {r[0]: r[2] for r in rows}
    assert len(got) > 400 and sum(r.lang_pred == lang[r.doc_id] for r in got) > 0.98 * len(got)


def test_scripts_mixed_in_one_sample(spark):
    """Thousands of letters in one language leave the others theirs."""
    rng = random.Random(8)
    scripts = {"zh": [chr(0x4E00 + i) for i in range(3000)], "ja": [chr(0x3041 + i) for i in range(80)] + [chr(0x4E00 + i) for i in range(0, 3000, 3)], "el": [chr(0x3B1 + i) for i in range(24)], "ru": [chr(0x430 + i) for i in range(32)], "uk": [*map(chr, range(0x430, 0x448)), *"іїєґ"]}
    rows = [(5 * i + k, " ".join("".join(rng.choices(x, k=4)) for _ in range(25)), lang) for i in range(60) for k, (lang, x) in enumerate(scripts.items())]
    got = langid.language_report(frame(spark, rows, "doc_id long, text string, lang string")).where("held_out").collect()
    lang = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) > 0.95 * len(got)


def test_languages_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op5_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_of_nothing(spark, odd):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_report(odd).collect()}
    assert all(got[k] == ("und", 0.0) for k in (1, 2, 3, 9)) and got[4][0] != "und"


# ---- 6


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_against_brute_force(texts):
    rng = random.Random(2)
    for i in range(20_000):
        t = "".join(rng.choices("ab.@-+%0123456789 ()é٣" + ("@@..a" if i % 3 else "00000..255"), k=rng.randint(0, 60)))
        assert pii.base_spans(t) == brute_pii(t)
    for t in texts.values():
        assert pii.base_spans(t) == brute_pii(t)


def test_pii_report(spark, docs, texts):
    plain = "Contact: john.doe (at) mail (dot) com or call (030) 555-1234, IBAN DE89 3704 0044 0532 0130 00. Dear Mr. John Smith"
    with_more = docs.select("doc_id", "text").unionByName(frame(spark, [(10**6, plain), (10**6 + 1, None)], "doc_id long, text string"))
    texts = dict(texts) | {10**6: plain, 10**6 + 1: ""}
    for r in pii.pii_report(with_more).collect():
        base = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in pii.BASE_KINDS)
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)
        if r.doc_id == 10**6:
            assert {s.split(":")[0] for s in spans} == {"email", "phone", "iban", "person"}


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 70_000, "Mr. " * 50_000, "AB12" * 50_000):
        pii.candidates(t)


# ---- 7


def test_targets():
    assert mixture.targets([100, 100, 100], [5, 2, 1], 300) == [187.5, 75.0, 37.5]
    assert mixture.targets([10, 1000, 1000], [5, 2, 1], 2010) == [30.0, 1320.0, 660.0]
    assert sum(mixture.targets([5, 7, 900, 3], [5, 2, 1, 5], 915)) == pytest.approx(915)


def test_nearest_subset():
    rng = random.Random(3)
    for _ in range(200):
        sizes, goal = [rng.randrange(0, 30) for _ in range(rng.randrange(0, 9))], rng.randrange(0, 120)
        got = sum(s for s, t in zip(sizes, mixture.nearest_subset(sizes, goal), strict=True) if t)
        sums = {0}
        for s in sizes:
            sums |= {x + s for x in sums}
        assert abs(got - goal) == min(abs(x - goal) for x in sums if x <= 2 * goal)


def test_flow_spreads_before_it_repeats():
    flows = mixture.min_cost_flow([(frozenset({0}), 10), (frozenset({0, 1}), 10), (frozenset({1}), 10)], [20, 10])
    assert [sum(f.values()) for f in flows] == [10, 10, 10]
    assert mixture.min_cost_flow([(frozenset({0}), 10)], [25]) == [{0: 25}] and mixture.min_cost_flow([(frozenset({0}), 10)], [99]) == [{0: 30}]


def test_mixture(spark, docs, texts):
    got = mixture.mixture_report(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixture.mixture_report(docs.repartition(7)).collect()))
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in texts.items()}
    total = Counter()
    for k, n in size.items():
        total[source[k]] += n
    names = sorted(total)
    goal = dict(zip(names, mixture.targets([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], sum(total.values())), strict=True))
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size, r.target) == (size[r.doc_id], total[s], pytest.approx(goal[s])) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.03 * goal[s] for s in names)
    stage = Counter(r.doc_id for r in mixture.take_mix(docs).select("doc_id").collect())
    assert stage == Counter({r.doc_id: r.taken // r.size for r in got if r.taken})


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, None, ["a"] if i < 50 else ["b"] if i < 80 else ["a", "b"]) for i in range(100)]
    got = mixture.mix(frame(spark, rows, "doc_id long, text string, source string, members array<string>"), members="members").collect()
    assert len(got) == 100 and abs(sum(r.taken for r in got) - 1000) <= 20


# ---- 8


def shingles(t):
    words = t.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_minhash_against_jaccard(docs, texts):
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    errors = []
    for r in minhash.fingerprint_report(docs).collect():
        t, n = texts[r.doc_id], texts[after[r.doc_id]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, got in ((edited, r.near_edited), (n, r.near_next)):
            a, b = shingles(t), shingles(other)
            errors.append(got - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05 and np.abs(errors).max() < 0.2


def test_minhash_next_across_buckets(spark):
    rows = [(i * i % 997 if i else None, f"text {i % 50} " * (i % 9)) for i in range(300)] + [(-5, "first"), (2000, "last")]
    got = minhash.with_next(frame(spark, rows, "doc_id long, text string"), bucket_rows=10).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = Counter((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == expected
    same = {}
    for r in got:
        assert same.setdefault(r.text, r.fp) == r.fp and same.setdefault(r.next_text, r.next_fp) == r.next_fp


def test_minhash_of_nothing(spark):
    got = minhash.fingerprint_report(frame(spark, [(1, ""), (2, None), (3, "a b")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.near_edited, r.near_next) for r in got] == [(1.0, 1.0), (1.0, 0.0), (got[2].near_edited, 0.0)] and set(got[0].fingerprint) == {"0"} and len(got[2].fingerprint) == minhash.BINS


# ---- 9


def test_chat_round_trip(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (-2, 0, "us\ner\\", "a\\n<|x\\|<|"), (-2, 1, "assistant", "\\<|\\n\n"), (-2, 2, None, None), (-3, 0, "assistant", ""), (-3, 0, "assistant", "b"), (-4, None, "user", "é")]
    conversations = frame(spark, rows, "conv_id long, turn long, role string, text string")
    by, examples = {}, {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    for r in chat.expand(conversations).orderBy("example").collect():
        examples.setdefault(r.conv_id, []).append(r)
    for c, turns in by.items():
        replies = [i for i, t in enumerate(turns) if t[0] == "assistant"]
        assert [r.turns - 1 for r in examples[c] if r.loss_start is not None] == replies
        for r in examples[c]:
            assert chat.parse(r.text) == turns[: r.turns]
            assert r.loss_start is None or chat.unescape(r.text[r.loss_start : r.loss_end]) == turns[r.turns - 1][1]
    for r in chat.chat_report(conversations).collect():
        turns = by[r.conv_id]
        reply = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(reply), hashlib.sha256(reply.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(e.text) for e in examples[r.conv_id])


def test_chat_against_sql(spark):
    from oracle import rows_of, sql_rows

    assert rows_of(queries.QUERIES["op9_chat_formatting"](spark, SMALL)) == sql_rows(queries.SQL["op9_chat_formatting"], SMALL)


# ---- 10


@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_pieces_give_the_ids_of_whole_texts(tokenizer_path):
    from tokenizers import Tokenizer

    rng, whole = random.Random(1), Tokenizer.from_file(tokenizer_path)
    letters = [*"abc ABCÀÉñ'sStre.,!?0123½²ªµ\n\t ŒœĀāŞ­´¨İıſΣ<|>\xa0\x85\x0b\x1c中é̀'", "<|endoftext|>", "'re", "'LL ", "don't", "  "]
    texts = ["".join(rng.choices(letters[:38] if i % 2 else letters, k=rng.randint(0, 40))) for i in range(4000)]
    encoder, got = tokenfiles.Encoder(open(tokenizer_path).read()), []
    for ids, counts in encoder.encode(pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_get_whole_texts(tokenizer_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    rules = json.loads(open(tokenizer_path).read())
    assert tokenfiles.Encoder(json.dumps(rules)).by_pieces
    cased = rules | {"normalizer": {"type": "NFC"}}
    texts = ["Hello  World, it's ME\n\n  42 times", "", None, "don't STOP", "  lead and trail "]
    for other in (json.dumps(cased), open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()):
        encoder, whole, got = tokenfiles.Encoder(other), Tokenizer.from_str(other), []
        assert not encoder.by_pieces
        for ids, counts in encoder.encode(pa.array(texts)):
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(spark, docs, texts, tokenizer_path, tmp_path):
    from tokenizers import Tokenizer

    whole, start, expected, stream = Tokenizer.from_file(tokenizer_path), 0, {}, []
    for k in sorted(texts):
        ids = [*whole.encode(texts[k], add_special_tokens=False).ids, tokenfiles.END_ID]
        expected[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    folder = str(tmp_path / "files")
    tokenfiles.write_token_files(docs, folder, open(tokenizer_path).read(), seq_len=128, partition_bytes=100_000)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_token_files(spark, folder).collect()} == expected
    flat = []
    for path in sorted((tmp_path / "files").glob("*.arrow")):
        with pa.memory_map(str(path)) as source:
            table = pa.ipc.open_file(source).read_all()
            assert table.schema.field("input_ids").type.list_size == 128 == table.schema.field("mask").type.list_size
            ids, mask = (np.array(table[c].combine_chunks().flatten()) for c in ("input_ids", "mask"))
            flat += ids[mask].tolist()
    assert flat == stream
