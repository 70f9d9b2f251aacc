"""Rows that share a doc_id or have none: no clean one is lost, no copy stays, and no source misses its target."""

from __future__ import annotations

import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F
from test_llm import DOC, frame

from brinewell.llm import decontaminate, mixture, simhash


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))


def rows(pairs):
    return [(i, t, "en", "s", 1) for i, t in pairs]


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_duplicates_keep_what_differs(spark):
    a, b, c, d = (text(i) for i in range(4))
    near = b + " more"
    made = [(1, a), (1, b), (2, b), (2, b), (None, c), (None, c), (None, d), (5, near), (None, a), (7, None), (7, None), (None, None), (8, "")]
    got = kept(simhash.keep_one_of_each(frame(spark, rows(made), DOC)))
    assert sum(got.values()) == 5 and max(got.values()) == 1
    assert set(got) == {(1, a), (1, b), (None, c), (None, d), (7, None)}
    same_but = frame(spark, [(1, a, "en", "s", 1), (1, a, "de", "t", 2)], DOC)
    assert simhash.keep_one_of_each(same_but).count() == 1


def test_decontamination_drops_rows_by_their_own_text(spark):
    items = frame(spark, [(1, text(1, 20)), (2, "alpha beta gamma delta epsilon"), (3, "too short")], "item_id long, text string")
    bad, short, clean = text(9) + " " + text(1, 20), "x alpha beta gamma delta epsilon y", text(8)
    made = [(None, bad), (None, clean), (4, clean), (4, bad), (5, short), (6, "too short to count"), (4, bad)]
    docs = frame(spark, rows(made), DOC).withColumns({c: F.lit("x") for c in ("key_hi", "words", "item_id")})
    assert kept(decontaminate.drop_contaminated(docs, items)) == Counter([(None, clean), (4, clean), (6, "too short to count")])
    assert sorted((r.doc_id is None, r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs, items).collect()) == [(False, 4, 1), (False, 5, 2), (True, None, 1)]


@pytest.mark.parametrize(("words", "changed"), [(15, 3), (20, 4), (40, 8)])
def test_substitutions_up_to_the_similarity_are_found(spark, words, changed):
    rng, items, docs = random.Random(words), [], []
    for i in range(120):
        item = text(1000 + i, words).split()
        items.append((i, " ".join(item)))
        for at in rng.sample(range(words), changed):
            item[at] = "other"
        docs.append((i, f"{text(2000 + i, 30)} {' '.join(item)} {text(3000 + i, 30)}"))
    got = {r.doc_id for r in decontaminate.find_overlaps(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")).where("doc_id = item_id").collect()}
    assert len(got) >= 118


def taken_and_targets(docs):
    got = mixture.mixture_report(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.target, []).append(r.taken)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    return got, {t: sum(x) for t, x in by.items()}


@pytest.mark.parametrize("case", ["no ids", "one id", "one row"])
def test_targets_are_met_whatever_the_ids(spark, case):
    made = [(i, text(i, 20), "en", "b", 1) for i in range(100)]
    for i in range(50):
        made.append((None if case == "no ids" else 1000, text(5000 if case == "one row" else i + 5000, 10), "en", "a", 1))
    docs = frame(spark, made, DOC).withColumn("members", F.lit("x"))
    got, sums = taken_and_targets(docs)
    assert len(got) == 150 and len(sums) == 2 and all(abs(n - t) <= 0.03 * t for t, n in sums.items())
    again = mixture.mixture_report(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    stage = mixture.take_mix(docs)
    assert stage.columns == docs.columns
    assert Counter(len(t.split()) for (t,) in stage.select("text").collect()) == {n: sum(r.taken for r in got if r.size == n) // n for n in (10, 20)}


def test_more_sources_than_the_network_takes(spark):
    made = [(i, text(i, 1 + i % 13), "en", None if i % 41 == 0 else f"s{i % 41:02d}", 1) for i in range(800)]
    docs = frame(spark, made, DOC)
    few, wide = (Counter(map(tuple, mixture.mix(docs, max_patterns=n).select("doc_id", "source_size", F.round("target", 6), "taken").collect())) for n in (10_000, 5))
    assert few == wide
    overlaps = docs.withColumn("own", F.when(F.col("doc_id") % 100 == 7, F.array(F.lit("s01"), F.lit("s02"))))
    few, wide = (mixture.mix(overlaps, max_patterns=n, members="own").agg(F.sum("taken")).first()[0] for n in (10_000, 8))
    assert abs(few - wide) <= 0.01 * few
    with pytest.raises(ValueError, match="overlapping"):
        mixture.mix(overlaps, max_patterns=2, members="own")


def cheapest(patterns, quotas, costs):
    """The least total by trying every way to send words."""
    ways = []
    for members, size in patterns:
        ways.append([dict(zip(sorted(members), n, strict=True)) for n in product(range(size * len(costs) + 1), repeat=len(members)) if sum(n) <= size * len(costs)])
    best = None
    for choice in product(*ways):
        got = Counter()
        for w in choice:
            got.update(w)
        if any(got[s] > q for s, q in enumerate(quotas)):
            continue
        total = 0
        for (_, size), w in zip(patterns, choice, strict=True):
            n = sum(w.values())
            for c in costs:
                total += c * min(size, n)
                n -= min(size, n)
        total += 100 * sum(q - got[s] for s, q in enumerate(quotas))
        best = total if best is None else min(best, total)
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 3)
        patterns = [(frozenset(rng.sample(range(n), rng.randint(1, min(2, n)))), rng.randint(0, 2)) for _ in range(rng.randint(1, 3))]
        quotas = [rng.randint(0, 6) for _ in range(n)]
        flows, total, got = mixture.min_cost_flow(patterns, quotas), 0, Counter()
        for (_, size), f in zip(patterns, flows, strict=True):
            got.update(f)
            left = sum(f.values())
            for c in mixture.REPEAT_COSTS:
                total += c * min(size, left)
                left -= min(size, left)
        total += 100 * sum(q - got[s] for s, q in enumerate(quotas))
        assert total == cheapest(patterns, quotas, mixture.REPEAT_COSTS)
