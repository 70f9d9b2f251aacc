"""The pipeline's stages, each against the rows its predecessor kept."""

from __future__ import annotations

from collections import Counter

from test_llm import brute_overlaps, shingles

import corpus_pipeline
from brinewell.llm import quality
from brinewell.llm.shared import stash

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stash(stage(spark, kept[-1], SMALL), name))
    rows = [[r.asDict() for r in k.collect()] for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [Counter(r["doc_id"] for r in x) for x in rows]

    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert set(ids[1]) == {k for k, s in scores.items() if s >= 0.3}

    stayed = {r["doc_id"]: r["text"] for r in rows[2]}
    gone = {r["doc_id"]: r["text"] for r in rows[1] if r["doc_id"] not in stayed}
    before = {r["doc_id"]: shingles(r["text"]) for r in rows[1]}
    pairs = [(a, b) for a in before for b in before if b < a and len(before[a] & before[b]) >= 0.8 * len(before[a] | before[b])]
    near = Counter(a for a, _ in pairs)
    assert gone and set(gone) <= set(near) and len(gone) >= 0.9 * len(near)
    assert max(ids[2].values()) == 1 and len(set(stayed.values())) == len(stayed)

    benchmark = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    bad = {k for k, _ in brute_overlaps({r["doc_id"]: r["text"] for r in rows[2] if any(b[:30] in r["text"] for b in benchmark.values())}, benchmark)}
    assert bad and set(ids[3]) == set(ids[2]) - bad

    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 3
    assert ids[5] == ids[4]
    spans = sorted((r["start"], r["n_tokens"]) for r in rows[5])
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0


def test_run_equals_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
