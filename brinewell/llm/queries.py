"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brinewell.llm.chat import chat_report, probe
from brinewell.llm.decontaminate import find_overlaps
from brinewell.llm.langid import language_report
from brinewell.llm.minhash import fingerprint_report
from brinewell.llm.licenses import license_report
from brinewell.llm.mixture import mixture_report
from brinewell.llm.pii import pii_report
from brinewell.llm.quality import quality_scores
from brinewell.llm.shared import read
from brinewell.llm.simhash import simhash_report
from brinewell.llm.tokenfiles import token_file_report


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(read(spark, sf_dir, "documents"))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(read(spark, sf_dir, "documents"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(read(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_report(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe(spark)))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_report(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_source_mixture": op7_source_mixture,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_token_files": op10_token_files,
}

_SPOKEN = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPE = r"replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"
#: Formatted lengths follow from the template: two marks, role, text and two line breaks for each turn of each example.
SQL: dict[str, str] = {
    "op9_chat_formatting": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {_SPOKEN} UNION ALL SELECT -1, 1, 'assistant', {_SPOKEN}),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS of_all,
  12 + length(replace({_ESCAPE.format("role")}, chr(10), '\\n')) + 1 + length({_ESCAPE.format("text")}) + 10 + 1 AS size FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = of_all THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""".replace("\\\\", "\\"),
}
