"""Licence detection by ordered signature rules.

Hundreds of hand-written patterns are gated: a text is searched for a few stems first, then a rule runs only where its
keyword occurs. Rules have a priority by kind; of overlapping detections, those of higher priority and then longer ones
come first, and a detection inside an accepted one is suppressed. Base phrases are rules too, but are never suppressed.

Texts are scanned as UTF-8 bytes with A-Z in lower case, so places don't move. Words are runs of a-z, 0-9 and bytes
outside ASCII. Any run of other bytes may stand between the words of a rule, however long.

Scanning takes n log n of a text's length: a rule of words is tried only at words that begin like one of its matches,
runs between words are matched without going back, and suppression is one sweep over detections by start.

Defined cases: a null or empty text has no words and no detections, score 0 and null words; ties are broken by start,
then label; repeated documents get equal results; only doc_id and text are read. Texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.llm.license_rules import FAMILIES, PHRASES
from brinewell.llm.shared import texts

BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
_SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
_WORD = np.zeros(256, bool)
_WORD[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
#: Order of kinds: the first outranks the rest.
PRIORITY = {"tag": 0, "phrase": 1, "address": 2, "name": 3}
#: Keywords of names that have several forms, by the start of their label.
SHORT = (("cc", (b"commons", b"cc-by", b"cc by", b"cc0")), ("gpl", (b"gpl", b"public")), ("lgpl", (b"lgpl", b"public")), ("agpl", (b"agpl", b"affero")))
_SCORE = {"tag": 1.0, "address": 0.9, "name": 0.85}


#: Bytes by which a word is matched with the beginnings of rules.
_HEAD = 3


@dataclass(frozen=True)
class Rule:
    kind: str
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    score: float
    #: Beginnings that a match may have, of _HEAD bytes; none for rules that may begin within a word.
    heads: frozenset[bytes] = frozenset()


def _compiled(pattern: str, whole_words: bool = True) -> re.Pattern[bytes]:
    body = pattern.encode()
    for mark, times in ((b"[- ]?", b"*+"), (b"[ -]?", b"*+"), (b"[- ]", b"++"), (b" ?", b"*+"), (b" ", b"++")):
        body = body.replace(mark, _SEP + times)
    return re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + body + rb")(?![0-9a-z\x80-\xff])" if whole_words else body, re.S)


def _heads(pattern: re.Pattern[bytes]) -> frozenset[bytes]:
    """All beginnings of _HEAD bytes that a match may have, by partial matching; a separator stands for all of them."""
    body = regex.compile(pattern.pattern, regex.S)
    grown = {b""}
    for _ in range(_HEAD):
        grown = {h + bytes([c]) for h in grown for c in _ALPHABET if body.match(h + bytes([c]), partial=True)}
    return frozenset(grown)


_ALPHABET = [*b"abcdefghijklmnopqrstuvwxyz0123456789 ", *range(0x80, 0x100)]


def _literal(pattern: str) -> bytes:
    """The longest run of a pattern, within a word, that every match must contain."""
    flat = re.sub(r"\\.", lambda m: m[0][1] if m[0][1] in "./+" else "\n", pattern)
    depth, runs, now = 0, [], ""
    for i, c in enumerate(flat):
        depth += (c in "([{") - (c in ")]}")
        if depth or c in ")]}?*+|\n " or flat[i + 1 : i + 2] in ("?", "*", "{"):
            runs.append(now)
            now = ""
        else:
            now += c
    return max([*runs, now], key=len).encode()


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules, ordered by priority, in the order they are written."""
    out = []
    for line in FAMILIES.strip().splitlines():
        label, name, tag, address = line.split(" | ")
        out.append(Rule("name", label, next((k for start, k in SHORT if label.startswith(start)), (_literal(name),)), p := _compiled(name), _SCORE["name"], _heads(p)))
        if tag != "-":
            out.append(Rule("tag", label, (b"spdx",), _compiled(rf"spdx-license-identifier:\s*+\(?(?:{tag})(?![\w.+-])", False), _SCORE["tag"]))
        if address.strip() != "-":
            out.append(Rule("address", label, (_literal(address.strip()),), _compiled(address.strip(), False), _SCORE["address"]))
    for line in PHRASES.strip().splitlines():
        label, keyword, pattern, score = line.split(" | ")
        out.append(Rule("phrase", label, (max(keyword.split(), key=len).encode(),), p := _compiled(pattern), float(score), _heads(p)))
    return tuple(sorted(out, key=lambda r: PRIORITY[r.kind]))


@lru_cache(1)
def _prepared():
    base = [(label, phrase.split()[0].encode(), re.compile(rb"(?<![0-9a-z\x80-\xff])" + (_SEP + b"+").join(w.encode() for w in phrase.split()) + rb"(?![0-9a-z\x80-\xff])")) for label, phrase in BASE]
    keywords = [k for r in rules() for k in r.keywords] + [b"license"]
    by: dict[tuple[bytes, ...], list[Rule]] = {}
    for r in rules():
        by.setdefault(r.keywords, []).append(r)
    return base, tuple(by.items()), tuple(k for k in dict.fromkeys(keywords) if not any(o in k and o != k for o in keywords))


Detection = tuple[str, str, int, int, float]


def _word_starts(raw: bytes) -> np.ndarray:
    """Places of the first bytes of words."""
    word = _WORD[np.frombuffer(raw, np.uint8)]
    return np.flatnonzero(word & ~np.r_[False, word[:-1]]) if len(raw) else np.zeros(0, np.int64)


def _word_matches(raw: bytes, starts: np.ndarray, those: list[Rule]) -> Iterator[Detection]:
    """Leftmost matches, without overlaps of one rule, of rules that begin with a word."""
    by: dict[int, list[int]] = {}
    for i, r in enumerate(those):
        for h in r.heads:
            by.setdefault(int.from_bytes(h, "big"), []).append(i)
    data = np.frombuffer(raw + b" " * _HEAD, np.uint8)
    flat = np.where(_WORD[data], data, 0x20).astype(np.int32)
    codes = (flat[starts] << 16) | (flat[starts + 1] << 8) | flat[starts + 2]
    known = np.array(sorted(by), np.int32)
    near = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    free = [0] * len(those)
    hit = known[near] == codes
    for at, code in zip(starts[hit].tolist(), codes[hit].tolist(), strict=True):
        for i in by[code]:
            if at >= free[i] and (m := those[i].pattern.match(raw, at)):
                r, free[i] = those[i], m.end()
                yield r.kind, r.label, at, m.end(), r.score


def _outermost(found: list[Detection]) -> list[Detection]:
    """Detections that lie in none of higher priority, nor in a longer one of their own kind; of equal ones the first label."""
    out, reach = [], [-1] * len(PRIORITY)  # the farthest end so far, by kind
    for d in sorted(found, key=lambda d: (d[2], -d[3], PRIORITY[d[0]], d[1])):
        k = PRIORITY[d[0]]
        if max(reach[: k + 1]) < d[3]:
            out.append(d)
        reach[k] = max(reach[k], d[3])
    return sorted(out, key=lambda d: (d[2], d[1]))


def detect(raw: bytes, starts: np.ndarray | None = None) -> tuple[list[tuple[str, int, int]], list[Detection]]:
    """Base places (label, start, end) and accepted detections (kind, label, start, end, score) of a text's lower-cased bytes."""
    base, gated, stems = _prepared()  # every keyword contains a stem
    if not any(s in raw for s in stems):
        return [], []
    places = [(label, *m.span()) for label, first, p in base if first in raw and b"license" in raw for m in p.finditer(raw)]
    those = [r for keywords, some in gated if any(k in raw for k in keywords) for r in some]
    found = [(r.kind, r.label, *m.span(), r.score) for r in those if not r.heads for m in r.pattern.finditer(raw)]
    if of_words := [r for r in those if r.heads]:
        found += _word_matches(raw, _word_starts(raw) if starts is None else starts, of_words)
    return sorted(places, key=lambda x: x[1:]), _outermost(found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base: array of struct(label, word), detections: array of struct(kind, label, first_byte, end_byte, score)."""
    base_kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("score", pa.float64())]))
    names = ("kind", "label", "first_byte", "end_byte", "score")

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in them:
            counts, bases, found = [], [], []
            for x in b.column("text"):
                raw = (x.as_py() or "").encode("utf-8", "surrogatepass").lower()
                starts = _word_starts(raw)
                places, detections = detect(raw, starts)
                counts.append(len(starts))
                words = np.searchsorted(starts, [a for _, a, _ in places]).tolist()
                bases.append([{"label": label, "word": w} for (label, _, _), w in zip(places, words, strict=True)])
                found.append([dict(zip(names, d, strict=True)) for d in detections])
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "base": pa.array(bases, base_kind), "detections": pa.array(found, kind)})

    schema = "doc_id long, n_words long, base array<struct<label:string,word:bigint>>, detections array<struct<kind:string,label:string,first_byte:bigint,end_byte:bigint,score:double>>"
    return texts(docs).mapInArrow(batches, schema)


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan(docs)
    words, base = F.col("base.word"), F.col("base.label")
    score = F.greatest(F.coalesce(F.array_max("detections.score"), F.lit(0.0)), F.when(F.size("base") > 0, 0.8).otherwise(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.col("detections.label")))), ",").alias("labels"), score.alias("score"),
    )
