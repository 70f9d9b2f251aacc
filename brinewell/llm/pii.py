"""Personal data found by weak supervision: regex, gazetteer and context labelers vote on candidate spans.

Candidates come from the four base patterns and from looser ones. Labelers vote for, against or not at all; votes and
a coarse shape make a pattern, and documents shrink to counts of patterns. Expectation-maximisation over those counts
estimates how reliable each labeler is, and a logistic classifier is trained on its posteriors. A span is reported if
it is a base match or the classifier accepts it; accepted spans never replace or overlap base ones.

Only counts of patterns reach the driver, and there are at most PATTERNS of them whatever the input.

Defined cases: a null or empty text has no spans; without candidates nothing is trained and base spans stand alone;
repeated documents count repeatedly; only doc_id and text are read. Offsets are code points of the whole text; texts
are never cut, and the patterns run in linear time on them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.llm.shared import stash, texts

KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "person")
BASE_KINDS = KINDS[:4]
LABELERS = ("regex", "validity", "gazetteer", "context_for", "context_against", "boundary")
SHAPES = 4
PATTERNS = len(KINDS) * 3 ** len(LABELERS) * SHAPES
_AROUND = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Looser candidates than the base patterns.
_SPOKEN_EMAIL = re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}(?!\w)")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ ./-]|[0-9]{3}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_NATIONAL = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_PERSON = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? [A-ZÀ-Þ][\w'-]{1,30}(?: [A-ZÀ-Þ][\w'-]{1,30})?")
_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr", "Mrs")

# Gazetteers.
_TOP_LEVEL = frozenset("com org net edu gov info biz io de fr es it uk eu us ca ch at nl be pl se no dk fi pt cz ru jp cn in br mx au example test".split())
_COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420".split())
_FIRST_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen anna peter hans klaus "
    "ursula monika jean pierre marie claire luc sophie juan carlos maria carmen jose luis ana pablo paul laura martin julia emma lucas leon mia hugo alice".split()
)
_IBAN_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
_FOR = {
    "email": re.compile(r"e-?mail|contact|write|courriel|correo|kontakt", re.I), "ip": re.compile(r"\bip\b|address|server|host|login|adresse", re.I), "card": re.compile(r"card|visa|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|anruf|appel|llam", re.I), "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I), "national_id": re.compile(r"ssn|social|security", re.I), "person": re.compile(r"dear|name|regards|signed|sincerely", re.I),
}
_AGAINST = re.compile(r"version|\bv[0-9]|isbn|issn|\bdoi\b|order (?:no|number)|part (?:no|number)|serial|sku|model|chapter|figure|section", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of the email pattern, from each @ outwards: the pattern itself would retry long words."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by start and then kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _loose(text: str, has_digit: bool) -> Iterator[tuple[str, int, int]]:
    if "at" in text and ("(at)" in text or "[at]" in text or "{at}" in text or " at " in text and (" dot " in text or "dot)" in text or "dot]" in text)):
        yield from (("email", *m.span()) for m in _SPOKEN_EMAIL.finditer(text) if "at)" in m.group() or "at]" in m.group() or "at}" in m.group() or "dot" in m.group())
    if has_digit:
        yield from (("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text))
        yield from (("iban", *m.span()) for m in _IBAN.finditer(text))
        yield from (("national_id", *m.span()) for m in _NATIONAL.finditer(text))
    if any(t in text for t in _TITLES):
        yield from (("person", *m.span()) for m in _PERSON.finditer(text))


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _votes(text: str, kind: str, a: int, b: int, is_base: bool) -> tuple[int, ...]:
    """A vote of each labeler: 1 for, -1 against, 0 none."""
    span, before, after = text[a:b], text[max(0, a - _AROUND) : a], text[b : b + _AROUND]
    digits = _digits(span)
    valid = {
        "email": lambda: 1, "ip": lambda: 1 if is_base else -1, "card": lambda: 1 if is_base else -1, "phone": lambda: 1 if 9 <= len(digits) <= 15 else -1,
        "iban": lambda: 1 if _iban_valid(span) else -1, "national_id": lambda: -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1, "person": lambda: 0,
    }[kind]()
    known = {
        "email": lambda: 1 if re.split(r"[.\s\])}]+", span.lower().rstrip(".)]} "))[-1] in _TOP_LEVEL else -1, "ip": lambda: -1 if span.startswith(("0.", "127.")) else 0, "card": lambda: 1 if digits[0] in "23456" else -1,
        "phone": lambda: (1 if any(digits.startswith(c) for c in _COUNTRY_CODES) else -1) if span[0] == "+" else 0, "iban": lambda: 1 if span[:2] in _IBAN_COUNTRIES else -1, "national_id": lambda: 0,
        "person": lambda: 1 if any(w.lower() in _FIRST_NAMES for w in span.split()[1:]) else 0,
    }[kind]()
    near = before + " " + after
    edge = -1 if before[-1:].isalnum() or after[:1].isalnum() else 1
    return (1 if is_base else 0, valid, known, 1 if _FOR[kind].search(near) else 0, -1 if _AGAINST.search(before) else 0, edge)


def candidates(text: str | None) -> list[tuple[int, int, int, bool, int]]:
    """Spans of a text: kind, start, end, whether it is a base match, pattern (votes and shape)."""
    if not text:
        return []
    base = base_spans(text)
    has_digit = bool(_DIGIT.search(text))
    taken = sorted((a, b) for _, a, b in base)
    loose, k, last = [], 0, -1
    for kind, a, b in sorted(set(_loose(text, has_digit)), key=lambda x: (x[1], KINDS.index(x[0]))):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= last and not any(a < y for x, y in takewhile(lambda s: s[0] < b, islice(taken, k, None))):
            loose.append((kind, a, b))
            last = b
    out = []
    for is_base, spans in ((True, base), (False, loose)):
        for kind, a, b in spans:
            code = 0
            for v in _votes(text, kind, a, b, is_base):
                code = code * 3 + v + 1
            shape = min(SHAPES - 1, (b - a) // 12)
            out.append((KINDS.index(kind), a, b, is_base, code * SHAPES + shape))
    return sorted(out, key=lambda x: (x[1], x[0]))


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier; reliability of each labeler's votes on true and on false spans."""

    weights: np.ndarray | None = None
    reliability: dict[str, tuple[float, float]] = field(default_factory=dict)

    def accepts(self, kinds: np.ndarray, patterns: np.ndarray, threshold: float = 0.5) -> np.ndarray:
        if self.weights is None or not len(kinds):
            return np.zeros(len(kinds), bool)
        return 1 / (1 + np.exp(-_features(kinds, patterns) @ self.weights)) >= threshold


def _unpack(patterns: np.ndarray) -> np.ndarray:
    """Votes (-1, 0, 1) of each labeler."""
    codes = patterns // SHAPES
    return np.stack([codes // 3 ** (len(LABELERS) - 1 - i) % 3 - 1 for i in range(len(LABELERS))], axis=1)


def _features(kinds: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    votes = _unpack(patterns)
    return np.hstack([np.eye(len(KINDS))[kinds], votes > 0, votes < 0, np.eye(SHAPES)[patterns % SHAPES]]).astype(float)


def fit_spans(kinds: np.ndarray, patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> SpanModel:
    """Dawid-Skene over counts of patterns, then logistic regression on the posteriors."""
    if not len(counts):
        return SpanModel()
    votes, counts = _unpack(patterns), counts.astype(float)
    posterior = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))  # begins as a soft majority
    for _ in range(rounds):
        prior = np.array([((posterior * counts)[kinds == k].sum() + 1) / (counts[kinds == k].sum() + 2) for k in range(len(KINDS))])
        log_odds = np.log(prior / (1 - prior))[kinds]
        rates = []
        for i in range(len(LABELERS)):
            table = np.array([[(w * counts)[votes[:, i] == v].sum() + 1 for v in (-1, 1)] for w in (1 - posterior, posterior)])
            table /= table.sum(axis=1, keepdims=True)  # of the votes cast: not to vote says nothing
            against, for_ = np.log(table[1] / table[0])
            log_odds = log_odds + np.where(votes[:, i] > 0, for_, np.where(votes[:, i] < 0, against, 0.0))
            rates.append((float(table[1, 1]), float(table[0, 0])))
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    x, w = _features(kinds, patterns), np.zeros(_features(kinds[:1], patterns[:1]).shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (counts * (posterior - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
    return SpanModel(w, dict(zip(LABELERS, rates, strict=True)))


_SPAN = "struct<kind:int,start:int,end:int,base:boolean,pattern:int>"


def candidate_table(docs: DataFrame) -> DataFrame:
    """doc_id and the candidate spans of every whole text."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32())]))

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "base", "pattern")
        for b in them:
            rows = [[dict(zip(names, c, strict=True)) for c in candidates(x.as_py())] for x in b.column("text")]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "found": pa.array(rows, kind)})

    return texts(docs).mapInArrow(batches, f"doc_id long, found array<{_SPAN}>")


def train_spans(table: DataFrame) -> SpanModel:
    """The model from all candidates of all documents: their patterns are counted before anything reaches the driver."""
    rows = table.select(F.explode("found").alias("x")).groupBy("x.kind", "x.pattern").count().orderBy("kind", "pattern").collect()  # at most PATTERNS rows
    return fit_spans(np.array([r.kind for r in rows], int), np.array([r.pattern for r in rows], int), np.array([r["count"] for r in rows]))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans, array of struct(kind, start, end, base), by start and then kind."""
    table = stash(candidate_table(docs), "pii-candidates")
    model = train_spans(table)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in them:
            rows = []
            for found in b.column("found").to_pylist():
                ok = model.accepts(np.array([x["kind"] for x in found], int), np.array([x["pattern"] for x in found], int))
                rows.append([{"kind": KINDS[x["kind"]], "start": x["start"], "end": x["end"], "base": x["base"]} for x, y in zip(found, ok, strict=True) if x["base"] or y])
            yield pa.record_batch({"doc_id": b.column("doc_id"), "spans": pa.array(rows, kind)})

    return table.mapInArrow(batches, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of base spans, and all spans as a string."""
    found = personal_data(docs)
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
