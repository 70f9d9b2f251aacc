"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of labelled text. A text is parsed greedily into the
longest phrases that occur in the sample; phrases times the logarithm of the sample's length, divided by the text's
length, estimate the cross entropy, and the language with the least wins.

Every letter of the sample is a symbol of its own. An automaton's transitions lie in one array: those of a state are at
its place plus the symbol, interleaved with those of others, and each names the state that owns it; so memory follows
the sample, about 1 MB a language, whatever the alphabet. Texts are parsed in parallel: each is laid out in segments of
SEGMENT symbols, and one look-up moves all segments of a slice of texts by a symbol. Every symbol of a text is parsed.

The sample is bounded by documented parameters: from the labelled documents of a language, one excerpt of EXCERPT
characters for each of EXCERPTS hash buckets, chosen by the hash of doc_id, so it does not depend on partitions. The
driver holds it for all languages (43,000 characters each); no number of them is an error.

Defined cases: a null text or one without letters is `und` with score 0; without any learned language every text is;
equal scores go to the language that sorts first; repeated documents get equal results; labelled rows with a null
doc_id are held out; only doc_id, text and lang are read. Texts are never cut.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.llm.shared import HELD_OUT, fold, texts

EXCERPTS, EXCERPT = 96, 448
SEGMENT = 512
UNDETERMINED = "und"
_SLICE = 3_000_000
#: Symbols with a fixed meaning; letters follow. No sample has the second, which stands for letters not in any.
_SPACE, _OTHER = range(2)
_FREE = -1


def training_sample(docs: DataFrame) -> dict[str, str]:
    """Language: sample. A row for each language and hash bucket reaches the driver, each a bounded excerpt."""
    h = F.xxhash64(F.lit(11), F.col("doc_id").cast("long"))
    text = F.col("text").cast("string")
    start = F.pmod(F.shiftright(h, 20), F.greatest(F.length(text) - EXCERPT, F.lit(1))) + 1
    rows = docs.where(F.col("lang").isNotNull() & text.isNotNull() & (fold("doc_id") != HELD_OUT)).select(
        F.col("lang").cast("string").alias("lang"), F.pmod(h, F.lit(EXCERPTS)).alias("bucket"), h.alias("h"), F.substr(text, start.cast("int"), F.lit(EXCERPT)).alias("excerpt")
    )
    picked = rows.groupBy("lang", "bucket").agg(F.min(F.struct("h", "excerpt")).alias("x")).select("lang", "bucket", "x.excerpt").collect()  # at most EXCERPTS rows a language
    out: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.bucket)):
        out.setdefault(r.lang, []).append(r.excerpt)
    return {lang: "\n".join(x) for lang, x in out.items()}


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a sequence: for each state its transitions, symbol -> next state."""
    nxt: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes:
        new, p = len(nxt), last
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] != size[p] + 1:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return nxt


def interleaved(nxt: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions in one array, and the place of each state in it; no two states share a place.

    Where place + symbol holds the place in its upper half, the lower half is the next state's place; elsewhere the
    state has no such transition. States with most transitions are laid first, single ones into the holes.
    """
    room = sum(map(len, nxt)) + len(nxt) + 2 * width
    owner, place, used, free = [_FREE] * room, [0] * len(nxt), bytearray(room), list(range(room + 1))

    def hole(at: int) -> int:
        """The first free slot from there on."""
        end = at
        while free[end] != end:
            end = free[end]
        while free[at] != end:
            free[at], at = end, free[at]
        return end

    low = {True: 0, False: 0}  # slots below are crowded, for states of many transitions and for others
    for s in sorted(range(len(nxt)), key=lambda s: -len(nxt[s])):
        symbols, many, tries = sorted(nxt[s]), len(nxt[s]) > 1, 0
        first = symbols[0] if symbols else 0
        at = hole(max(low[many], first))
        while True:
            if at + width >= len(owner):
                free += range(len(free), len(free) + room)
                owner += [_FREE] * room
                used += bytearray(room)
            p = at - first
            if not used[p] and all(owner[p + c] == _FREE for c in symbols):
                break
            at, tries = hole(at + 1), tries + 1
        if tries > 4:
            low[many] = max(low[many], at)
        for c in symbols:
            owner[p + c] = p
            free[p + c] = p + c + 1
        used[p], place[s] = 1, p
    top = max(place) + width + 1
    held = np.full(top, -1, np.int64)
    for s, moves in enumerate(nxt):
        for c, t in moves.items():
            held[place[s] + c] = place[s] << 32 | place[t]
    return held, np.array(place, np.int64)


@functools.cache
def _letters() -> np.ndarray:
    """The symbol of every code point, of letters as far as no sample has them."""
    return np.array([_OTHER if chr(i).isalpha() else _SPACE for i in range(0x110000)], np.int32)


class Parser:
    """Cross-parses texts with the automata of all languages; one for each worker process, of the newest sample."""

    _known: dict[str, Parser] = {}

    def __init__(self, sample: dict[str, str]) -> None:
        self.languages = sorted(sample)
        letters = Counter(c for x in sample.values() for c in x.lower() if c.isalpha())
        self.alphabet = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
        self.table = _letters().copy()
        self.table[[ord(c) for c in self.alphabet]] = np.arange(len(self.alphabet)) + _OTHER + 1
        self.width = len(self.alphabet) + _OTHER + 1
        self.held, self.begun, self.start, self.bits = [], [], [], []
        for lang in self.languages:
            codes = self.codes([sample[lang]])[0].tolist()
            nxt = [*automaton(codes), {}]  # the last state ends any phrase; parsing starts there
            held, place = interleaved(nxt, self.width)
            begun = np.full(self.width, place[-1])
            for c, s in nxt[0].items():
                begun[c] = place[s]
            self.held.append(held)
            self.begun.append(begun)
            self.start.append(int(place[-1]))
            self.bits.append(np.log2(len(codes) + 2))

    @classmethod
    def of(cls, sample: dict[str, str]) -> Parser:
        key = hashlib.sha256(repr(sorted(sample.items())).encode()).hexdigest()
        if key not in cls._known:
            cls._known.clear()
            cls._known[key] = cls(sample)
        return cls._known[key]

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, each ending in a space, with runs of non-letters as one space; how many each has."""
        lowered = [x.lower() for x in texts]
        points = np.frombuffer("\n".join(lowered + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[points]
        ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
        space = out == _SPACE
        keep = ~(space & np.r_[True, space[:-1]])
        sums = np.cumsum(keep)[ends - 1]
        return out[keep], np.diff(np.r_[0, sums])

    def rates(self, texts: list[str]) -> np.ndarray:
        """Estimated bits a symbol, of each text (nan without letters) by each language."""
        codes, sizes = self.codes(texts)
        begins = np.cumsum(sizes) - sizes
        segments = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), segments)
        at = begins[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(segments) - segments, segments)) * SEGMENT
        upto = np.minimum(at + SEGMENT, (begins + sizes)[doc])
        order = np.argsort(at - upto, kind="stable")  # long segments first, so that finished ones fall off the end
        doc, at, upto = doc[order], at[order], upto[order]
        lengths = upto - at
        out = np.zeros((len(texts), len(self.languages)))
        state, phrases = np.repeat(np.array(self.start)[:, None], len(doc), axis=1), np.zeros((len(self.languages), len(doc)), np.int32)
        for t in range(int(lengths[0]) if len(doc) else 0):
            n = int(np.searchsorted(-lengths, -t, "left"))
            symbol = codes[at[:n] + t]
            for k, held in enumerate(self.held):
                got = held.take(state[k, :n] + symbol)
                dead = got >> 32 != state[k, :n]
                phrases[k, :n] += dead
                state[k, :n] = np.where(dead, self.begun[k].take(symbol), got & 0xFFFFFFFF)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(doc, phrases[k], len(texts)) * self.bits[k]
        letters = np.bincount(np.repeat(np.arange(len(texts)), sizes), codes != _SPACE, len(texts)) if len(codes) else np.zeros(len(texts))
        out[letters == 0] = np.nan
        return out / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: list[str | None], sharpness: float = 4.0) -> tuple[list[str], np.ndarray]:
        """The best language of each text and a score: a soft maximum over the rates of all languages."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        langs, scores, at = [], [], 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= _SLICE):
                size += len(texts[upto] or "")
                upto += 1
            rates = self.rates([x or "" for x in texts[at:upto]])
            known = ~np.isnan(rates[:, 0])
            best = np.argmin(np.where(known[:, None], rates, 0), axis=1)
            least = rates[np.arange(len(rates)), best]
            with np.errstate(invalid="ignore"):
                share = 1 / np.exp(-sharpness * (rates - least[:, None])).sum(axis=1)
            langs += [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            scores.append(np.where(known, share, 0.0))
            at = upto
        return langs, np.round(np.concatenate(scores), 6) if scores else np.zeros(0)


def predict_languages(docs: DataFrame, sample: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score for every whole text."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser.of(sample)
        for b in them:
            langs, scores = parser.predict(b.column("text").to_pylist())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return texts(docs).mapInArrow(batches, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = predict_languages(docs, training_sample(docs))
    return found.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "lang_pred", "score")
