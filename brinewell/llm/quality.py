"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

A document becomes a short vector of statistics (case, symbols, repetition, word shape). Random Fourier features
approximate a Gaussian kernel on the standardised vector; every partition sums its own normal equations, the sums
are added in two levels, and the driver solves one small system. Scores are calibrated by isotonic regression on a
fold that the ridge fit has not seen, from a histogram of fixed size.

Defined cases: a null or empty text has all-zero statistics and gets the score of that vector; several labels for a
document count as several rows; null labels are ignored; without usable training rows every score is 0.5; repeated
documents get equal scores; only doc_id and text are read, so other columns cannot clash. Texts are never cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.llm.shared import FOLDS, HELD_OUT, bound_batches, fold, release_memory, stash, texts

STATS = (
    "log_chars", "log_words", "word_len", "upper", "digit", "symbol", "stop", "space", "line_breaks", "non_ascii",
    "distinct", "adjacent_repeats", "top_word", "long_words", "short_words", "repeated_lines", "word_len_spread",
)
#: Fold of the training rows that calibrates; the other training folds fit the ridge.
CALIBRATION_FOLD = 1
BINS = 2000
#: Labelled rows a task sums, and how many sums of tasks' sums reach the driver.
TASK_ROWS, LANES = 50_000, 32
_UPPER, _DIGIT, _SYMBOL, _STOP, _SPACE, _BREAK, _LETTER, _HIGH = range(8)


def _classes() -> np.ndarray:
    out = np.zeros((8, 256), dtype=np.float32)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            out[_HIGH, b] = 1
        elif c.isalpha():
            out[_LETTER, b] = 1
            out[_UPPER, b] = c.isupper()
        elif c.isdigit():
            out[_DIGIT, b] = 1
        elif c in ".,;:?'\"()-":
            out[_STOP, b] = 1
        elif c == "\n":
            out[_BREAK, b] = out[_SPACE, b] = 1
        elif c.isspace():
            out[_SPACE, b] = 1
        else:
            out[_SYMBOL, b] = 1
    return out


_CLASS = _classes()
_UP_TABLE = {i: None for i in range(128)}


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of STATS."""
    if not text:
        return [0.0] * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    count = _CLASS @ seen.astype(np.float64)
    size = len(raw)
    words = text.split()
    n = len(words)
    if not n:
        return [float(np.log1p(len(text))), *[0.0] * 6, 1.0, *[0.0] * (len(STATS) - 8)]
    lens = np.fromiter(map(len, words), np.int64, n)
    tally = Counter(words)
    upper = count[_UPPER]
    if count[_HIGH]:  # letters outside ASCII have case too
        high = text.translate(_UP_TABLE)
        upper += sum(map(str.isupper, high))
        letters = count[_LETTER] + len(high)
    else:
        letters = count[_LETTER]
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), min(30.0, float(lens.mean())), upper / max(1.0, letters), count[_DIGIT] / size,
        min(2.0, count[_SYMBOL] / n), count[_STOP] / n, count[_SPACE] / size, count[_BREAK] / n, count[_HIGH] / size,
        len(tally) / n**0.9, sum(map(eq, words, words[1:])) / n, max(tally.values()) / n, float((lens > 12).mean()), float((lens <= 3).mean()),
        1 - len(set(lines)) / max(1, len(lines)), min(20.0, float(lens.std())),
    ]


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(x.as_py()) for x in batch.column("text")]
        yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "stats": pa.array(rows, pa.list_(pa.float64()))})
    release_memory()


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the vector of statistics of every whole text."""
    return texts(docs).mapInArrow(_stats_batches, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, the standardised statistics themselves and a constant."""
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        cos = np.sqrt(2 / len(self.shifts)) * np.cos(z @ self.directions + self.shifts)
        return np.hstack([cos, z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(stats):
            return np.full(len(stats), 0.5)
        return np.round(np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1), 6)


def isotonic(centres: np.ndarray, rate: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins in ascending order; returns knots (mean score of a pool) and levels."""
    pools: list[list[float]] = []
    for c, r, w in zip(centres, rate, weight, strict=True):
        pools.append([r * w, w, c * w])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 2] / p[:, 1], (p[:, 0] + 0.0) / p[:, 1]


def fit_quality(stats: DataFrame, labels: DataFrame, n_features: int = 256, bandwidth: float = 4.0, ridge: float = 1e-3, seed: int = 17) -> QualityModel:
    """Fits the model from labelled rows outside the held-out fold. stats: doc_id, stats of all documents."""
    d = len(STATS)
    sums = stats.agg(*[f(F.element_at("stats", i + 1)).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(d)])
    spread = np.array([sums[f"s{i}"] or 0.0 for i in range(d)])
    spread = np.where(spread > 1e-9, spread, 1.0)
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, spread, rng.normal(size=(d, n_features)) / bandwidth, rng.uniform(0, 2 * np.pi, n_features), None, np.zeros(1), np.zeros(1))

    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    train = stash(stats.join(usable.where(fold("doc_id") != HELD_OUT), "doc_id").withColumn("fold", fold("doc_id")), "quality-train")
    size = n_features + d + 1

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = np.zeros((size, size + 1)), 0
        for b in batches:
            if not b.num_rows:
                continue
            x = model.features(np.stack(b.column("stats").to_numpy(zero_copy_only=False)))
            y = b.column("y").to_numpy(zero_copy_only=False)
            gram += x.T @ np.hstack([x, y[:, None]])
            n += len(y)
        if n:
            yield pa.record_batch({"lane": pa.array([TaskContext.get().partitionId() % LANES], pa.int32()), "n": pa.array([n], pa.int64()), "gram": pa.array([gram.tobytes()], pa.binary())})

    def add(pdf):
        total = sum(np.frombuffer(x) for x in pdf["gram"])
        return pdf.iloc[:1].assign(n=int(pdf["n"].sum()), gram=[total.tobytes()])

    schema = "lane int, n long, gram binary"
    tasks = max(LANES, -(-train.count() // TASK_ROWS))  # from the rows alone, so the sums are added alike on any cluster
    parts = train.where(F.col("fold") != CALIBRATION_FOLD).select("stats", "y").repartition(tasks).mapInArrow(normal_equations, schema).groupBy("lane").applyInPandas(add, schema).collect()  # at most LANES rows
    n = sum(r.n for r in parts)
    if not n:
        return model
    gram = sum(np.frombuffer(r.gram) for r in parts).reshape(size, size + 1)
    weights = np.linalg.solve(gram[:, :size] + ridge * n * np.eye(size) * np.r_[np.ones(size - 1), 1e-6], gram[:, size])
    model = QualityModel(model.mean, model.spread, model.directions, model.shifts, weights, model.knots, model.levels)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = model.raw(np.stack(b.column("stats").to_numpy(zero_copy_only=False))) if b.num_rows else np.zeros(0)
            yield pa.record_batch({"bin": pa.array(np.clip((r + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), "y": b.column("y")})

    held = train.where(F.col("fold") == CALIBRATION_FOLD)
    bins = held.select("stats", "y").mapInArrow(raw, "bin int, y double").groupBy("bin").agg(F.count("*").alias("w"), F.avg("y").alias("rate")).orderBy("bin").collect()  # at most BINS rows
    if not bins:  # too few labels for a calibration fold: clipped ridge scores
        return QualityModel(model.mean, model.spread, model.directions, model.shifts, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots, levels = isotonic((np.array([r.bin for r in bins]) + 0.5) * 2 / BINS - 0.5, np.array([r.rate for r in bins]), np.array([float(r.w) for r in bins]))
    return QualityModel(model.mean, model.spread, model.directions, model.shifts, weights, knots, levels)


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score: the calibrated probability that a document would be labelled good."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack(b.column("stats").to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, len(STATS)))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(model.score(x), pa.float64())})

    return stats.mapInArrow(score, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) for every document."""
    stats = stash(document_statistics(docs), "quality-stats")
    scored = score_quality(stats, fit_quality(stats, labels, **fit))
    return scored.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold. Texts are not shuffled: the second pass scores them where they lie."""
    model = fit_quality(stash(document_statistics(docs), "quality-stats"), labels, **fit)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column("text")]).reshape(-1, len(STATS))
            yield b.filter(pa.array(model.score(x) >= threshold))
        release_memory()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(good, docs.schema)


assert FOLDS > 2  # one fold is held out and one calibrates
