"""Document quality: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

cos(w.x + b) with Gaussian w and uniform b has the Gaussian kernel as its expected product, so a linear fit on D such features
approximates kernel ridge regression. The normal equations are sums over rows: each task adds up its own, two levels of sums
follow, and the driver solves a system of D + 1 unknowns, however many rows there are. Sums are kept by fold, so that each row also gets
a score from a fit that left its fold out; a monotone function from those raw scores to probabilities is fitted on all of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices, summed, texts
from .labelled import held_out, training_rows

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "repeated_pairs", "same_as_previous",
    "upper", "digits", "blanks", "beyond_ascii", "stops", "exclamations", "bars", "marks", "other_punctuation", "control",
    "log_lines", "distinct_lines", "log_line_length", "words_with_marks", "capital_words", "byte_entropy",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "blanks": b" \t", "stops": b".,;:", "exclamations": b"!?",
    "bars": b"|", "marks": b"#$%&*@^~+=<>\\_{}[]", "other_punctuation": b"\"'()-/`",
}
_MARKS = frozenset(b"#$%&*@^~!|")


def statistics(text: bytes | None) -> list[float]:
    """The values of ``STATISTICS`` over the whole of a text; zeros for null and empty ones."""
    text = text or b""
    n, words = len(text), text.split()
    if not words:
        return [math.log1p(n), *[0.0] * (len(STATISTICS) - 1)]
    k = len(words)
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, k)
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = Counter(words)
    share = {c: by[list(of)].sum() / n for c, of in _CLASSES.items()}
    p = by[by > 0] / n
    return [
        math.log1p(n), math.log1p(k), lengths.mean(), lengths.std(), len(count) / k, count.most_common(1)[0][1] / k,
        1 - len(set(zip(words, words[1:]))) / max(1, k - 1), sum(map(bytes.__eq__, words, words[1:])) / k,
        share["upper"], share["digits"], share["blanks"], by[128:].sum() / n, share["stops"], share["exclamations"],
        share["bars"], share["marks"], share["other_punctuation"], by[:32].sum() / n,
        math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(n / len(lines)),
        sum(w[-1] in _MARKS for w in words) / k, sum(w.isupper() for w in words) / k, float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    coef: np.ndarray
    #: raw scores and the probabilities there, both rising
    at: np.ndarray
    probability: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b
        return np.hstack([np.ones((len(x), 1)), math.sqrt(2 / len(self.b)) * np.cos(z)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.coef

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, with a thousandth by the raw score so that equal steps keep its order."""
        raw = self.raw(x)
        return np.round(0.999 * np.interp(raw, self.at, self.probability) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 6)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rows that rise in x; the mean x and y of each pooled block."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([a / w for a, _, w in blocks]), np.array([b / w for _, b, w in blocks])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 256, ridge: float = 1e-3, seed: int = 7) -> QualityModel | None:
    """A model of ``labels.quality`` from at most ``sample`` labelled rows that are not held out; None if there is none.

    Folds are by crc32 of the id modulo 5, of which 0 is held out. Null and empty texts are learnt from like any other, and an id that is repeated is
    learnt from once.
    """
    # dealt by a remainder that holds that of the fold: there are at most 32 sums, one fold each, however many tasks
    rows = training_rows(docs, labels, "quality", sample, crc_mod(F.col("doc_id"), 40)).select("text", "y", crc_mod(F.col("doc_id"), 5).cast("string").alias("fold"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = pa.array([statistics(t) for t in texts(b)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, b.column(1), b.column(2)], ["x", "y", "fold"])

    known = rows.mapInArrow(measured, "x array<double>, y double, fold string").persist()
    try:
        d = len(STATISTICS)
        sums = known.agg(F.count("*"), *(F.avg(F.col("x")[i]) for i in range(d)), *(F.stddev_pop(F.col("x")[i]) for i in range(d))).first()
        if not sums[0]:
            return None
        mean, sd = np.array(sums[1 : d + 1]), np.array(sums[d + 1 :])
        rng = np.random.default_rng(seed)
        model = QualityModel(mean, np.where(sd > 1e-9, sd, 1.0), rng.normal(0, 1 / math.sqrt(d), (d, features)) * 1.5, rng.uniform(0, 2 * math.pi, features), np.zeros(0), np.zeros(0), np.zeros(0))
        equations = _equations(known, model)
        total = sum(equations.values())
        model.coef = _solved(total, ridge)
        model.at, model.probability = _calibrated(known, model, {fold: _solved(total - of, ridge) for fold, of in equations.items()})
        return model
    finally:
        known.unpersist()


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)), batch.column(1).to_numpy(zero_copy_only=False)


def _equations(known: DataFrame, model: QualityModel) -> dict[str, np.ndarray]:
    """By fold the sums of the products of features with each other and with the label."""
    n = len(model.b) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            x, y = _columns(batch)
            f, fold = model.features(x), np.array(batch.column(2).to_pylist())
            for k in np.unique(fold):
                of = fold == k
                total[k] = total.get(k, 0) + f[of].T @ np.hstack([f[of], y[of, None]])
        yield pa.RecordBatch.from_arrays([pa.array([*map(str, total)], pa.string()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["key", "vec"])

    return {r.key: np.frombuffer(r.vec).reshape(n, n + 1) for r in summed(known.mapInArrow(products, "key string, vec binary")).collect()}


def _solved(total: np.ndarray, ridge: float) -> np.ndarray:
    n = len(total)
    penalty = np.eye(n) * ridge * max(1.0, total[0, 0])
    penalty[0, 0] = 1e-9
    return np.linalg.solve(total[:, :n] + penalty, total[:, n])


def _calibrated(known: DataFrame, model: QualityModel, without: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic fit over all rows' raw scores, each by the coefficients that its fold had no part in; rows are at most the sample."""

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _columns(batch)
            f, fold, score = model.features(x), np.array(batch.column(2).to_pylist()), np.zeros(len(y))
            for k in np.unique(fold):
                score[fold == k] = f[fold == k] @ without[str(k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.round(score, 9)), pa.array(y)], ["raw", "y"])

    scored = known.mapInArrow(raw, "raw double, y double")
    got = scored.groupBy("raw").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("raw").collect()
    return isotonic(np.array([r.raw for r in got]), np.array([r.y for r in got]), np.array([r.n for r in got], float))


def _scored(batch: pa.RecordBatch, model: QualityModel | None) -> np.ndarray:
    x = np.array([statistics(t) for t in texts(batch)]).reshape(-1, len(STATISTICS))
    return model.score(x) if model else np.full(len(x), 0.5)


def scores(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``doc_id`` and ``score`` of every row, over whole texts; null and empty texts are scored by their (zero) statistics; 0.5 without a model.

    Equal texts have equal scores, repeated rows come back as often as they occur, and an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scored(b, shipped.value))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def good_enough(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more; rows are read, scored and passed on or dropped in one go."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(_scored(b, shipped.value) >= least))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted``, for each row of ``docs``, repeated ones too."""
    return scores(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
