"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A document's features are the distinct n-grams of its words, hashed into buckets. Task-wise counts of the documents of each class
that have a bucket are summed into the log-count ratio r = log((p + a) / |p + a|) - log((q + a) / |q + a|). A logistic
regression is fitted on presence times r, over the buckets on which the classes differ most, by sums of losses and gradients from the tasks; what
it multiplies out to is one weight for each bucket, so that scoring a text is a sum of looked-up weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored, summed, texts
from .labelled import TASKS, held_out, training_rows

BITS = 18
#: A-Z are lower-cased; other ASCII than letters and digits is a blank; characters above 0x7F stay.
_FOLD = np.array([c if 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)], np.uint32)
_STEP = np.uint32(2246822519)


def ngrams(text: bytes | None) -> np.ndarray:
    """The distinct buckets of a text's n-grams, of 4 to 6 characters (code points), which may begin or end in a blank but have none inside."""
    c = np.frombuffer(f" {(text or b'').decode('utf-8', 'replace')} ".encode("utf-32-le"), np.uint32)
    c = np.where(c < 128, _FOLD[np.minimum(c, 127)], c)
    blank = c == 32
    keep = np.concatenate([[True], ~(blank[1:] & blank[:-1])])
    c, blank = c[keep], blank[keep]
    if len(c) < 6:
        c, blank = np.concatenate([c, np.full(6, 32, np.uint32)]), np.concatenate([blank, np.full(6, True)])
    h4, in4 = ((c[:-3] * _STEP + c[1:-2]) * _STEP + c[2:-1]) * _STEP + c[3:], blank[1:-2] | blank[2:-1]
    h5, in5 = h4[:-1] * _STEP + c[4:], in4[:-1] | blank[3:-1]
    h6, in6 = h5[:-1] * _STEP + c[5:], in5[:-1] | blank[4:-1]
    seen = np.zeros(1 << BITS, bool)
    for h, inner in ((h4, in4), (h5, in5), (h6, in6)):
        seen[h[~inner] * np.uint32(2654435761) >> (32 - BITS)] = True
    return np.flatnonzero(seen)


@dataclass
class ToxicityModel:
    weight: np.ndarray
    bias: float

    def score(self, text: bytes | None) -> float:
        z = self.bias + self.weight[ngrams(text)].sum()
        return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 6)


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """By bucket the documents of each class that have it, and the documents of each class."""
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size + 1))
        for batch in batches:
            for text, y in zip(texts(batch), batch.column(batch.schema.get_field_index("y")).to_pylist()):
                total[int(y >= 0.5), ngrams(text)] += 1
                total[int(y >= 0.5), size] += 1
        yield pa.RecordBatch.from_arrays([pa.array(["sum"]), pa.array([total.tobytes()], pa.binary())], ["key", "vec"])

    got = summed(rows.mapInArrow(count, "key string, vec binary")).collect()
    total = np.frombuffer(got[0].vec).reshape(2, size + 1) if got else np.zeros((2, size + 1))
    return total[1, :size], total[0, :size], total[1, size], total[0, size]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 16_000, features: int = 8_192, min_count: int = 3, l2: float = 1.0, rounds: int = 40) -> ToxicityModel | None:
    """A model of ``labels.toxic`` from at most ``sample`` labelled rows that are not held out; None if a class is missing.

    The weights are those of the ``features`` buckets on which the classes differ most for their standard error, among those that ``min_count``
    texts have. An id whose labels disagree counts as toxic from a mean of a half, and one that is repeated is learnt from once.
    """
    rows = stored(training_rows(docs, labels, "toxic", sample))  # read twice
    p, q, n_p, n_q = _counts(rows)
    if not n_p or not n_q:
        return None
    r = np.log((p + 0.5) / (n_p + 1)) - np.log((q + 0.5) / (n_q + 1))
    # how far the classes differ in standard errors: rare buckets with chance ratios stay out
    share = (p + q) / (n_p + n_q)
    far = np.abs(p / n_p - q / n_q) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_q))
    frequent = np.flatnonzero(p + q >= min_count)
    chosen = np.sort(frequent[np.argsort(-far[frequent], kind="stable")[:features]])
    index = np.full(1 << BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [shipped.value[ngrams(t)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[x >= 0].astype(np.int32).tobytes() for x in of], pa.binary()), batch.column(2)], ["doc_id", "f", "y"])

    left = rows.select("doc_id", "text", "y").mapInArrow(kept, "doc_id long, f binary, y double").repartition(TASKS, "doc_id").sortWithinPartitions("doc_id", "f").persist()
    try:
        weight, bias = _logistic(left.select("f", "y"), r[chosen], float(np.log(n_p / n_q)), l2, rounds)
    finally:
        left.unpersist()
        forget(rows)
    full = np.zeros(1 << BITS)
    full[chosen] = weight * r[chosen]
    return ToxicityModel(full, bias)


#: Sums over rows are sent as multiples of this, so that they don't depend on the order in which tasks end.
_GRAIN = 2.0**-30


def _loss(rows: DataFrame, r: np.ndarray, w: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The penalised log loss of presence times r at the weights ``w`` (the bias last, without penalty), and its gradient: sums from the tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 1)
        for batch in batches:
            each = [np.frombuffer(f, np.int32) for f in batch.column(0).to_pylist()]
            y = (batch.column(1).to_numpy() >= 0.5).astype(float)
            row, col = np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate([np.zeros(0, np.int32), *each])
            z = np.bincount(row, r[col] * w[col], len(each)) + w[-1]
            miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            total[:-2] += np.bincount(col, r[col] * miss[row], len(r))
            total[-2] += miss.sum()
            total[-1] += (np.logaddexp(0, z) - y * z).sum()
        yield pa.RecordBatch.from_arrays([pa.array([np.rint(total / _GRAIN).tobytes()], pa.binary())], ["vec"])

    # as many vectors as the sample has tasks, which is a fixed number
    total = sum(np.frombuffer(r.vec) for r in rows.mapInArrow(part, "vec binary").collect()) * _GRAIN
    penalised = np.append(w[:-1], 0.0)
    return float(total[-1] + l2 / 2 * (penalised**2).sum()), total[:-1] + l2 * penalised


def _logistic(rows: DataFrame, r: np.ndarray, bias: float, l2: float, rounds: int, memory: int = 10, tolerance: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of least penalised loss, by steps along the gradient as the last ``memory`` steps have shown its curvature.

    Each round is a pass over the sample where it lies; the driver holds vectors of the features' number.
    """
    w = np.append(np.zeros(len(r)), bias)
    loss, gradient = _loss(rows, r, w, l2)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, back = -gradient, []
        for s, g in reversed(steps):
            a = s @ direction / (s @ g)
            back.append(a)
            direction = direction - a * g
        if steps:
            s, g = steps[-1]
            direction = direction * (s @ g) / (g @ g)
        else:
            direction = direction / max(1.0, float(np.linalg.norm(gradient)))
        for (s, g), a in zip(steps, reversed(back)):
            direction = direction + (a - g @ direction / (s @ g)) * s
        slope, size = float(gradient @ direction), 1.0
        if slope >= 0:
            break
        while True:
            new = w + size * direction
            new_loss, new_gradient = _loss(rows, r, new, l2)
            if new_loss <= loss + 1e-4 * size * slope or size < 1e-4:
                break
            size /= 2
        gain = loss - new_loss
        if gain <= 0:
            break
        s, g = new - w, new_gradient - gradient
        if s @ g > 1e-12:
            steps = [*steps, (s, g)][-memory:]
        w, loss, gradient = new, new_loss, new_gradient
        if gain < tolerance * max(1.0, loss):
            break
    return w[:-1], float(w[-1])


def scores(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """``doc_id`` and ``score`` of every row, over whole texts; null and empty ones have no n-grams but blanks; 0 without a model.

    Equal texts have equal scores, repeated rows come back as often as they occur, and an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shipped.value.score(t) if shipped.value else 0.0 for t in texts(b)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted``, for each row of ``docs``, repeated ones too."""
    return scores(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
