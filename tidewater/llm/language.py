"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a binary classifier over byte n-grams that tells the languages with a 1 from those
with a 0. The classifiers are log ratios of smoothed n-gram shares, so all of them follow from one table of counts by language,
which tasks count and levels of sums add up. A text's bits are decoded to the codeword with the smallest loss, each
bit weighing as much as it separates the languages; where the runner-up is close, the result is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices, stored, summed, texts

BUCKETS = 1 << 16
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
#: Bytes of a text that are hashed at once.
STRETCH = 1 << 18
#: Buckets of a row of the stored table of counts, which has a row for each language and block of buckets.
BLOCK = 1 << 11
#: Languages of which a task holds counts before it passes them on.
HELD = 64


def ngrams(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of a text's 2-, 3- and 4-grams of bytes, a stretch of the text at a time; A-Z are lower-cased, all ASCII but letters is blank."""
    b = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    b = b[(b != 32) | (np.concatenate([[0], b[:-1]]) != 32)]
    for at in range(0, len(b), STRETCH):
        c = b[at : at + STRETCH + 3].astype(np.uint32)
        h2 = c[:-1] << 8 | c[1:]
        h3 = (h2[:-1] << 8 | c[2:]) * np.uint32(2654435761)
        h4 = (h2[:-2] << 16 | h2[2:]) * np.uint32(2246822519)
        yield np.concatenate([h2[:STRETCH] * np.uint32(40503) >> 16 & 0xFFFF, h3[:STRETCH] >> 16, h4[:STRETCH] >> 16])


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A row of +1 and -1 for each of n languages: up to 20 log2(n) random columns, the best of 50 draws by the smallest distance between codewords (one draw for over 256 languages, whose distances hardly vary).

    A column that all share tells nothing, and one that splits the languages as another does tells nothing more: both are left out.
    """
    if n == 1:
        return np.ones((1, 1), int)
    rng, bits = np.random.default_rng(seed), int(20 * np.ceil(np.log2(n)))
    draws = [rng.choice([-1, 1], (n, bits)) for _ in range(50 if n <= 256 else 1)]
    draws = [np.unique((m * m[:1])[:, np.abs(m.sum(axis=0)) < n], axis=1) for m in draws]  # the first language has +1 everywhere
    return draws[0] if len(draws) == 1 else max(draws, key=lambda m: (m.shape[1] - (m @ m.T) + 4 * bits * np.eye(n)).min())


@dataclass
class LanguageModel:
    names: list[str]
    code: np.ndarray
    #: by bucket and bit, the log ratio of shares
    ratio: np.ndarray
    bit_weight: np.ndarray

    def decode(self, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language, its share of the softmax over losses, and whether the runner-up is close; sums: by text and bit.

        A bit's loss depends on the code's sign alone, so the losses of all languages are two matrix products.
        """
        margin = sums / np.sqrt(np.maximum(n, 1))[:, None]
        total = -(np.logaddexp(0, -margin) * self.bit_weight) @ (self.code > 0).T - (np.logaddexp(0, margin) * self.bit_weight) @ (self.code < 0).T
        total = np.round(total, 9)  # losses that are equal but for rounding are a tie
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        two = np.partition(p, -2, axis=1) if p.shape[1] > 1 else p
        return p.argmax(axis=1), p.max(axis=1), (two[:, -1] - two[:, -2] < 0.2) if p.shape[1] > 1 else np.zeros(len(p), bool)

    def sums(self, text: bytes) -> tuple[np.ndarray, int]:
        """Log ratios by bit, summed over a text's n-grams, and how many these are. A long text's buckets are counted first, so that memory doesn't grow with it."""
        out, n = np.zeros(self.code.shape[1]), 0
        for g in ngrams(text):
            n += len(g)
            if len(g) <= BUCKETS:  # cheaper than to go through all buckets
                for at in range(0, len(g), BLOCK):
                    out += self.ratio[g[at : at + BLOCK]].sum(axis=0, dtype=float)
            else:
                c = np.bincount(g, minlength=BUCKETS)
                for at in range(0, BUCKETS, BLOCK):
                    out += c[at : at + BLOCK] @ self.ratio[at : at + BLOCK]
        return out, n


def _by_block(sums: DataFrame) -> DataFrame:
    """``block``, ``lang``, ``vec`` and ``total``, the sum of its counts, from the keys of ``summed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k.split(":", 1) for k in batch.column(0).to_pylist()]
            total = [float(np.frombuffer(v).sum()) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(k) for k, _ in keys], pa.int32()), pa.array([x for _, x in keys], pa.string()), batch.column(1), pa.array(total, pa.float64())], ["block", "lang", "vec", "total"])

    return sums.mapInArrow(run, "block int, lang string, vec binary, total double")


def fit(docs: DataFrame, alpha: float = 0.5) -> LanguageModel | None:
    """From all rows with a text and a ``lang``, but for those whose crc32 modulo 3 is 1; None if there are none.

    Rows with a null id are learnt from, those with a null ``lang`` are not, and repeated rows count as often as they occur. All values of ``lang`` are learnt, in the order of their
    names' bytes. Tasks hold the counts of ``HELD`` languages at a time; the counts are a stored table of blocks of buckets, and each block of the model is made from its
    rows. The driver gets the model: 256 KB and, a block at a time, 16 bytes a language, for each of up to 20 log2(languages) bits.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.coalesce(crc_mod(F.col("doc_id"), 3) != 1, F.lit(True)) & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang in sorted(counts):
                parts = counts.pop(lang).reshape(-1, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([f"{i}:{lang}" for i in range(len(parts))]), pa.array([x.tobytes() for x in parts], pa.binary())], ["key", "vec"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch)):
                if lang not in counts:
                    if len(counts) == HELD:
                        yield from given()
                    counts[lang] = np.zeros(BUCKETS)
                for g in ngrams(text):
                    counts[lang] += np.bincount(g, minlength=BUCKETS)
        yield from given()

    table = stored(_by_block(summed(rows.mapInArrow(count, "key string, vec binary"))))
    totals = {r.lang: r.total for r in table.groupBy("lang").agg(F.sum("total").alias("total")).collect()}  # a number for each language
    if not totals:
        return None
    names = sorted(totals)
    code = codewords(len(names))
    index, size = {x: i for i, x in enumerate(names)}, np.array([totals[x] for x in names]) + alpha * BUCKETS

    def block(some: pd.DataFrame) -> pd.DataFrame:
        share = np.full((len(names), BLOCK), alpha)
        for lang, vec in zip(some.lang, some.vec):
            share[index[lang]] += np.frombuffer(vec)
        share /= size[:, None]  # each language counts alike, however common
        ratio = np.array([np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) if (c < 0).any() else np.zeros(BLOCK) for c in code.T]).T
        return pd.DataFrame([(some.block.iloc[0], ratio.astype(np.float32).tobytes(), (share @ ratio).tobytes(), (share @ ratio**2).tobytes())], columns=["block", "ratio", "mean", "square"])

    bits = code.shape[1]
    ratio, mean, square = np.zeros((BUCKETS, bits), np.float32), np.zeros(code.shape), np.zeros(code.shape)
    made = stored(table.groupBy("block").applyInPandas(block, "block int, ratio binary, mean binary, square binary"))
    for r in made.orderBy("block").toLocalIterator():
        ratio[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.ratio, np.float32).reshape(-1, bits)
        mean += np.frombuffer(r["mean"]).reshape(code.shape)
        square += np.frombuffer(r.square).reshape(code.shape)
    apart = np.maximum((mean * code / np.sqrt(np.maximum(square - mean**2, 1e-12))).min(axis=0), 1e-3)  # by bit, how surely the least sure language is on the right side
    return LanguageModel(names, code, ratio, apart / apart.sum() * bits)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``ambiguous`` of every row.

    A text that is null or has no letter (Unicode category L) is ``und`` with score 0, as is any where nothing was learnt. Of languages
    with equal losses the first by name is taken, and the result is flagged. Texts are read whole; an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in slices(batches):
            known = np.array(batch.column(2).to_pylist(), bool) & (m is not None)
            sums, n = np.zeros((len(known), m.code.shape[1] if m else 1)), np.zeros(len(known))
            for i, text in enumerate(texts(batch)):
                if known[i]:
                    sums[i], n[i] = m.sums(text)
            which, p, close = m.decode(sums, n) if m else (np.zeros(len(known), int), sums[:, 0], known)
            lang = [m.names[w] if k else "und" for w, k in zip(which, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(known, np.round(p, 6), 0.0)), pa.array(close & known)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), "text", letters).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``ambiguous`` for each row of ``docs``, repeated ones too; a null id is not held out."""
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
