"""Packing tokenised documents into sequences of a fixed length by fitted length patterns.

Documents become pieces of at most a sequence's length in the tasks that read them. What the packing depends on is the histogram of piece lengths, which
has one number for each length whatever the corpus: patterns of up to three lengths that fill a sequence exactly are fitted to it by
non-negative least squares, their repeat counts are rounded, and the residual histogram is packed best fit decreasing, counts at a time. The driver
holds the histogram and the patterns only. Each pattern gives ranges of sequence numbers, and the n-th piece of a length goes to the n-th place
for that length: pieces are numbered by task and length, with the counts of the tasks before added.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

CAPACITY = 2048
END_ID = 0
#: The pattern by which the byte-level vocabularies cut a text into words (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond this many characters a text is encoded by the slower of the two libraries, which doesn't recurse over long runs.
LONG = 1 << 18


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the tokenizer file at ``path``, without added special tokens; a special token that is spelled out in a text keeps its id.

    The ids are those of the library ``tokenizers``. A byte-level vocabulary whose merges stand in the order of their ids has the same ids by ``tiktoken``, at
    five times the speed, so texts up to ``LONG`` characters go there; anything else goes to ``tokenizers``.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    by_file = Tokenizer.from_str(json.dumps(file))

    def plain(text: str) -> np.ndarray:
        return np.array(by_file.encode(text, add_special_tokens=False).ids, "<u4")

    to_byte, model, cut = _bytes_of_characters(), file["model"], file.get("pre_tokenizer") or {}
    merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model.get("merges", [])]
    special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    vocab = {k: v for k, v in model.get("vocab", {}).items() if k not in special}
    byte_level = (
        model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and file.get("normalizer") is None
        and [vocab.get(m) for m in merges] == list(range(256, 256 + len(merges))) and len(vocab) == 256 + len(merges)
        and not any(t[k] for t in file.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    )
    if not byte_level:
        return plain
    ranks = {bytes(to_byte[c] for c in k): v for k, v in vocab.items()}
    fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def quick(text: str) -> np.ndarray:
        if len(text) > LONG:
            return plain(text)
        return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)

    return quick


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A stored row for each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, the task ``part`` that made it and its number ``nth`` among the pieces of that length there.

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone. Documents of more than ``capacity`` ids are cut from their end, so that
    the first piece is the short one. ``ids`` of a piece are kept where ``keep_ids`` says so. Rows with a null or repeated id are documents like any other.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<int>" if keep_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            rows, kept = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                first = (len(ids) - 1) % capacity + 1
                start = 0
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    some = ids[start:end]
                    rows.append((doc_id, k, start, end - start, zlib.crc32(some.tobytes()), part, seen[end - start]))
                    seen[end - start] += 1
                    start = end
                    if keep_ids:
                        kept.append(some.astype(np.int32))
            columns = [*zip(*rows)] or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            if keep_ids:
                ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))


def exact_patterns(histogram: np.ndarray) -> np.ndarray:
    """All sets of two or three occurring lengths, the longest first, that add up to the capacity (the histogram's last index); 0 where there is no third."""
    capacity = len(histogram) - 1
    there = np.flatnonzero(histogram[:capacity])
    a = np.repeat(there, len(there))
    b = np.tile(there, len(there))
    c = capacity - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[ok], b[ok], c[ok]
    return np.stack([a, b, c])[:, (c == 0) | (histogram[c] > 0)]


def nonnegative_fit(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """How often each pattern should be used, by non-negative least squares on the histogram.

    Multiplicative steps: from a positive start they keep every count non-negative and never raise the squared error. Index 0, the missing third length, weighs nothing.
    """
    capacity = len(histogram) - 1
    weight = np.ones(capacity + 1)
    weight[0] = 0
    wanted = (weight * histogram)[patterns].sum(axis=0)
    x = np.full(patterns.shape[1], histogram.sum() / max(1, 3 * patterns.shape[1]))
    for _ in range(rounds):
        used = np.bincount(patterns.ravel(), np.tile(x, 3), capacity + 1)
        x *= wanted / np.maximum((weight * used)[patterns].sum(axis=0), 1e-12)
    return x


def rounded(patterns: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole counts that use no length more often than it occurs; fractions are carried on from pattern to pattern, so that sums stay."""
    total = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
    counts, left = np.diff(total, prepend=0), histogram.tolist()
    left[0] = int(total[-1]) * 3 + 3 if len(total) else 0
    some = np.flatnonzero(counts)
    for j, a, b, c in zip(some.tolist(), *patterns[:, some].tolist()):
        n = min(int(counts[j]), left[a] // (1 + (a == b) + (a == c)), left[b] // (1 + (a == b) + (b == c)), left[c] // (1 + (a == c) + (b == c)))
        counts[j] = n
        for length in (a, b, c):
            left[length] -= n
    return counts


def best_fit(histogram: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit decreasing on counts: (runs of a length and its copies, number of sequences filled so), for all that the histogram holds.

    Sequences with the same content are one entry, so the work depends on the number of lengths, not of pieces.
    """
    capacity = len(histogram) - 1
    free: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    for length in np.flatnonzero(histogram)[::-1].tolist():
        n = int(histogram[length])
        while n:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                room, each = capacity, capacity // length
                content, there = (), -(-n // each)
            else:
                (content, there), each = free[room].pop(), room // length
                if not free[room]:
                    del free[room]
            filled = min(there, n // each)
            rest = min(each, n - filled * each) if filled < there else 0
            if filled:
                free.setdefault(room - each * length, []).append(((*content, (length, each)), filled))
            if rest:
                free.setdefault(room - rest * length, []).append(((*content, (length, rest)), 1))
            if content and there - filled - bool(rest):
                free.setdefault(room, []).append((content, there - filled - bool(rest)))
            n -= filled * each + rest
    return [x for r in sorted(free) for x in free[r]]


def packed_patterns(histogram: np.ndarray, shares: tuple[float, ...] = (1.0, 0.9, 0.7)) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns with their repeat counts that hold exactly what the histogram counts, by least squares first and best fit for the rest.

    The fit takes a share of the pieces, so that short ones stay for the gaps that the rest leaves; of the ``shares`` tried that with the fewest sequences is taken.
    """
    capacity = len(histogram) - 1
    whole = [(((capacity, 1),), int(histogram[capacity]))] if histogram[capacity] else []
    histogram = histogram.copy()
    histogram[capacity] = 0
    patterns = exact_patterns(histogram)
    x = nonnegative_fit(patterns, histogram) if patterns.size else np.zeros(0)
    best: list | None = None
    for share in shares if patterns.size else (1.0,):
        counts = rounded(patterns, x * share, histogram)
        used = np.bincount(patterns.ravel(), np.tile(counts, 3), capacity + 1).astype(np.int64) if patterns.size else np.zeros(capacity + 1, np.int64)
        used[0] = 0
        fitted = [(tuple((int(p), 1) for p in patterns[:, j] if p), int(counts[j])) for j in np.flatnonzero(counts)]
        found = whole + fitted + best_fit(histogram - used)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
    return best or []


def _places(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of places by length and rank: where they begin, the first sequence, the offset there and how many copies each sequence takes."""
    rows, sequence = [], 0
    for runs, count in patterns:
        offset = 0
        for length, copies in runs:
            rows.append((length, count * copies, sequence, offset, copies))
            offset += length * copies
        sequence += count
    length, n, first, offset, copies = np.array(rows, np.int64).reshape(-1, 5).T
    order = np.argsort(length, kind="stable")
    length, n, first, offset, copies = (v[order] for v in (length, n, first, offset, copies))
    before = np.cumsum(n) - n
    base = before[np.searchsorted(length, length)] if len(length) else before
    return {"length": length, "rank": before - base, "first": first, "offset": offset, "copies": copies}


_RANKS = 1 << 48


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (what ``pieces`` returns) with ``sequence_id`` and ``offset`` instead of ``part`` and ``nth``; sequences begin at 0 and have no gaps inside.

    Pieces of one length are interchangeable, so the n-th goes to the n-th place. An empty table gives an empty result.
    """
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long"))))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        histogram[r.length] = r.n
    places = cut.sparkSession.sparkContext.broadcast(_places(packed_patterns(histogram)))
    ranked = cut.join(before.drop("n"), ["length", "part"]).withColumn("nth", F.col("before") + F.col("nth")).drop("before", "part")
    names = [c for c in cut.columns if c not in ("part", "nth")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        starts = p["length"] * _RANKS + p["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            i = np.searchsorted(starts, length * _RANKS + rank, "right") - 1
            at = rank - p["rank"][i]
            sequence, offset = p["first"][i] + at // p["copies"][i], p["offset"][i] + at % p["copies"][i] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "nth").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence of pieces that kept their ``ids``: ``ids``, and ``documents``, the pieces' doc_id, piece, offset and length in their order.

    A sequence's pieces fill at most its length, so a group is bounded.
    """
    found = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    x = packed.groupBy("sequence_id").agg(found.alias("x"))
    return x.select("sequence_id", F.flatten("x.ids").alias("ids"), F.transform("x", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("documents"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` of each piece of ``docs``."""
    return pack(pieces(docs, path)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
