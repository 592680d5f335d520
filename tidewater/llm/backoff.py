"""Language-model scores with stupid backoff, from n-gram counts of the corpus itself.

S(w | context) is count(context w) / count(context) if the n-gram was seen ``min_count`` times or more, else 0.4 times the score with
a context shorter by one word, down to count(w) / words. Counts come from all documents and are exact.

The tables are keyed by the n-gram's 64-bit hash and partitioned by it. Documents are dealt to chunks of a few megabytes; of
each chunk and partition one row is shuffled, with the chunk's distinct n-grams there and how often it has them. A partition adds them
up and answers every row with the corpus counts of its n-grams, and a join brings the answers back to the chunk, where the
scores of its documents are summed. A frequent n-gram is thus one entry for each chunk, however often it occurs, and rows are a few
kilobytes instead of one for each word. Chunks and partitions are as many as keep both at a fixed size; a partition is what its first bits
of the hash say, so a chunk finds its own in one look over its n-grams, however many there are.

Counts are exact but for n-grams, of whatever length, that share all 64 bits of their hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    """XXH64 of words, looked up or computed; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


def _grams(column: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of each text, each word's position in its text, and for n = 1 to order the hash of the n words that end there.

    Where a text has not yet n words the hash is of no use.
    """
    hashes, of, sizes = _Hashes(), [], []
    for text in column.cast(pa.binary()).to_pylist():
        words = (text or b"").lower().split()
        sizes.append(len(words))
        of.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
    n = np.array(sizes, np.int64)
    h = np.concatenate(of) if of else np.zeros(0, np.uint64)
    position = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    grams = [h]
    for _ in range(1, order):
        last = np.concatenate([np.zeros(1, np.uint64), grams[-1][:-1]]) if len(h) else h
        x = (last ^ last >> np.uint64(29)) * _MIX + h * _ODD
        grams.append((x ^ x >> np.uint64(32)) * _MIX)
    return n, position, grams


def _distinct(position: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted distinct n-grams, and where to find that of each word and order."""
    valid = [position >= k for k in range(len(grams))]
    every, inverse = np.unique(np.concatenate([g[v] for g, v in zip(grams, valid)]), return_inverse=True)
    at, start = [], 0
    for v in valid:
        index = np.zeros(len(v), np.int64)
        index[v] = inverse[start : start + v.sum()]
        start += int(v.sum())
        at.append(index)
    return every, at


def _parts(every: np.ndarray, bits: int) -> tuple[np.ndarray, list[int]]:
    """The partitions among sorted hashes, by their first ``bits`` bits, and where each begins, with the end of the last; only those that have any."""
    part = every >> np.uint64(64 - bits) if bits else np.zeros(len(every), np.uint64)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(every)] if len(every) else [0]
    return part[edges[:-1]], edges


def _narrow(numbers: np.ndarray) -> tuple[int, bytes]:
    """Most counts are small: numbers as narrow as the largest of them needs, and how wide that is."""
    x = numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))
    return x.itemsize, x.tobytes()


def _wide(widths: list[int], data: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, f"u{w}") for w, x in zip(widths, data)] or [np.zeros(0)]).astype(float)


def _packed(rising: np.ndarray) -> bytes:
    """Sorted hashes as the steps between them, all first bytes first: the high ones are mostly zero, and Spark compresses them."""
    return np.diff(rising, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel())


def _columns(t: pa.Table, *names: str) -> list[list]:
    return [t.column(name).to_pylist() for name in names]


def _added(grams: list[bytes], widths: list[int], counts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of each row, the distinct ones of all rows, their sums, and where each row's n-grams are among those, row after row."""
    of = [_unpacked(g) for g in grams]
    every, inverse = np.unique(np.concatenate(of), return_inverse=True)
    return of, every, np.bincount(inverse, _wide(widths, counts)), inverse


def _corpus_counts(rows: DataFrame, by: str) -> DataFrame:
    """For each row of ``by``, ``part`` and n-grams with counts the sums over all rows of the part, in the order of its n-grams."""

    def total(t: pa.Table) -> pa.Table:
        of, _, sums, inverse = _added(*_columns(t, "grams", "width", "counts"))
        narrow = [_narrow(x) for x in np.split(sums[inverse], np.cumsum([len(x) for x in of])[:-1])]
        return pa.table({by: t.column(by), "part": t.column("part"), "width": pa.array([w for w, _ in narrow], pa.int32()), "totals": pa.array([x for _, x in narrow], pa.binary())})

    return rows.groupBy("part").applyInArrow(total, f"{by} long, part long, width int, totals binary")


def _by_groups(rows: DataFrame, at_once: int) -> DataFrame:
    """The same for ``chunk``: groups of about ``at_once`` chunks are added up, then the groups, and a group's answers go to its chunks."""
    rows = rows.withColumn("team", F.floor(F.col("chunk") / at_once))

    def subtotal(t: pa.Table) -> pa.Table:
        _, every, sums, _ = _added(*_columns(t, "grams", "width", "counts"))
        width, counts = _narrow(sums)
        return pa.table({"team": t.column("team")[:1], "part": t.column("part")[:1], "grams": pa.array([_packed(every)], pa.binary()), "width": pa.array([width], pa.int32()), "counts": pa.array([counts], pa.binary())})

    def dealt_out(t: pa.Table, answers: pa.Table) -> pa.Table:
        of, _, _, inverse = _added(*_columns(t, "grams", "width", "counts"))
        sums = _wide(*_columns(answers, "width", "totals"))
        narrow = [_narrow(x) for x in np.split(sums[inverse], np.cumsum([len(x) for x in of])[:-1])]
        return pa.table({"chunk": t.column("chunk"), "part": t.column("part"), "width": pa.array([w for w, _ in narrow], pa.int32()), "totals": pa.array([x for _, x in narrow], pa.binary())})

    teams = rows.groupBy("part", "team").applyInArrow(subtotal, "team long, part long, grams binary, width int, counts binary")
    answers = _corpus_counts(teams, "team")
    return rows.groupBy("part", "team").cogroup(answers.groupBy("part", "team")).applyInArrow(dealt_out, "chunk long, part long, width int, totals binary")


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are equal in id and text as one with their number; only those of a batch, so that nothing is moved."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["doc_id", "text", "chunk"]).aggregate([([], "count_all")])
        yield from t.select(["doc_id", "text", "chunk", "count_all"]).rename_columns(["doc_id", "text", "chunk", "copies"]).combine_chunks().to_batches()


def backoff_scores(
    docs: DataFrame, order: int = 2, min_count: int = 2, factor: float = 0.4, chunk_bytes: int = 4 << 20, partition_grams: int = 1_000_000, chunks_at_once: int = 1_024
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_seen`` (words scored with a context) and ``log10_score`` of every row, over whole texts.

    A-Z are lower-cased and words are runs of anything but 0x20 and 0x09-0x0D. Null and blank texts have no words and score 0. Repeated rows
    count as often as they occur and come back as often. An empty table gives an empty result.
    """
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(n_bytes / chunk_bytes))
    bits = max(0, math.ceil(math.log2(max(1.0, order * n_bytes / 7 / partition_grams))))  # one number of partitions for the job
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")).mapInArrow(_copies, "doc_id long, text string, chunk long, copies long")

    def counted(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk")[0].as_py()
        n, position, grams = _grams(t.column("text"), order)
        every, at = _distinct(position, grams)
        copies, counts = np.repeat(t.column("copies").to_numpy(), n), np.zeros(len(every))
        for k, where in enumerate(at):
            counts += np.bincount(where[position >= k], copies[position >= k], len(every))
        full, edges = _parts(every, bits)
        narrow = [_narrow(counts[a:b]) for a, b in zip(edges, edges[1:])]
        packed = [_packed(every[a:b] - (p << np.uint64(64 - bits) if bits else p)) for p, a, b in zip(full, edges, edges[1:])]
        return pa.table({"part": pa.array(full.astype(np.int64)), "chunk": pa.array([chunk] * len(full), pa.int64()), "grams": pa.array(packed, pa.binary()), "width": pa.array([w for w, _ in narrow], pa.int32()), "counts": pa.array([c for _, c in narrow], pa.binary())})

    def scored(t: pa.Table, answers: pa.Table) -> pa.Table:
        n, position, grams = _grams(t.column("text"), order)
        every, at = _distinct(position, grams)
        rows = sorted(zip(*_columns(answers, "part", "width", "totals")))
        total = _wide([w for _, w, _ in rows], [x for _, _, x in rows])
        if len(total) != len(every):
            raise RuntimeError("a chunk changed while it was scored")
        seen = [total[a] if len(total) else np.zeros(0) for a in at]
        deepest = np.minimum(position, order - 1)  # the longest context there is
        depth, log = np.zeros(len(position), np.int64), np.log10(np.maximum(seen[0], 1))
        for k in range(1, order):
            use = (deepest >= k) & (seen[k] >= min_count)
            before = np.concatenate([[1.0], seen[k - 1][:-1]]) if len(use) else seen[0]
            depth, log = np.where(use, k, depth), np.where(use, np.log10(np.maximum(seen[k], 1)) - np.log10(np.maximum(before, 1)), log)
        log += (deepest - depth) * math.log10(factor)
        doc = np.repeat(np.arange(len(n)), n)
        return pa.table({
            "doc_id": t.column("doc_id"), "n_words": pa.array(n), "n_seen": pa.array(np.bincount(doc, depth > 0, len(n)).astype(np.int64)),
            "log": pa.array(np.bincount(doc, log, len(n))), "copies": t.column("copies"),
        })

    rows = dealt.groupBy("chunk").applyInArrow(counted, "part long, chunk long, grams binary, width int, counts binary")
    answers = _corpus_counts(rows, "chunk") if chunks <= chunks_at_once else _by_groups(rows, chunks_at_once)
    out = stored(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, "doc_id long, n_words long, n_seen long, log double, copies long"))
    words = out.agg(F.sum(F.col("n_words") * F.col("copies"))).first()[0] or 1
    out = out.where("copies = 1").unionByName(out.where("copies > 1").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("copy"))
    # words without a context were left undivided
    log10_score = F.col("log") - (F.col("n_words") - F.col("n_seen")) * math.log10(words)
    return out.select("doc_id", "n_words", "n_seen", log10_score.alias("log10_score"))


def digest(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores by document, and for each word on average, rounded to six digits."""
    s = backoff_scores(docs, order)
    each = F.when(F.col("n_words") > 0, F.round(F.col("log10_score") / F.col("n_words"), 6)).otherwise(0.0)
    return s.select("doc_id", "n_words", "n_seen", F.round("log10_score", 4).alias("log10_score"), each.alias("log10_per_word"))


#: The same by joining rows of n-grams.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
t AS (SELECT rid, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
one AS (SELECT b, count(*) AS n FROM t GROUP BY b),
two AS (SELECT a, b, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b HAVING count(*) >= 2),
s AS (
  SELECT rid, two.n IS NOT NULL AS seen,
         CASE WHEN two.n IS NOT NULL THEN log10(two.n) - log10(p.n)
              ELSE log10(o.n) - log10((SELECT count(*) FROM t)) + CASE WHEN t.a IS NOT NULL THEN log10(0.4) ELSE 0 END END AS l
  FROM t JOIN one o ON t.b = o.b LEFT JOIN one p ON t.a = p.b LEFT JOIN two ON t.a = two.a AND t.b = two.b)
SELECT doc_id, len(w) AS n_words, coalesce(g.seen, 0) AS n_seen, round(coalesce(g.l, 0), 4) AS log10_score,
       CASE WHEN len(w) > 0 THEN round(g.l / len(w), 6) ELSE 0.0 END AS log10_per_word
FROM d LEFT JOIN (SELECT rid, CAST(count(*) FILTER (seen) AS BIGINT) AS seen, sum(l) AS l FROM s GROUP BY rid) g USING (rid)
"""

#: The same for three orders.
TRIGRAM_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
t AS (SELECT rid, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
one AS (SELECT c, count(*) AS n FROM t GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c HAVING count(*) >= 2),
s AS (
  SELECT rid, three.n IS NOT NULL OR coalesce(bc.n >= 2, false) AS seen,
         CASE WHEN three.n IS NOT NULL THEN log10(three.n) - log10(ab.n)
              WHEN bc.n >= 2 THEN log10(bc.n) - log10(p.n) + CASE WHEN t.a IS NOT NULL THEN log10(0.4) ELSE 0 END
              ELSE log10(o.n) - log10((SELECT count(*) FROM t)) + CASE WHEN t.a IS NOT NULL THEN 2 WHEN t.b IS NOT NULL THEN 1 ELSE 0 END * log10(0.4) END AS l
  FROM t JOIN one o ON t.c = o.c LEFT JOIN one p ON t.b = p.c LEFT JOIN two bc ON t.b = bc.b AND t.c = bc.c
  LEFT JOIN two ab ON t.a = ab.b AND t.b = ab.c LEFT JOIN three ON t.a = three.a AND t.b = three.b AND t.c = three.c)
SELECT doc_id, len(w) AS n_words, coalesce(g.seen, 0) AS n_seen, round(coalesce(g.l, 0), 4) AS log10_score,
       CASE WHEN len(w) > 0 THEN round(g.l / len(w), 6) ELSE 0.0 END AS log10_per_word
FROM d LEFT JOIN (SELECT rid, CAST(count(*) FILTER (seen) AS BIGINT) AS seen, sum(l) AS l FROM s GROUP BY rid) g USING (rid)
"""
