"""Benchmark decontamination with a generalised suffix automaton.

The automaton accepts every run of words that some test item contains. It is built once over the items, shipped to the
tasks, and the words of the documents stream through it: its state gives, at each word, the longest run ending there that
an item contains. A run of ``window`` words or more hits the document; an item of fewer words counts as a whole.

Test sets are small next to a corpus. Items are taken in shards of at most ``shard_words`` words, a longer item in pieces that
overlap by a window less one word, so that what is built and shipped at once is bounded. A test set of one shard takes one pass over the
documents. For a larger one every row gets an id, each shard's pass writes the ids, spans and items of the rows that it hits and no texts,
and one join brings what was found to the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, free_name, slices, stored, with_row_ids, with_text

#: Bytes of words (0-9, a-z, all above 0x7F) stay, A-Z are lower-cased, all others become blanks; offsets stay the same.
WORD_BYTES = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class SuffixAutomaton:
    """Of several sequences of words; ``found[state]`` lists (length, items) of the runs that count as hits."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.found: list[dict[int, set[str | None]]] = [{} for _ in self.go]
        for item, words in items:
            for state, size in self._runs(words, min(window, len(words))):
                self.found[state].setdefault(size, set()).add(item)
        #: the nearest state on the way of links, itself included, that has hits
        self.hit = [-1] * len(self.go)
        for s in sorted(range(len(self.go)), key=self.length.__getitem__):
            self.hit[s] = s if self.found[s] else self.hit[self.link[s]] if self.link[s] >= 0 else -1

    def _state(self, length: int, go: dict[bytes, int], link: int) -> int:
        self.go.append(go)
        self.length.append(length)
        self.link.append(link)
        return len(self.go) - 1

    def _split(self, p: int, w: bytes) -> int:
        """The state for the runs of p followed by w, made a state of its own if they are the shorter ones of it."""
        q = self.go[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.go[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.go[p]:
            self.go[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def _runs(self, words: list[bytes], size: int) -> Iterator[tuple[int, int]]:
        """The state of each run of ``size`` words of an item."""
        state = 0
        for i, w in enumerate(words):
            state = self.go[state][w]
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            if i + 1 >= size:
                yield state, size

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (merged, end exclusive) inside hits, and the items whose runs occur."""
        go, link, length, hit = self.go, self.link, self.length, self.hit
        start, spans, items = go[0], [], set()
        state = matched = 0
        for i, w in enumerate(words):
            if not state:  # nothing matched so far
                if w in start:
                    state, matched = start[w], 1
                else:
                    continue
            else:
                while state and w not in go[state]:
                    state = link[state]
                    matched = length[state]
                if w in go[state]:
                    state = go[state][w]
                    matched += 1
            at = hit[state]
            longest = 0
            while at >= 0:
                for size, of in self.found[at].items():
                    if size <= matched:
                        longest = max(longest, size)
                        items |= of
                at = hit[link[at]] if link[at] >= 0 else -1
            if longest:
                a = i + 1 - longest
                if spans and spans[-1][1] >= a:
                    # a longer run may reach back over earlier spans
                    while len(spans) > 1 and spans[-2][1] >= a:
                        spans.pop()
                    a = min(a, spans[-1][0])
                    spans.pop()
                spans.append((a, i + 1))
        return spans, items


def shards(bench: DataFrame, window: int, shard_words: int) -> Iterator[SuffixAutomaton]:
    """Automata over the items, in order of their ids; null texts have no words and repeated rows count once.

    An item with more words than a shard is cut to pieces of a shard each that overlap by a window less one word, so each window is in one of them.
    """
    now, n = [], 0
    size = max(shard_words, 2 * window)
    rows = bench.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator()
    for item, text in rows:
        words = words_of(bytes(text))
        for i in range(0, max(1, len(words) - window + 1), size - window + 1) if words else ():
            piece = words[i : i + size]
            if now and n + len(piece) > shard_words:
                yield SuffixAutomaton(now, window)
                now, n = [], 0
            now.append((item, piece))
            n += len(piece)
    yield SuffixAutomaton(now, window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = "n_words long, n_hit long, items array<string>, cut string"
_HITS_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("cut", pa.string())])


def contamination(docs: DataFrame, bench: DataFrame, window: int = 13, shard_words: int = 200_000) -> DataFrame:
    """``row``, a struct with the columns of ``docs``, and ``hits``: ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``cut``, the text without hit words.

    ``docs`` needs ``text``; ``bench`` has ``item_id`` and ``text``. Null and empty texts have no words and no hits, and texts are read whole.
    Items without an id hit words like any other, but there is no id of theirs to list. Items of one text are each listed. ``cut`` drops each merged
    span from its first word's start to its last word's end. Repeated rows come back as often as they occur, columns of any name
    stay inside ``row``, and an empty table, of documents or of items, gives no rows or no hits.
    """
    automata = shards(bench, window, shard_words)
    now, following = next(automata), next(automata, None)
    if following is None:
        return _judged(docs.select(F.struct("*").alias("row")), now)
    key = free_name(docs, "row_id")
    keyed = with_row_ids(docs, key)
    found = []
    while now is not None:
        found.append(stored(_spans(keyed.select(F.col(key).alias("key"), "text"), now)))
        now, following = following, next(automata, None) if following is not None else None
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # a row of it for each shard that hits the document
    by_row = stored(every.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    for f in found:
        forget(f)
    joined = keyed.join(by_row, keyed[key] == by_row["key"], "left")
    return _judged(joined.select(F.struct(*(keyed[f"`{c}`"] for c in docs.columns)).alias("row"), "spans", "items"), None)


def _spans(keyed: DataFrame, automaton: SuffixAutomaton) -> DataFrame:
    """``key``, ``spans`` (starts and ends in turn) and ``items`` of the rows that the automaton hits."""
    shipped = keyed.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *shipped.value.hits(words_of(t))) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())]
            found = [(k, [x for span in spans for x in span], sorted(i for i in items if i is not None)) for k, spans, items in found if spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in found], pa.int64()), pa.array([s for _, s, _ in found], pa.list_(pa.int32())), pa.array([i for _, _, i in found], pa.list_(pa.string()))], ["key", "spans", "items"]
            )

    return keyed.mapInArrow(run, "key long, spans array<int>, items array<string>")


def _judged(rows: DataFrame, automaton: SuffixAutomaton | None) -> DataFrame:
    """``row`` and ``hits``, from what the automaton finds, or without one from ``spans`` and ``items`` beside ``row``."""
    shipped = rows.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):  # the words of all its rows are held
            row, found = batch.column(0), []
            known = [c.to_pylist() for c in batch.columns[1:]] or [[None] * len(row)] * 2
            for text, spans, items in zip(row.field("text").cast(pa.binary()).to_pylist(), *known):
                words = words_of(text)
                spans, items = shipped.value.hits(words) if shipped.value else ([*zip((spans or [])[::2], (spans or [])[1::2])], items or [])
                found.append(_hits(text, words, spans, items))
            yield pa.RecordBatch.from_arrays([row, pa.array(found, _HITS_TYPE)], ["row", "hits"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("hits", T.StructType.fromDDL(_HITS))]))


def _hits(text: bytes | None, words: list[bytes], spans: list[tuple[int, int]], items: Iterable[str | None]) -> dict:
    if not spans:
        return {"n_words": len(words), "n_hit": 0, "items": [], "cut": None if text is None else text.decode()}
    spans = _merged(spans)
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
    cut, end = [], 0
    for a, b in spans:
        cut.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return {"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "items": sorted(i for i in items if i is not None), "cut": b"".join([*cut, text[end:]]).decode()}


CONTAMINATED = "hits.n_hit > 0 and 20 * hits.n_hit >= hits.n_words"


def digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """For each row of ``docs`` its words, those inside windows of items, and the items: their number, the hash of their ids, and the verdict."""
    return contamination(docs.select("doc_id", "text"), bench).select(
        "row.doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without those that benchmark items cover to a twentieth or more; from others the matched spans are cut.

    ``n_chars``, where there is such a column, follows the text.
    """
    found = contamination(docs, bench).where(f"not ({CONTAMINATED})")
    return with_text(found, docs, F.col("hits.n_hit") > 0, F.col("hits.cut"))


#: The same by joining word windows.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT rid, i, k, item FROM dw JOIN win USING (k, g)),
n_hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
n_items AS (SELECT rid, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit h USING (rid) LEFT JOIN n_items t USING (rid)
"""
