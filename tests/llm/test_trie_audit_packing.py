"""The prefix trie, the audit of filters and the packing against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewater.llm import audit, packing, trie

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ("rep", "part", "depth", "fp", "n", "sha", "place", "row", "length", "A", "E", "head")


def conversations(rng, long):
    rows = []
    openings = [("user", "hello"), ("user", "hi"), ("system", "be kind"), (None, None)]
    for c in [*range(0, 12), *range(100, 140), 205, 300, 399, 400, -1, -100, -150]:
        turns = [openings[rng.randrange(2)], *((rng.choice(["user", "bot", None]), rng.choice(["a", "b", "", None, "é😀", "x" * 200])) for _ in range(rng.randrange(8)))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rows += [(7, None, "bot", "null turn"), (7, None, "bot", "null turn"), (8, 0, "bot", "tie"), (None, 0, "user", "nobody")]
    # a long one, that its hundred doesn't share, and an equal one
    rows += [(c, t, "user", f"turn {t % 5}") for c in (777, 778) for t in range(long)]
    rng.shuffle(rows)
    return rows


def trie_by_hand(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h]) + tuple(v[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    out = {}
    below = collections.defaultdict(lambda: [0, 0])
    kids = collections.Counter(p[:-1] for p in members if p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            below[p[:d]][0] += not kids[p]
            below[p[:d]][1] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), kids[p], *below[p], sha)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def found(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


@pytest.mark.parametrize("moduli,long", [(trie.MODULI, 400), ((13, 7), 12)])
def test_trie_like_brute_force(spark, moduli, long):
    """With small moduli most groups hold different prefixes, and are split."""
    rows = conversations(random.Random(5), long)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({c: F.lit(1) for c in CLASH})
    got = found(trie.digest(df, moduli))
    assert got == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.digest(none).collect() == []
    assert trie.digest(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    # 5 takes five turns from a conversation that isn't there, and has none after those
    (row,) = trie.digest(spark.createDataFrame([(3, 0, "user", "x")], SCHEMA)).collect()
    assert zlib.crc32(b"3") % 6 > 0 and (row.conv_id, row.depth, row.n_convs, row.n_leaves) == (3, 0, 1, 1)


def test_scan_goes_on_where_it_stopped():
    rng = np.random.default_rng(3)
    conv = np.sort(rng.integers(0, 6, 500))
    values = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    place, sums = trie.scan(conv, values, (None, 0, [0, 0]))
    for k, (b, m) in enumerate(zip(trie.BASES, trie.MODULI)):
        total = collections.Counter()
        for i, c in enumerate(conv.tolist()):
            assert place[i] == (conv[: i + 1] == c).sum()
            total[c] = (total[c] + int(values[i]) * pow(b, int(place[i]), m)) % m
            assert sums[k][i] == total[c]
    for cut in (1, 77, 250, 499):
        a = trie.scan(conv[:cut], values[:cut], (None, 0, [0, 0]))
        z = trie.scan(conv[cut:], values[cut:], (int(conv[cut - 1]), int(a[0][-1]), [int(s[-1]) for s in a[1]]))
        assert (np.r_[a[0], z[0]] == place).all() and all((np.r_[a[1][k], z[1][k]] == sums[k]).all() for k in (0, 1))


def test_ranges_of_one_conversation_are_joined(spark):
    """One conversation has nearly all rows: it lies in many ranges."""
    rows = [(1, t, b"%08d" % (t * 7 % 1000) + b"x" * 24, 1) for t in range(3_000)] + [(0, 0, b"a" * 32, 1), (2, 0, b"b" * 32, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, sha binary, n long").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.conv_id, r.place): r.fp for r in trie.scanned(df, ["turn"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    sums = [0, 0]
    for t in range(3_000):
        v = int.from_bytes(rows[t][2][:8], "little")
        sums = [(s + v % m * pow(b, t + 1, m)) % m for s, b, m in zip(sums, trie.BASES, trie.MODULI)]
        assert got[1, t + 1] == sums[0] << 31 | sums[1]


WORDS = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, WORDS, "s"), (2, WORDS, "s"), (3, WORDS, "t"), (3, WORDS, "t"), (None, WORDS, "s"), (4, None, None), (5, "", ""), (6, "few words", "s"), (7, WORDS + " #", "s"),
    (8, "A" * 500 + " " + WORDS, "s"), (9, "same " * 70, "t"), (10, "é😀 " * 60, "t"), (11, "x\n\t y\x0bz " * 20 + "|", "u"), (12, " ".join(f"v{i}" for i in range(100_000)), "u"), (13, "A B " * 40, None),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 1, None), (None, 1, 1), (9, 1, 1), (99, 1, 1)]


def audit_by_hand(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    judged = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        judged.append((s or "", {f for f, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        sums = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                sums[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in j[1] for j in mine) - len(gone), sum(j[1] == {f} for j in mine), sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(sums[order[k - 1]])
    return out


def test_audit_like_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in CLASH})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in CLASH})
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.digest(docs, labels).collect()}
    assert got == audit_by_hand(DOCS, LABELS)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.digest(docs, labels).collect() == []


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def by_hand(doc_id, text, capacity):
    ids = ids_of(text)
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


def packed_rows(df, capacity):
    at = collections.defaultdict(list)
    for r in df:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


TEXTS = ["", None, "one", "two  words\n\n and\ttabs ", "é😀 ünïcode 中文", "<|endoftext|> spelled out<|endoftext|>", "it's they'll 'tis ''s", "   x\x1cy\x85z ", "a" * 3_000, "word " * 5_000, "x" * 300_000, " " * 5_000, "\n" * 300]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_like_brute_force(spark, capacity):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "one"), (None, "no id"), (None, None)] + [(100 + i, " ".join(rng.choice(["alpha", "beta", "12", "-"]) for _ in range(rng.randrange(90)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit(1) for c in CLASH})
    cut = packing.pieces(df, PATH, capacity, keep_ids=True)
    packed = packing.pack(cut, capacity)
    got = packed.collect()
    want = collections.Counter(x for r in rows for x in by_hand(*r, capacity))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n, total = packed_rows(got, capacity), sum(x[3] * k for x, k in want.items())
    assert n <= -(-total // capacity) + 2
    for s in packing.sequences(packed).collect():
        for d in s.documents:
            part = np.array(s.ids[d.offset : d.offset + d.length], "<u4")
            assert (d.doc_id, d.piece, zlib.crc32(part.tobytes())) in {(x[0], x[1], x[4]) for x in want}


def test_packing_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.digest(none, PATH).collect() == []


def test_encoder_has_the_ids_of_tokenizers(spark, sf):
    from tokenizers import Tokenizer

    slow, quick = Tokenizer.from_file(PATH), packing.encoder(PATH)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [t or "" for t in TEXTS]
    for text in texts:
        assert quick(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = [12, 64, 100, 64, 7, 1][seed]
    h = np.r_[0, rng.integers(0, [3, 50, 400, 1, 9, 5][seed], capacity)].astype(np.int64)
    if seed == 3:
        h[:] = 0
    for found in (packing.packed_patterns(h), packing.best_fit(h)):
        held = np.zeros_like(h)
        for runs, n in found:
            assert n > 0 and sum(length * copies for length, copies in runs) <= capacity
            for length, copies in runs:
                held[length] += n * copies
        assert (held == h).all()
    least = -(-int((h * np.arange(capacity + 1)).sum()) // capacity)
    assert sum(n for _, n in packing.packed_patterns(h)) <= 11 / 9 * least + 1


def test_fit_comes_near_the_histogram():
    """Lengths that triples can cover wholly are covered wholly."""
    h = np.zeros(101, np.int64)
    for a, b, c, n in ((50, 30, 20, 40), (60, 40, 0, 25), (80, 15, 5, 10)):
        for length in (a, b, c):
            h[length] += n
    h[0] = 0
    p = packing.exact_patterns(h)
    x = packing.nonnegative_fit(p, h, 3_000)
    used = np.bincount(p.ravel(), np.tile(x, 3), 101)
    used[0] = 0
    assert np.abs(used - h).max() < 0.5
    assert sum(n for _, n in packing.packed_patterns(h)) == 75
