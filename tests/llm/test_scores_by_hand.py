"""The scores of the three classifiers, computed anew without Spark or the modules' own helpers."""

import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from tidewater.llm import language, quality, toxicity
from tidewater.llm.labelled import training_rows

RUDE = ["blargh", "snorf", "blarghish"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = []
    for i in range(240):
        lang = rng.choice(["xx", "yy", "zz"])
        parts = {"xx": ["lo", "mi", "ta"], "yy": ["krz", "vop", "ösch"], "zz": ["éa", "io", "ru"]}[lang]
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(5, 40))]
        toxic, poor = rng.random() < 0.3, rng.random() < 0.4
        words += rng.choices(RUDE, k=2) if toxic else []
        text = " ".join(w.upper() + "!" for w in words) if poor else "\n".join([" ".join(words[:5]), " ".join(words[5:])])
        out.append((i, text, lang, int(not poor), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    return docs.cache(), spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], "doc_id long, quality int, toxic int").cache()


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


# --- quality


def facts(text):
    """The statistics, each by its plain meaning."""
    raw = text.encode()
    words = raw.split()
    n, k = len(raw), len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    among = lambda chars: sum(b in chars for b in raw) / n
    sizes = [len(w) for w in words]
    mean = sum(sizes) / k
    most = collections.Counter(words).most_common(1)[0][1]
    share = [c / n for c in collections.Counter(raw).values()]
    return [
        math.log(n + 1), math.log(k + 1), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / k), len(set(words)) / k, most / k,
        1 - len({(a, b) for a, b in zip(words, words[1:])}) / max(1, k - 1), sum(a == b for a, b in zip(words, words[1:])) / k,
        among(range(65, 91)), among(range(48, 58)), among(b" \t"), among(range(128, 256)), among(b".,;:"), among(b"!?"), among(b"|"), among(b"#$%&*@^~+=<>\\_{}[]"), among(b"\"'()-/`"), among(range(32)),
        math.log(len(lines) + 1), len(set(lines)) / len(lines), math.log(n / len(lines) + 1),
        sum(chr(w[-1]) in "#$%&*@^~!|" for w in words) / k, sum(w.isupper() for w in words) / k, -sum(p * math.log2(p) for p in share),
    ]


def test_quality(tables, rows):
    docs, labels = tables
    x = np.array([facts(r[1]) for r in rows])
    y, fold = np.array([r[3] for r in rows], float), np.array([crc(r[0], 5) for r in rows])
    use = fold > 0
    sd = x[use].std(axis=0)
    z = np.clip((x - x[use].mean(axis=0)) / np.where(sd > 1e-9, sd, 1), -6, 6)
    rng = np.random.default_rng(7)
    w = rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], 256)) * 1.5
    b = rng.uniform(0, 2 * math.pi, 256)
    f = np.hstack([np.ones((len(x), 1)), math.sqrt(2 / 256) * np.cos(z @ w + b)])

    def ridge(of):
        penalty = np.eye(257) * 1e-3 * max(1, of.sum())
        penalty[0, 0] = 1e-9
        return np.linalg.solve(f[of].T @ f[of] + penalty, f[of].T @ y[of])

    # isotonic by its definition: the greatest of least means over blocks around a row
    raw = np.zeros(len(x))
    for k in range(1, 5):
        raw[fold == k] = f[fold == k] @ ridge(use & (fold != k))
    order = np.argsort(raw[use], kind="stable")
    at, target = raw[use][order], y[use][order]
    sums = np.concatenate([[0], np.cumsum(target)])
    mean = lambda i, j: (sums[j + 1] - sums[i]) / (j + 1 - i)
    n = len(at)
    fitted = np.array([max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)])
    xs, ys = [], []
    for v in np.unique(np.round(fitted, 12)):
        of = np.abs(fitted - v) < 1e-9
        xs.append(at[of].mean())
        ys.append(v)
    final = f @ ridge(use)
    want = 0.999 * np.interp(final, xs, ys) + 0.001 / (1 + np.exp(-4 * (final - 0.5)))
    got = {r.doc_id: r for r in quality.digest(docs, labels).collect()}
    assert [got[r[0]].score for r in rows] == pytest.approx(list(want), abs=2e-6)
    assert all(got[r[0]].held_out == (crc(r[0], 5) == 0) and got[r[0]].predicted == (got[r[0]].score >= 0.3) for r in rows)


# --- toxicity


def buckets(text):
    """The n-grams themselves, and only then their numbers."""
    t = re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", f" {text.encode().lower().decode()} ")
    t += " " * 6 if len(t) < 6 else ""
    found = set()
    for n in (4, 5, 6):
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if " " not in g[1:-1]:
                h = 0
                for c in g:
                    h = (h * 2246822519 + ord(c)) % 2**32
                found.add((h * 2654435761 % 2**32) >> 14)
    return found


@pytest.mark.parametrize("text", ["", "Aé", "naïve Ünïcode 😀😀😀😀 words", "日本語のテキスト、です", "a--b  c", "İSTANBUL"])
def test_ngrams_are_of_characters(text):
    assert set(toxicity.ngrams(text.encode()).tolist()) == buckets(text)


def test_a_repeated_id_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, "a")] * 500 + [(1, "b"), (1, None), (2, None), (3, ""), (5, "x")], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    got = sorted((r.doc_id, r.text, r.y) for r in training_rows(docs, labels, "toxic", 100).collect())
    assert got == [x for x in [(1, "b", 0.5), (2, None, 1.0), (3, "", 0.0)] if crc(x[0], 5)]


def test_toxicity(tables, rows):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    train = [(buckets(r[1]), r[4]) for r in rows if crc(r[0], 5)]
    n_p, n_q = sum(y for _, y in train), sum(1 - y for _, y in train)
    p, q = (collections.Counter(b for x, y in train if y == of for b in x) for of in (1, 0))
    r = {b: math.log((p[b] + 0.5) / (n_p + 1)) - math.log((q[b] + 0.5) / (n_q + 1)) for b in set(p) | set(q)}
    known = {b for b in r if p[b] + q[b] >= 3}
    assert set(np.flatnonzero(model.weight)) <= known and len(known) < 8192  # so all of them are used
    # the weights are those of least loss: no direction leads further down
    w = {b: model.weight[b] / r[b] if r[b] else 0.0 for b in known}
    prob = [1 / (1 + math.exp(-(model.bias + sum(model.weight[b] for b in x if b in known)))) for x, _ in train]
    slope = [sum((pr - y) * r[b] for (x, y), pr in zip(train, prob) if b in x) + w[b] for b in known]
    flat = [sum((n_p / len(train) - y) * r[b] for x, y in train if b in x) for b in known]
    assert max(map(abs, slope)) < 0.02 * max(map(abs, flat)) and abs(sum(prob) - n_p) < 0.02 * len(train)
    got = {x.doc_id: x.score for x in toxicity.digest(docs, labels).collect()}
    for x in rows:
        z = model.bias + sum(model.weight[b] for b in buckets(x[1]))
        assert got[x[0]] == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-6)


# --- language


def grams(text):
    t = re.sub(rb"[^a-z\x80-\xff]", b" ", b" " + text.encode().lower() + b" ")
    t = re.sub(rb" +", b" ", t)
    out = []
    for n, factor in ((2, 40503), (3, 2654435761), (4, 2246822519)):
        out += [(int.from_bytes(t[i : i + n], "big") * factor % 2**32) >> 16 & 0xFFFF for i in range(len(t) - n + 1)]
    return out


def test_language(spark, tables, rows):
    docs, _ = tables
    names = ["xx", "yy", "zz"]
    count = {x: collections.Counter() for x in names}
    for r in rows:
        if crc(r[0], 3) != 1:
            count[r[2]].update(grams(r[1]))
    share = np.array([[count[x][b] + 0.5 for b in range(1 << 16)] for x in names])
    share /= share.sum(axis=1, keepdims=True)
    code = language.codewords(3)
    ratio = np.array([np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) for c in code.T])
    mean = np.array([[(s * r).sum() for r in ratio] for s in share])
    spread = np.sqrt(np.array([[(s * r * r).sum() for r in ratio] for s in share]) - mean**2)
    weight = (mean * code / spread).min(axis=0)
    weight = np.maximum(weight, 1e-3)
    weight *= len(weight) / weight.sum()
    got = {r.doc_id: r for r in language.digest(docs).collect()}
    for r in rows:
        g = grams(r[1])
        margin = ratio[:, g].sum(axis=1) / math.sqrt(len(g))
        loss = (np.log1p(np.exp(-margin * code)) * weight).sum(axis=1)
        p = np.exp(loss.min() - loss) / np.exp(loss.min() - loss).sum()
        x = got[r[0]]
        assert x.lang_pred == names[int(p.argmax())] and x.score == pytest.approx(p.max(), abs=1e-4)
        assert x.ambiguous == (np.sort(p)[-1] - np.sort(p)[-2] < 0.2) or abs(np.sort(p)[-1] - np.sort(p)[-2] - 0.2) < 1e-3
    # equal losses: the first by name, flagged; a null lang is not learnt
    ids = [i for i in range(50) if crc(i, 3) != 1][:8]
    twins = spark.createDataFrame([(i, "lo mi ta", ("yy", "xx", None, "xx", "yy")[n % 5]) for n, i in enumerate(ids[:5])], "doc_id long, text string, lang string")
    one = language.identify(twins, language.fit(twins)).first()
    assert (one.lang_pred, one.ambiguous) == ("xx", True)


def test_three_hundred_languages(spark):
    """More languages than a task holds counts of; the counts are those of a plain loop, and each language is told from all others."""
    rng = np.random.default_rng(4)
    names = [f"l{i:03}" for i in range(300)]
    words = {x: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéüß"), rng.integers(3, 8))) for _ in range(12)] for x in names}
    rows = [(i, " ".join(rng.choice(words[names[i % 300]], 40)), names[i % 300]) for i in range(1_800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")  # sums in three levels
    try:
        model = language.fit(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert model.names == names
    code, share = model.code, np.full((300, 1 << 16), 0.5)
    for i, text, lang in rows:
        if crc(i, 3) != 1:
            np.add.at(share[int(lang[1:])], grams(text), 1)
    share /= share.sum(axis=1, keepdims=True)
    for bit in (0, 7, code.shape[1] - 1):
        c = code[:, bit]
        assert np.allclose(model.ratio[:, bit], np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)), atol=1e-5)
    got = language.identify(docs, model).collect()
    right = {i: lang for i, _, lang in rows}
    assert sum(r.lang_pred == right[r.doc_id] for r in got) > 0.99 * len(rows)


def test_memory_of_long_texts_and_many_languages():
    """A text of 5 MB, and 500 texts against 1,000 languages, in far less than a worker has."""
    rng = np.random.default_rng(1)
    code = language.codewords(1_000)
    model = language.LanguageModel([str(i) for i in range(1_000)], code, rng.normal(size=(1 << 16, code.shape[1])).astype(np.float32), np.ones(code.shape[1]))
    text = bytes(rng.integers(97, 123, 5_000_000, np.uint8))
    tracemalloc.start()
    sums, n = model.sums(text)
    which, p, _ = model.decode(rng.normal(size=(500, code.shape[1])), np.full(500, 9))
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    g = np.concatenate(list(language.ngrams(text)))
    assert n == len(g) == 3 * (len(text) + 2) - 6 and np.allclose(sums, np.bincount(g, minlength=1 << 16) @ model.ratio.astype(float), atol=0.5)
    assert np.allclose(p.max(), 1, atol=1) and len(which) == 500
    # the losses of every language by the definition
    s, k = rng.normal(size=(3, code.shape[1])) * 5, np.array([4, 1, 9])
    loss = (np.logaddexp(0, -(s / np.sqrt(k)[:, None])[:, None, :] * code) * model.bit_weight).sum(axis=2)
    assert model.decode(s, k)[0].tolist() == loss.argmin(axis=1).tolist()
