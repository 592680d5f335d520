"""Rows without ids, ids of several texts, very long texts, test sets and archives of other shapes, and the stages on odd and empty tables."""

import collections
import math
import random
import string
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import common, decontaminate, gif, mixing, secrets, simhash, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A, B = "an entirely plain text about rivers and the boats on them", "something else that shares no word of it at all, on bread"
ROWS = [(1, A), (None, A), (None, A), (5, A + " x"), (5, B), (None, "a third text, without any id, that is like none of the others"), (6, None), (7, ""), (8, "  "), (9, "word"), (9, "word")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s1" if i else None, len(t or "")) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("size", "row_id", "taken", "row", "key")})


# --- near-duplicates


def test_one_row_of_each_component_whatever_its_ids(odd):
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(odd).collect()]
    same = simhash.near_duplicates(odd.select(F.monotonically_increasing_id().alias("doc_id"), "text")).collect()
    assert len(got) == len({r.component_id for r in same})  # exactly one of each
    texts = collections.Counter(t for _, t in got)
    assert texts[B] == 1 and texts[ROWS[5][1]] == 1 and texts["word"] == 1  # none is lost
    assert (None, A) not in got and (1, A) in got  # an id comes before none
    again = [(r.doc_id, r.text) for r in simhash.one_of_each(odd.repartition(5)).collect()]
    assert collections.Counter(again) == collections.Counter(got)


# --- secrets


def brute_window(text, c):
    """By counting each window anew."""
    def entropy(w):
        return -sum(n / len(w) * math.log2(n / len(w)) for n in collections.Counter(w).values())

    return len(text) >= c.window and max(entropy(text[i : i + c.window]) for i in range(len(text) - c.window + 1)) >= c.bits - 1e-9


def test_windows_of_long_candidates(spark):
    rng = random.Random(8)
    c = secrets.CLASSES[1]
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (23, 24, 25, 255, 256, 257, 700, 3000) for alphabet in ("aB1", "aB1cD2eF3gH4", string.ascii_letters + "0123456789", "é😀a")]
    # only the last window is random
    texts += ["aB1" * 400 + "".join(rng.sample(string.ascii_letters, 24)), "".join(rng.sample(string.ascii_letters, 23)) + "aB1" * 9]
    for text in list(texts):
        for bits in (3.0, 3.9, 4.2):
            df = None
            want = brute_window(text, secrets.EntropyClass("x", "", c.window, bits, (), ""))
            texts.append((text, bits, want))
    cases = [t for t in texts if isinstance(t, tuple)]
    df = spark.createDataFrame([(t, b, w) for t, b, w in cases], "text string, bits double, want boolean")
    for bits in (3.0, 3.9, 4.2):
        part = df.where(F.col("bits") == bits).select("want", secrets.has_random_window(F.col("text"), c.window, bits).alias("got"))
        assert part.where("want <> got or got is null").count() == 0 and part.where("want").count() and part.where("not want").count()


def test_a_million_characters_take_seconds(spark):
    rng = random.Random(9)
    worst = "".join(rng.choice("aB1/") for _ in range(1_000_000))  # no window is random
    many = " ".join(["deadbeef" * 4] * 30_000)
    took = []
    for text in (worst[:100_000], worst, many):
        began = time.perf_counter()
        r = secrets.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        took.append(time.perf_counter() - began)
    assert took[1] < 60 and took[1] < 20 * took[0] and r.n_hex == 30_000
    cut = secrets.redacted(spark.createDataFrame([(1, "a " + many + " z", 7)], "doc_id long, text string, n_chars long")).first()
    assert cut.text == "a " + " ".join(["[hex]"] * 30_000) + " z" and cut.n_chars == len(cut.text)


# --- decontamination


def test_items_without_ids_long_items_and_empty_documents(spark):
    rng = random.Random(10)
    long = " ".join(f"t{rng.randrange(10**6)}" for _ in range(500))
    bench = spark.createDataFrame([(None, "quite short"), ("None", "other short one"), ("long", long), ("again", long)], "item_id string, text string")
    parts = long.split()
    texts = ["it is quite short", "an other short one", *(" ".join(["x", *parts[i : i + 13], "y"]) for i in range(0, 488, 7)), long, "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = None
    for words in (10**6, 40, 27):
        got = {r.row.doc_id: (r.hits.n_hit, r.hits["items"]) for r in decontaminate.contamination(docs, bench, shard_words=words).collect()}
        want = want or got
        assert got == want
    assert want[0] == (2, []) and want[1] == (3, ["None"])
    assert all(want[i] == (13, ["again", "long"]) for i in range(2, len(texts) - 2)) and want[len(texts) - 2][0] == 500 and want[len(texts) - 1] == (0, [])
    assert decontaminate.digest(docs.limit(0), bench).count() == 0 and decontaminate.digest(docs, bench.limit(0)).count() == len(texts)


# --- GIF


def test_pixels_of_frames_and_headers_that_claim_too_much(spark):
    payload = bytes(range(64)) * 3
    df = spark.createDataFrame([(1, bytearray(gif.encode(payload))), (2, None)], "doc_id long, media binary")
    got = {r.doc_id: r.frames for r in gif.frames(df).collect()}
    f = got[1][0]
    assert got[2] is None and (f.canvas_width, f.canvas_height) == (64, 3) and bytes(f.pixels) == bytes(x for v in payload for x in (v, v, v))
    head = b"GIF89a" + (65_535).to_bytes(2, "little") * 2 + b"\x81\0\0" + bytes(12)
    with pytest.raises(ValueError):
        list(gif.decode(head + b"\x3b"))


# --- WARC


def test_parts_are_linked_over_any_records_and_headers(spark):
    rows = [("m1", [], "response"), ("q1", ["m1"], "request"), ("i1", ["q1"], "metadata"), ("m2", ["q2"], "revisit"), ("q2", [], "request"), ("i2", ["a", "q2", "m2"], "metadata"), ("q9", ["gone"], "request"), ("i9", ["q9"], "metadata"), ("w", [], "warcinfo")]
    df = spark.createDataFrame([(r, c, t, None, "u", None, 1, 1, None, True, None, None) for r, c, t in rows], warc.RECORDS)
    got = {r.capture_id: tuple(x and x.record_id for x in (r.response, r.request, r.metadata)) for r in warc.assemble(df).collect()}
    assert got == {"m1": ("m1", "q1", "i1"), "m2": ("m2", "q2", "i2"), "gone": (None, "q9", None), "q9": (None, None, "i9")}
    data = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <i>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert next(iter(warc.parse(data)))["concurrent_to"] == ["a", "b"]


def test_pages_of_every_size_and_repeated_ids(spark):
    big = "<p>" + "é" * 700_000
    rows = [(1, "u", "x" * 1200), (2, "u", big), (3, "u", big), (3, "v", "y" * 70_000), (None, "u", big), (4, "w", None), (4, "w", None)]
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    n = len(big.encode())
    assert got == collections.Counter([(1, 1200, "response", None), (2, n, "revisit", 3), (3, n, "response", None), (3, 70_000, "response", None), (None, n, "revisit", 3), (4, 0, "response", None), (4, 0, "response", None)])


# --- the pipeline


def test_the_mix_keeps_rows_and_columns(odd):
    got = mixing.mixed(odd)
    assert got.columns == [*odd.columns, "_size", "source_size", "target", "again", "_taken", "slots"]
    rows = got.collect()
    assert {r.doc_id for r in rows} <= {i for i, t in ROWS if (t or "").strip()} and sum(r._taken for r in rows) == sum(round(t) for t in {r.source: r.target for r in rows}.values())
    assert all(r._taken <= r._size and r._taken == len(r.text.split()) == sum(s.words for s in r.slots) for r in rows)


@pytest.mark.parametrize("block", [7, 50, 2048])
def test_the_mix_is_the_targets(spark, block):
    """What is written out: the words of each source, whole texts but for the last of a pass, each slot filled once and by one source."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(40))), rng.choice(["a", "a", "a", "b", "c", None]), 3) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    mixed = mixing.mixed(docs, block_words=block).collect()
    again = mixing.mixed(docs.orderBy(F.rand(3)), block_words=block).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))
    by = {r.doc_id: r for r in mixing.mix(docs, block_words=block).collect()}
    words, slots, passes = collections.Counter(), collections.defaultdict(list), collections.Counter()
    for r in mixed:
        whole = rows[r.doc_id][1].split()
        assert r.text.split() == whole[: r.taken] and r.n_chars == (3 if r.taken == r.size else len(r.text))
        words[r.source] += r.taken
        passes[r.doc_id] += r.taken
        for s in r.slots:
            slots[s.slot].append((r.source, s.words))
    assert words == collections.Counter({r.source: round(r.target) for r in by.values() if round(r.target)})
    assert passes == collections.Counter({i: r.taken for i, r in by.items() if r.taken})
    assert all(len({x for x, _ in v}) == 1 and sum(n for _, n in v) <= block for v in slots.values())
    cut = [r for r in mixed if r.taken < r.size]
    assert max(collections.Counter((r.source, r.again) for r in cut).values(), default=0) <= 1


def test_stages_on_odd_and_empty_tables(spark, sf, odd):
    """Stages keep the columns; each result is what its operator says of the rows before, repeated rows included."""
    for rows in (odd, odd.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, common.stored(stage(spark, now, sf))
            assert now.columns[: len(odd.columns)] == odd.columns, name
            ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
            if name == "source_mix":
                want = mixing.mix(before.select("doc_id", "text", "source")).agg(F.sum("taken")).first()[0] or 0
                assert (now.agg(F.sum(now.columns[-2])).first()[0] or 0) == want and set(ids(now)) <= set(ids(before))
            elif name == "secret_scan":
                assert ids(now) == ids(before)
            else:
                assert ids(now) <= ids(before)
        assert {r.text if r[-2] == r[-6] else None for r in now.collect()} <= {t for _, t in ROWS}


def test_the_whole_pipeline_on_odd_and_empty_tables(spark, sf, odd, tmp_path):
    for name, rows in (("odd", odd), ("empty", odd.limit(0))):
        for table in ("benchmark", "labels"):
            spark.read.parquet(f"{sf}/{table}.parquet").limit(0 if name == "empty" else 99).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns[: len(odd.columns)] == odd.columns
        assert bool(got.count()) == (name == "odd")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if spark.sparkContext.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            common.shared_folder(spark)


# --- damaged images


def test_damaged_images_keep_what_comes_before(spark):
    """A table with whole, cut, foreign and oversized images is read to its end."""
    two = gif.encode(bytes(range(64)) * 4)
    assert two.endswith(b"\x3b")
    twice = two[:-1] + two[two.index(b"\x21\xf9") :]  # a second frame
    huge = b"GIF89a" + (65_535).to_bytes(2, "little") * 2 + b"\0\0\0;"
    rows = [(1, two), (2, twice), (3, twice[:-40]), (4, b"not a GIF at all"), (5, huge), (6, None), (7, b""), (7, b"")]
    got = [(r.doc_id, None if r.frames is None else len(r.frames), r.error) for r in gif.frames(spark.createDataFrame(rows, "doc_id long, media binary")).collect()]
    assert [x[:2] for x in sorted(got, key=lambda x: x[0])] == [(1, 1), (2, 2), (3, 1), (4, 0), (5, 0), (6, None), (7, 0), (7, 0)]
    assert {i for i, _, e in got if e} == {3, 4, 5, 7} and any("65535" in (e or "") for _, _, e in got)
