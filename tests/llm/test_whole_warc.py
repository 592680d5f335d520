"""Every row of pages is a capture of its own."""

import collections
import gzip
import hashlib

import duckdb
from pyspark.sql import functions as F

from tidewater.llm import warc


def test_repeated_and_missing_ids(spark, tmp_path):
    x, y, z = "x" * 1200, "y" * 1200, "z"
    rows = [
        (1, "http://a", x), (1, "http://a", x), (1, "http://b", x), (1, "http://a", y), (1, None, z),
        (2, "http://c", y), (2, "http://c", y), (2, None, y), (2, "http://c", x), (3, "http://d", z), (0, "http://e", x), (0, "", y),
        *[(None, "http://n", x)] * 3, *[(None, None, None)] * 4, (None, "", "v" * 1500), (None, "", "v" * 1500),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = collections.Counter(map(tuple, warc.digest(pages).collect()))
    assert got == collections.Counter(c.sql(warc.ORACLE_SQL).fetchall()) and sum(got.values()) == len(rows)

    # parts of a capture come from one row, and what a revisit refers to is there once
    warc.write(pages, f"{tmp_path}/w")
    captures = warc.assemble(warc.read(spark, f"{tmp_path}/w")).collect()
    ids = [r.capture_id for r in captures]
    assert len(set(ids)) == len(ids) == len(rows)
    text = lambda r: (r.target_uri or "", bytes(r.request.body or b"").decode(), bytes(r.metadata.body).decode())
    want = collections.Counter((url or "", f"payloadBytes: {len(html or '')}\r\n") for _, url, html in rows)
    assert collections.Counter((text(r)[0], text(r)[2]) for r in captures) == want
    bodies = {r.capture_id: bytes(r.response.body) for r in captures if r.response.type == "response"}
    revisits = [r for r in captures if r.response.type == "revisit"]
    assert revisits and all(len(bodies[r.response.refers_to]) == int(text(r)[2].split()[1]) for r in revisits)


def by_loop(rows):
    """What the contract says of each row, without looking at archives."""
    groups = collections.defaultdict(list)
    for i, (page, _, html) in enumerate(rows):
        groups[html or ""].append((page is not None, page or 0, i))
    out = []
    for i, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        one = max(groups[html or ""])
        revisit = len(body) >= 1000 and one[2] != i
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", rows[one[2]][0] if revisit else None))
    return collections.Counter(out)


def test_one_response_for_each_payload(spark, tmp_path):
    """Rows without an id and rows that share the largest id revisit the one that stands for their payload."""
    x, y, z, v = "x" * 1000, "é" * 500, "z" * 999, "v" * 2000
    rows = [
        (3, "u", x), (None, "u", x), (5, "u", x), (7, "u", y), (7, "u", y), (7, "w", y), (1, "u", y), (None, "u", z), (9, "u", z), (9, "u", z),
        *[(None, "u", v)] * 3, (None, "t", v), (-4, "u", "n" * 1001), (None, "u", "n" * 1001), (-4, None, "n" * 1001),
    ]
    for parts in (1, 4):
        path = f"{tmp_path}/{parts}"
        spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("tag", "n", "shared", "copies")}).repartition(parts).write.parquet(f"{path}/pages.parquet")
        got = collections.Counter(map(tuple, warc.digest(spark.read.parquet(f"{path}/pages.parquet")).collect()))
        assert got == by_loop(rows)


def test_damaged_archives_are_read_as_far_as_they_go(spark, tmp_path):
    record = "WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <%s>\r\nContent-Length: 4\r\n\r\nGET \r\n\r\n"
    whole = gzip.compress((record % "a").encode()) + gzip.compress((record % "b").encode())
    for name, data in (("part-1", whole), ("part-2", whole[:-20]), ("part-3", b"not an archive"), ("part-4", (record % "c").encode() + b"\0" * 9 + (record % "d").encode()[:-6]), ("part-5", b"")):
        (tmp_path / name).write_bytes(data)
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in got if r.type and r.intact and not r.error)[:4] == ["a", "a", "b", "c"]
    assert sum(r.error is not None for r in got) == 4 and all(r.type is None for r in got if r.error)
    assert [r.intact for r in got if r.record_id == "d"] == [False]
