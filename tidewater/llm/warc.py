"""WARC archives: writing captures as request, response (or revisit) and metadata records, and assembling them again.

Archives are written by Spark's text sink, gzip-compressed, to the shared folder: a record is one value, and its closing line
end is the sink's line separator. They are read as binary files and cut by Content-Length, so payloads may contain anything.
The records of a capture name each other in WARC-Concurrent-To; from the main record (a response or revisit) its id goes along those
links, in either direction, and a grouping on that id assembles one nested row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, stored

LEAST_BYTES = 1000
_DATE = "2024-01-01T00:00:00Z"
RECORDS = (
    "record_id string, concurrent_to array<string>, type string, refers_to string, target_uri string, digest string, "
    "block_bytes long, payload_bytes long, payload_digest string, intact boolean, error string, body binary"
)


def _tag(salt: Column, copy: Column) -> Column:
    """Tells apart the captures of a ``page_id`` that is null or occurs more than once."""
    return F.sha1(F.to_json(F.struct("url", "sha1", salt.cast("long").alias("salt"), copy.cast("long").alias("copy"))).cast("binary"))


def plan(pages: DataFrame, least_bytes: int = LEAST_BYTES, every_page: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``url``, ``html``, its UTF-8 size and SHA-1, ``tag``, and where a payload of ``least_bytes`` and more occurs more than once ``shared``, ``same_as`` and ``same_tag``: the one row that stands for it.

    That is the row with the largest page_id, of several with that id the one of the greatest tag; rows without an id stand for a payload only where no other has it. Null html counts as
    empty. The row of a digest is a maximum that tasks combine before it is shuffled; what is joined back are the digests that occur more than once, and Spark splits those that hold
    many pages. ``pages`` are read twice and should come from files or be stored, so that both readings deal rows to tasks alike.

    ``tag`` is null where a page_id occurs once. Other rows, those without an id too, are numbered among their equals, which tasks count before
    they are shuffled; rows without an id are counted by the task that reads them, so that they stay spread. ``every_page`` are the rows among which
    ids are looked for, if ``pages`` are only some of them.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long"), "url", body.alias("html"), F.octet_length(body).cast("long").alias("n"), F.sha1(body.cast("binary")).alias("sha1"))
    known, nameless = p.where(F.col("page_id").isNotNull()), p.where(F.col("page_id").isNull())
    # mostly few or none, and then broadcast: stored, the planner knows their number
    ids = (pages if every_page is None else every_page).select(F.col("page_id").cast("long")).where("page_id is not null")
    repeated = stored(ids.groupBy("page_id").count().where("count > 1").select("page_id"))
    once = known.join(repeated, "page_id", "left_anti").withColumn("tag", F.lit(None).cast("string"))
    more = known.join(repeated, "page_id", "left_semi").withColumn("salt", F.lit(0)).unionByName(nameless.withColumn("salt", F.spark_partition_id()))
    copies = more.groupBy("page_id", "url", "n", "sha1", "salt").agg(F.first("html").alias("html"), F.count("*").alias("copies"))
    numbered = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("tag", _tag(F.col("salt"), F.col("copy")))
    each = once.unionByName(numbered.drop("salt", "copies", "copy"))
    one = F.max(F.struct("page_id", "tag"))  # nulls come first
    large = each.where(F.col("n") >= least_bytes).groupBy("sha1").agg(one.alias("x"), F.count("*").alias("copies")).where("copies > 1")
    large = large.select("sha1", F.lit(True).alias("shared"), F.col("x.page_id").alias("same_as"), F.col("x.tag").alias("same_tag"))
    # payloads that occur once need no join: only the digests of the others are kept
    return each.join(large, "sha1", "left")


def _record(kind: Column, record_id: Column, headers: list[Column], block: Column, content_type: str) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")), F.lit(f"WARC-Date: {_DATE}")]
    lines += [*headers, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))  # and the sink's "\n"


def _urn(page: Column, tag: Column, part: str) -> Column:
    return F.concat(F.lit("urn:page:"), F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), tag, F.lit(part)))


def records(planned: DataFrame) -> DataFrame:
    """``value``: the text of each record, three for each row."""
    page, tag = F.col("page_id"), F.col("tag")
    main = _urn(page, tag, "response")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    uri = F.concat(F.lit("WARC-Target-URI: "), url)
    with_main = F.concat(F.lit("WARC-Concurrent-To: <"), main, F.lit(">"))
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~(F.col("same_as").eqNullSafe(page) & F.col("same_tag").eqNullSafe(tag))
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"))
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), _urn(F.col("same_as"), F.col("same_tag"), "response"), F.lit(">")))
    profile = F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    block = F.when(revisit, F.lit(head)).otherwise(F.concat(F.lit(head), "html"))
    main_record = _record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), main, [uri, digest, refers, profile], block, "application/http;msgtype=response")
    request = _record(F.lit("request"), _urn(page, tag, "request"), [uri, with_main], F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n")), "application/http;msgtype=request")
    metadata = _record(F.lit("metadata"), _urn(page, tag, "metadata"), [uri, with_main], F.concat(F.lit("payloadBytes: "), F.col("n").cast("string"), F.lit("\r\n")), "application/warc-fields")
    return planned.select(F.explode(F.array(request, main_record, metadata)).alias("value"))


#: Sizes of html, in UTF-8, up to which pages share files, the larger the fewer of them.
CLASSES = (1 << 16, 1 << 20, 1 << 24)


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records_per_file: int = 3_000) -> None:
    """Archives in folders under ``path``, small enough that a task can read a file whole.

    Files of pages of at most 64 KB have ``records_per_file`` records; those of larger pages, which are a sixteenth as many for each of ``CLASSES``,
    take no more room, and what is beyond the last has a file for each page. Pages of one payload are of one size, so classes are planned each for itself.
    """
    n = F.coalesce(F.octet_length("html"), F.lit(0))
    of = sum((F.when(n > limit, 1).otherwise(0) for limit in CLASSES), F.lit(0))
    counts = {r.of: r["count"] for r in pages.groupBy(of.alias("of")).count().collect()}
    for k in sorted(counts) or [0]:
        some = pages if len(counts) < 2 else pages.where(of == k)
        per_file = max(3, records_per_file >> 4 * k) if k < len(CLASSES) else 3
        records(plan(some, least_bytes, pages)).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(f"{path}/{k}")


def _unpacked(content: bytes) -> tuple[bytes, str | None]:
    """An archive's bytes, and what is wrong with its compression; gzip members, of which there may be one for each record, are unpacked and joined as far as they can be."""
    if content[:2] != b"\x1f\x8b":
        return content, None
    out, error = [], None
    while content and not error:
        d = zlib.decompressobj(31)
        try:
            for i in range(0, len(content), 1 << 20):  # what comes before the damage stays
                out.append(d.decompress(content[i : i + (1 << 20)]))
                if d.eof:
                    content = d.unused_data + content[i + (1 << 20) :]
                    break
            else:
                content, error = b"", "compressed data end early"
        except zlib.error as e:
            error = f"compressed data are damaged: {e}"
    return b"".join(out), error


_HEADER = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")
NOTHING = dict.fromkeys(c.split()[0] for c in RECORDS.split(", ")) | {"concurrent_to": [], "intact": False}


def parse(data: bytes) -> Iterator[dict]:
    """The records of an uncompressed archive, cut by Content-Length.

    Where no whole header begins there is a row with an ``error`` and no type, and reading goes on at the next header, if any. A block that the archive's end cuts off isn't ``intact``.
    """
    at = 0
    while at < len(data):
        m = _HEADER.match(data, at)
        lines = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in m[1].decode(errors="replace").split("\r\n"))] if m else []
        h = dict(lines)
        length = h.get("content-length", "")
        if not m or "warc-type" not in h or not re.fullmatch("[0-9]+", length):
            after = _HEADER.search(data, at + 1)
            yield NOTHING | {"record_id": h.get("warc-record-id", "").strip("<>") or None, "error": f"no record at byte {at}"}
            at = after.start() if after else len(data)
            continue
        start, size = m.end(), int(length)
        block, at = data[start : start + size], start + size + 4
        body = block.partition(b"\r\n\r\n")[2] if h["warc-type"] in ("response", "revisit") else block
        ident = {k: h.get(f"warc-{k}", "").strip("<>") or None for k in ("record-id", "refers-to", "target-uri")}
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        sha = hashlib.sha1(body).hexdigest() if h["warc-type"] == "response" else None
        yield {
            "record_id": ident["record-id"], "concurrent_to": [v.strip("<>") for k, v in lines if k == "warc-concurrent-to"], "type": h["warc-type"], "refers_to": ident["refers-to"],
            "target_uri": ident["target-uri"], "digest": digest, "block_bytes": size, "payload_bytes": len(body), "payload_digest": sha,
            "intact": len(block) == size and (sha is None or digest in (None, sha)), "error": None, "body": body,
        }


def read(spark, path: str, bodies: bool = True) -> DataFrame:
    """The records of all archives under ``path``, gzip-compressed or not; ``body`` is null unless ``bodies``. What can't be read is a row with an ``error``, and the job goes on."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kind = pa.struct([*((k, pa.string()) for k in ("record_id", "type", "refers_to", "target_uri", "digest")), ("concurrent_to", pa.list_(pa.string())), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("error", pa.string()), ("body", pa.binary())])

    def batch_of(some: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_struct_array(pa.array(some, kind)).select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                some: list[dict] = []
                data, error = _unpacked(content)
                for record in chain(parse(data), [NOTHING | {"error": error}] if error else []):
                    if not bodies or record["type"] == "request":
                        record["body"] = record["body"] if record["type"] == "metadata" else None
                    some.append(record)
                    if len(some) == 500:
                        yield batch_of(some)
                        some = []
                if some:
                    yield batch_of(some)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


MAIN = ("response", "revisit")


def _captures(found: DataFrame) -> DataFrame:
    """``record_id`` and ``capture_id`` of the records that don't just name their main record and nothing else; few or none in most archives.

    From each main record its id goes to the records that it names or that name it, and from those on, until no further one is reached; of
    several main records that reach a record at once the one of the least id has it. Only ids are moved.
    """
    ids = found.where(F.col("type").isin(*MAIN, "request", "metadata")).select("record_id", "type", F.coalesce("concurrent_to", F.array().cast("array<string>")).alias("to"))
    main = F.col("type").isin(*MAIN)
    named = ids.select("record_id", "type", F.explode("to").alias("other"), F.size("to").alias("n"))
    mains = ids.where(main).select(F.col("record_id").alias("other")).distinct()
    # those that name a main record are placed by that alone
    direct = named.where(~main).join(mains, "other").groupBy("record_id").agg(F.min("other").alias("capture_id"), F.max("n").alias("n"))
    several, direct = direct.where("n > 1").drop("n"), direct.drop("n")
    loose = stored(ids.where(~main).join(direct, "record_id", "left_anti").select("record_id", "to"))
    if not loose.limit(1).count():
        return several
    both = named.select("record_id", "other").union(named.select("other", "record_id"))
    links = stored(both.join(loose.select("record_id"), "record_id", "left_semi").distinct())
    reached = stored(direct.unionByName(ids.where(main).select("record_id", F.col("record_id").alias("capture_id"))).distinct())
    placed = []
    while True:
        near = links.join(reached.withColumnRenamed("record_id", "other"), "other").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
        for before in placed:
            near = near.join(before, "record_id", "left_anti")
        near = stored(near)
        if not near.limit(1).count():
            break
        placed.append(near)
        reached = near
    out = several
    for some in placed:
        out = out.unionByName(some)
    return out


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture_id``, ``target_uri``, and the structs ``request``, ``response`` (or revisit) and ``metadata``.

    A capture is a main record and what WARC-Concurrent-To links to it, over any number of records and headers. A missing part is null; records
    that no main record is linked to are put together by the first id that they name. Of parts of one type the least by id is kept. The parts of
    a capture are brought together by one shuffle. ``found`` should be read from files or stored: ids are looked through before.
    """
    part = F.struct("record_id", "type", "refers_to", "digest", "block_bytes", "payload_bytes", "payload_digest", "intact", "body")
    of = lambda *kinds: F.min(F.when(F.col("type").isin(*kinds), part))
    kept = found.where(F.col("type").isin(*MAIN, "request", "metadata"))
    far = _captures(found)
    own = F.when(F.col("type").isin(*MAIN), F.col("record_id")).otherwise(F.coalesce("capture_id", F.array_min("concurrent_to"), "record_id"))
    keyed = kept.join(far, "record_id", "left").withColumn("capture_id", own)
    return keyed.groupBy("capture_id").agg(F.max("target_uri").alias("target_uri"), of("request").alias("request"), of(*MAIN).alias("response"), of("metadata").alias("metadata"))


def resolved(captures: DataFrame) -> DataFrame:
    """Captures with ``payload_bytes`` and ``payload_digest`` of the full payload: a revisit's are those of the response it refers to."""
    bodies = captures.where("response.type = 'response'").select(F.col("capture_id").alias("_of"), F.col("response.payload_bytes").alias("_n"), F.col("response.payload_digest").alias("_sha"))
    # a response is its own reference: no capture is without a key, which would bring all of those to one task
    joined = captures.join(bodies, F.coalesce("response.refers_to", "capture_id") == F.col("_of"), "left")
    return joined.withColumnsRenamed({"_n": "payload_bytes", "_sha": "payload_digest"}).drop("_of")


def digest(pages: DataFrame) -> DataFrame:
    """What is read back from the archives of ``pages``, by page.

    Every row is a capture of its own: rows that repeat a ``page_id`` or have none come back as often as they occur. Null and empty
    html are responses of 0 bytes; a null ``page_id`` comes back as null; pages are stored whole, however long. An empty table gives an empty result.
    """
    spark, path = pages.sparkSession, shared_folder(pages.sparkSession)
    write(pages, path)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+):", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    # archives are parsed once: what is kept of a record is some hundred bytes
    found = stored(read(spark, path, bodies=False).drop("body").withColumn("body", F.lit(None).cast("binary")))
    return resolved(assemble(found)).select(
        number(F.col("capture_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("response.type").alias("record_type"),
        number(F.col("response.refers_to")).alias("refers_to"),
    )


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY sha1(body)) AS largest,
             row_number() OVER (PARTITION BY sha1(body) ORDER BY page_id DESC NULLS LAST) AS place FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND place > 1 THEN largest END AS refers_to
FROM d
"""
