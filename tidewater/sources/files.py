"""Reading landed files, with explicit schemas, and publishing results."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import csv_quoted, to_number
from ..operators.bars import RAW
from ..operators.rules import present


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def klines_csv(spark: SparkSession, path: str) -> DataFrame:
    """Candle rows of CSV archives, as text columns; headers and rows whose first field isn't a time in ms, or that are short, are left out."""
    schema = ", ".join(f"{c} string" for c in RAW)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path).where(F.col("open_time").rlike("^[0-9]{13}$") & F.col("taker_quote").isNotNull())


def funding_csv(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.schema("time string, hours string, rate string").csv(path).where(F.col("time").rlike("^[0-9]{13}$"))
    return x.select(F.col("time").cast("long"), to_number(F.col("hours")).cast("int").alias("hours"), to_number(F.col("rate")).alias("rate"))


SERIES = "symbol string, interval string, start long, end long, source string, rows array<array<string>>, _corrupt string"


def series_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents of one series each; ``_corrupt`` holds what couldn't be read, so that it can be counted and is not fatal."""
    return spark.read.schema(SERIES).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def series_rows(series: DataFrame) -> DataFrame:
    """One row for each candle of readable documents, with its position in the document."""
    x = series.where("_corrupt is null").select("symbol", "interval", F.posexplode("rows").alias("i", "row"))
    return x.select("symbol", "interval", "i", *(F.try_element_at("row", F.lit(k + 1)).alias(c) for k, c in enumerate(RAW)))


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_ndjson(df: DataFrame, path: str) -> None:
    """One document for each row, added to those that are there."""
    df.write.mode("append").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """All fields in quotes, quotes doubled, missing ones empty; a header in each file.

    Nulls and empty text look alike, as in any CSV of this kind.
    """
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.option("quoteAll", True).option("escape", '"').option("header", True).csv(path)


def csv_line(df: DataFrame) -> Column:
    return F.concat_ws(",", *(csv_quoted(F.col(c)) for c in df.columns))


def _pointers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the pointers in a folder."""
    path, fs = _fs(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(m[1]) for m in (re.fullmatch(r"latest-(\d+)\.json", n) for n in names) if m)


def publish(df: DataFrame, folder: str, run: str) -> None:
    """Write a run's files and then a pointer at them with the next number: readers, who take the highest, see the old run or the new one, whole.

    A pointer is written beside and renamed to a name that no other has, so there is never a moment without one; who loses a race for a number takes the next.
    """
    spark = df.sparkSession
    df.write.parquet(f"{folder}/runs/{run}")
    tmp, fs = _fs(spark, f"{folder}/.latest-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps({"run": run}).encode()))
    out.close()
    number = max(_pointers(spark, folder), default=0)
    while True:
        number += 1
        target, _ = _fs(spark, f"{folder}/latest-{number:09d}.json")
        if not fs.exists(target) and fs.rename(tmp, target):
            return


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The run that the highest pointer is at."""
    run = spark.read.schema("run string").json(f"{folder}/latest-{max(_pointers(spark, folder)):09d}.json").first().run
    return spark.read.parquet(f"{folder}/runs/{run}")


def write_text(spark: SparkSession, lines: Iterator[str] | list[str], path: str) -> None:
    """A small text file, as reports are."""
    target, fs = _fs(spark, path)
    out = fs.create(target, True)
    out.write(bytearray("".join(f"{line}\n" for line in lines).encode()))
    out.close()


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """``name`` (below ``path``), ``length`` and ``content`` of all files."""
    name = F.regexp_extract("path", f"/{re.escape(path.rstrip('/').rpartition('/')[2])}/(.+)$", 1)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(name.alias("name"), "length", "content")


def verified(spark: SparkSession, path: str, checksums: DataFrame) -> DataFrame:
    """``name, status, content`` of files against published SHA-256 sums (``name, sha256``): ok, mismatch or missing; only ok ones have content.

    Tasks hash the files that they read.
    """
    x = checksums.join(_contents(spark, path).withColumn("_sha", F.sha2("content", 256)), "name", "left")
    status = F.when(F.col("_sha").isNull(), "missing").when(F.col("_sha") == F.col("sha256"), "ok").otherwise("mismatch")
    return x.select("name", status.alias("status"), F.when(F.col("_sha") == F.col("sha256"), F.col("content")).alias("content"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``name, bytes, sha256`` of the files under a path."""
    return _contents(spark, path).select("name", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def with_provenance(df: DataFrame, expected: str) -> DataFrame:
    """``df``, whose rows must come from the expected source; any other row stops the job that meets it."""
    ok = F.when(F.col("source") == expected, F.col("source")).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected} data, found "), F.coalesce("source", F.lit("none")))))
    return df.withColumn("source", ok)


def paged_rows(rows: DataFrame, limit: int, step_ms: int) -> DataFrame:
    """What a paginated collector ends up with of ``rows`` (``symbol, t, start, end`` and more): each page is fetched from its cursor on, its last row is
    also the first of the next, and a row counts once, the first time that it is seen; ``place`` is its order within the symbol."""
    page = limit * step_ms
    n = F.floor((F.col("t") - F.col("start")) / page)
    edge = (F.col("t") - F.col("start")) % page == 0
    pages = F.when(edge & (n > 0), F.array(n - 1, n)).otherwise(F.array(n))
    fetched = rows.where("t >= start and t < end").withColumn("page", F.explode(pages))
    seen = fetched.groupBy("symbol", "t").agg(F.min("page").alias("page"), F.count("*").alias("fetched"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("t")))


def pages_of(starts: DataFrame, limit: int, step_ms: int) -> DataFrame:
    """The requests of a paginated range (``symbol, start, end``): one row for each page of ``limit`` steps."""
    page = limit * step_ms
    x = starts.where("start < end").select("symbol", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(page))).alias("from"))
    return x.select("symbol", "from", F.least(F.col("from") + page, "end").alias("until"))


class RunLock:
    """An exclusive file: a second run that finds it stops. The file system creates it or fails, in one step."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.fs = _fs(spark, path)

    def __enter__(self) -> RunLock:
        self.fs.create(self.path, False).close()
        return self

    def __exit__(self, *_) -> None:
        self.fs.delete(self.path, False)


def listing(xml: Column) -> Column:
    """array<struct<symbol, month>> of the archives in an S3-style listing."""
    keys = F.regexp_extract_all(xml, F.lit(r"<Key>([^<]+\.zip)</Key>"), F.lit(1))
    name = r"([^/]+)-([0-9]{4}-[0-9]{2})\.zip$"
    return F.transform(keys, lambda k: F.struct(F.regexp_extract(k, name, 1).alias("symbol"), F.regexp_extract(k, name, 2).alias("month")))


#: What a symbol may be named. Fixed pattern.
SYMBOL = r"^[\p{L}\p{N}_]{2,40}$"


def symbols(text: Column) -> Column:
    """The allowed names in a list separated by commas and blanks, without comments, each once, in order."""
    bare = F.regexp_replace(text, r"#[^\n]*", " ")
    return F.array_distinct(F.filter(F.split(bare, r"[,\s]+"), lambda s: s.rlike(SYMBOL)))


def report(rows: list, title: str, top: int = 10) -> Iterator[str]:
    """Markdown lines of a small result."""
    yield f"# {title}"
    for i, row in enumerate(rows[:top], 1):
        yield f"{i}. " + " | ".join(f"{k}: {v}" for k, v in row.asDict().items())


def batch_problems(step_ms: int) -> Column:
    """What is wrong with the files of a delisted contract, in order.

    Columns: of the hourly candles ``n, unordered, last, source``, how they were cut (``cut_by``, null if not), the ``partial`` last bar and whether it is
    ``partial_eligible`` for decisions; of those of four hours (null if there are none) ``n4, source4, partial4``; the last settlement
    ``funding_last``, and the planned ``delivery``. What is unknown is no problem, but that settlements are missing is.
    """
    c = F.col
    planned, four = c("delivery").isNotNull(), c("n4").isNotNull()
    return present(
        (c("source") != "native", "source of the candles"), (c("n") == 0, "no candles"), (c("unordered") > 0, "candles out of order"), (planned & ~c("cut_by").isin("delivery", "both", "trailing"), "delivery planned but cut otherwise"),
        (~planned & (c("cut_by") == "delivery"), "cut at a delivery that is not planned"), (c("partial") != c("last"), "partial bar is not the last"), (c("partial").isNotNull() & c("partial_eligible"), "partial bar may be decided on"),
        (c("n4") == 0, "no candles of four hours"), (four & (c("source4") != "native"), "source of the candles of four hours"), (four & c("partial4"), "partial bar of four hours"),
        (~(c("funding_last") < F.coalesce("delivery", c("last") + step_ms)), "settlement after the cut"), (c("funding_last").isNull(), "no settlements"),
    )


CANDLE_ROWS = "symbol long, t long, source string, partial boolean, eligible boolean"


def candle_facts(spark: SparkSession, path: str) -> DataFrame:
    """Of each ``symbol`` what the candle files under ``path`` (Parquet, ``CANDLE_ROWS``) say: ``n`` rows, how many are ``unordered`` (not later than the row of their symbol before them in the file), the ``last`` time, the ``source``
    (of several the one that isn't native), the time of a ``partial`` bar, and whether one is ``partial_eligible`` for decisions.

    A file is in the order that it was written in; its rows are told apart by their number there.
    """
    rows = spark.read.schema(CANDLE_ROWS).parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = F.lag("t").over(Window.partitionBy("file", "symbol").orderBy("row"))
    x = rows.withColumn("unordered", F.coalesce(F.col("t") <= before, F.lit(False)))
    return x.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if("unordered").alias("unordered"), F.max("t").alias("last"), F.min_by("source", F.struct(F.col("source") == "native", F.col("source"))).alias("source"),
        F.max(F.when(F.col("partial"), F.col("t"))).alias("partial"), F.bool_or(F.col("partial") & F.col("eligible")).alias("partial_eligible"),
    )


def batch_facts(spark: SparkSession, folder: str, plan: DataFrame) -> DataFrame:
    """The columns that ``batch_problems`` judges, by ``symbol``, from the files under ``folder`` (``hours``, ``four_hours`` and ``settlements`` of ``symbol, t``) and the plan (``symbol, delivery, cut_by, four``: whether there is a file of four-hour candles).

    What belongs together is paired by a full join, so a contract that only some of the files or only the plan has is judged too.
    """
    one = candle_facts(spark, f"{folder}/hours")
    four = candle_facts(spark, f"{folder}/four_hours").select("symbol", F.col("n").alias("found4"), F.col("source").alias("source4"), F.col("partial").isNotNull().alias("partial4"))
    settled = spark.read.schema("symbol long, t long").parquet(f"{folder}/settlements").groupBy("symbol").agg(F.max("t").alias("funding_last"))
    x = one.join(four, "symbol", "full_outer").join(settled, "symbol", "full_outer").join(plan, "symbol", "full_outer")
    zero = F.lit(0).cast("long")
    return x.withColumns({"n": F.coalesce("n", zero), "unordered": F.coalesce("unordered", zero), "n4": F.when(F.col("four") | F.col("found4").isNotNull(), F.coalesce("found4", zero))}).drop("four", "found4")
