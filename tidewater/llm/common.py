"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that Python's ``bytes.split()`` treats as blanks: 0x20 and 0x09 to 0x0D, the same as this class.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset a temporary folder serves a local master (tests); on a cluster it would be a folder of one machine, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='spark-tidewater-')).rstrip('/')}/tidewater-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage is cut, and the planner knows the size."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that no later job reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def rows_in(df: DataFrame, each: int) -> int:
    """How many partitions of about ``each`` rows a ``stored`` table fills (its files know their number of rows)."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], matches: str, most: int = 10_000) -> DataFrame:
    """``rows``, which are stored, left-joined with ``table``, which is stored too, has a row for each key and in ``matches`` how many rows have it.

    Keys that one in ``most`` rows or more have, of which there are ``most`` at the utmost, are broadcast, so that their rows stay where they are; only the others meet by key.
    """
    bound = max(rows.count() // most, 1_000)
    hot, rest = F.broadcast(table.where(F.col(matches) > bound)), table.where(F.col(matches) <= bound)
    met = rows.join(hot.drop(matches), keys)
    return met.unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest.drop(matches), keys, "left"))


def with_row_ids(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` stored with an id for each row, repeated ones too, that stays the same whenever the table is read."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows in smaller batches, for work that needs a multiple of a batch's memory."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``f`` on each Arrow batch; batches are independent, so a lost task is simply run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield f(batch)

    return df.mapInArrow(run, schema)


def summed(parts: DataFrame) -> DataFrame:
    """Element-wise sums of float64 vectors, in levels.

    ``parts`` has ``key`` (string) and ``vec`` (binary, float64, one length per key), a row per key and task. A key's rows are dealt by task to as many
    partitions as a shuffle has, their sums to the square root of that, and so on. Tasks stream rows that are sorted by key and hold one vector.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        row = lambda k, v: pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.tobytes()], pa.binary())], ["key", "vec"])
        now, total = None, None
        for batch in slices(batches):
            for key, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(vec)
                if key == now:
                    total += v
                else:
                    if total is not None:
                        yield row(now, total)
                    now, total = key, v.copy()
        if total is not None:
            yield row(now, total)

    level, width = parts.select("key", "vec"), int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while width > 8:
        level = level.repartition("key", F.spark_partition_id() % width).sortWithinPartitions("key").mapInArrow(add, "key string, vec binary")
        width = int(width**0.5)
    return level.repartition("key").sortWithinPartitions("key").mapInArrow(add, "key string, vec binary")


def with_text(found: DataFrame, docs: DataFrame, changed: Column, text: Column, more: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` from the struct ``row`` of ``found``, with another text where it changed; ``n_chars``, if there is one, follows, and then the columns ``more``."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    old = {c: F.col(f"row.`{c}`") for c in docs.columns}
    return found.select(*(F.when(changed, new[c]).otherwise(old[c]).alias(c) if c in new else old[c].alias(c) for c in docs.columns), *(more or []))
