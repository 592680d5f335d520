"""The labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text is divisible by 5. A null id is not held out, and has no label."""
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))


#: Tasks that share the sample, however many the documents take: each returns a vector of sums.
TASKS = 32


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, key: Column | None = None) -> DataFrame:
    """``doc_id``, ``text`` and ``y`` (double) of at most ``sample`` labelled ids that are not held out, one row for each.

    The ids with the lowest hashes are taken, so the sample spreads over the table and reruns agree. An id labelled more than
    once has the mean of its labels; of one that several rows have, the text that is last in the order of bytes is taken, which the tasks
    find among their own rows first, however often it is repeated. As the ids are at most ``sample``, they can be broadcast: the documents are read where
    they are, and only the text of the sample goes on, to a fixed number of tasks, dealt by ``key`` or by the id.
    """
    y = F.col(label).cast("double")
    known = labels.where(F.col("doc_id").isNotNull() & y.isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(y).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("y").alias("y"))
    return one.repartition(TASKS, F.col("doc_id") if key is None else key)
