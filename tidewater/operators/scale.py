"""What operators share to stay whole on a cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary folder for a local master, where it is unset (tests), and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or tempfile.mkdtemp(prefix="spark-tidewater-")).rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder there."""
    return f"{shared_base(spark)}/files-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written to the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return df.checkpoint()


def by_ranges(df: DataFrame, parts: int | None, *order: Column) -> DataFrame:
    """Rows dealt to ranges of ``order``: as many as a shuffle has partitions, which Spark makes fewer where rows are few, unless ``parts`` says how many."""
    return df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)


def carried(parts: DataFrame, key: str, **what: Column) -> DataFrame:
    """``_key``, ``_of`` and the aggregates ``what`` over the ranges before, for keys that lie in several; ``parts`` has a row for each ``key`` and range ``_part``.

    Rows are in ranges of (key, ...), so a range goes on with at most one key of those before it, and there are fewer rows than ranges.
    """
    w = Window.partitionBy(key).orderBy("_part")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), *(c.over(earlier).alias(name) for name, c in what.items()), F.row_number().over(w).alias("_n")).where("_n > 1").drop("_n")


def with_carried(ranged: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """``ranged`` with what ``carried`` found, null where a key begins in its range; broadcast, as it has fewer rows than there are ranges."""
    return ranged.join(F.broadcast(before), (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_of", "_key")
