"""Ranks, deciles and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import by_ranges, carried, checkpointed, with_carried


def top_per(df: DataFrame, key: str, n: int, *order: Column | str, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; Spark turns the filter on the rank into a limit by group before the shuffle. ``rank`` names their place, if wanted."""
    name = rank or "_rn"
    x = df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= n)
    return x if rank else x.drop(name)


def keyed_rank(df: DataFrame, key: str, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Positions from 1 within each key, and no task that holds all rows of a large one.

    Rows are dealt to ranges of (key, order), so that a large key is spread over several; each ranks its own rows of a key and adds those
    of the ranges before. Only keys that begin in an earlier range need any: at most one for each range. There are as many ranges as the rows fill partitions of a shuffle, or ``parts``. A null key is a key.
    """
    ranged = checkpointed(by_ranges(df, parts, F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = carried(counts, key, _before=F.sum("_n"))
    rn = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    return with_carried(ranged.withColumn("_rn", rn), before, key).withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_rn")).drop("_part", "_before", "_rn")


def ranked(df: DataFrame, *order: Column | str, by: tuple[str, ...], rank: str = "rank") -> DataFrame:
    """Positions from 1 within ``by``, and the share of rows before (0 for a single row). For whole tables see ``global_rank``."""
    w, whole = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    n = F.count("*").over(whole)
    return df.withColumn(rank, F.row_number().over(w)).withColumn("percentile", F.when(n == 1, 0.0).otherwise((F.col(rank) - 1) / (n - 1)))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Positions from 1 over the whole table, with ``_rows``, the number of rows, and no task that holds all of them.

    Rows are dealt to ranges of the order; each range ranks its own, and adds the rows of the ranges before, of which there
    is one count each: as many as the rows fill partitions of a shuffle, or ``parts``. The ranges are written to the checkpoint folder, so that both uses see the same ones.
    """
    ranged = checkpointed(by_ranges(df, parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part")  # over one row for each range
    before = counts.select("_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_rows"))
    rn = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + rn).drop("_part", "_before")
