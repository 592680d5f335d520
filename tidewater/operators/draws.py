"""A store of random draws that a run fills and a later one goes on with.

Draws are rows of (settings, seed, value) in an append-only table. A run looks up which seeds of its settings are missing, has them drawn in blocks, and appends each block as it
is done: stopped at any moment it loses one block. Draws depend on settings and seed alone, so a block that is written twice holds the same rows, and reading takes each
draw once. Draws of other settings are never looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .modelling import day_map

SCHEMA = "settings string, seed long, value double"


def settings_key(settings: dict) -> str:
    """One text for equal settings, whatever their order."""
    return json.dumps(settings, sort_keys=True, separators=(",", ":"))


class DrawStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _all(self) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def read(self, settings: dict) -> DataFrame:
        """``seed`` and ``value`` of the draws with these settings, each once."""
        return self._all().where(F.col("settings") == settings_key(settings)).groupBy("seed").agg(F.first("value").alias("value"))

    def missing(self, settings: dict, seeds: DataFrame) -> DataFrame:
        return seeds.select(F.col("seed").cast("long").alias("seed")).distinct().join(self.read(settings).select("seed"), "seed", "left_anti")

    def fill(self, settings: dict, seeds: DataFrame, draw: Callable[[DataFrame], DataFrame], block: int = 256, most_blocks: int | None = None) -> DataFrame:
        """Draw what is missing of ``seeds`` and return the draws of all of them; ``draw`` takes ``seed`` rows and gives ``seed, value``.

        ``most_blocks`` ends a run early, as if it had been stopped.
        """
        todo = sorted(r.seed for r in self.missing(settings, seeds).collect())  # as many as draws are asked for
        for i in range(0, len(todo), block)[:most_blocks]:
            some = self.spark.createDataFrame([(s,) for s in todo[i : i + block]], "seed long")
            draw(some).select(F.lit(settings_key(settings)).alias("settings"), F.col("seed").cast("long").alias("seed"), F.col("value").cast("double").alias("value")).write.mode("append").parquet(self.path)
        return self.read(settings).join(seeds.select(F.col("seed").cast("long").alias("seed")).distinct(), "seed", "left_semi")


def permuted_agreement(samples: DataFrame, block: int) -> Callable[[DataFrame], DataFrame]:
    """For ``DrawStore.fill``: the share of ``samples`` (``group, day, y``) whose label is that of their group on the day's source day, days permuted in blocks by each seed.

    Samples are counted by group, day and label once; a draw joins those counts to its map of days, so all seeds of a block are one job over counts. The seeds' maps have a row for each seed and day.
    """
    counts = samples.groupBy("group", "day", "y").agg(F.count("*").alias("n")).persist()
    days = [r.day for r in counts.select("day").distinct().orderBy("day").collect()]  # as many as days
    label = counts.groupBy("group", F.col("day").alias("source")).agg(F.max("y").alias("permuted"))
    total = F.sum("n")

    def draw(seeds: DataFrame) -> DataFrame:
        def maps(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame([(int(s), d, q) for s in pdf.seed for d, q in day_map(days, block, int(s)).items()], columns=["seed", "day", "source"])

        mapping = seeds.repartition("seed").mapInPandas(maps, "seed long, day long, source long")
        x = counts.join(mapping, "day").join(label, ["group", "source"], "left")
        return x.groupBy("seed").agg((F.sum(F.when(F.col("y") == F.col("permuted"), F.col("n")).otherwise(0)) / total).alias("value"))

    return draw
