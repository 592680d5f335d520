"""Conditions that stop a job, because going on would give wrong results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def universe(contracts: DataFrame) -> DataFrame:
    """The rows of ``contracts`` (``family, symbol, trading``) that trade; a symbol that trades in more than one family stops the job."""
    x = contracts.where("trading")
    families = x.groupBy("symbol").agg(F.count("*").alias("_n"))
    ok = F.when(F.col("_n") == 1, F.col("symbol")).otherwise(F.raise_error(F.concat(F.lit("more than one contract of the symbol "), F.col("symbol").cast("string"))))
    return x.join(families, "symbol").withColumn("symbol", ok).drop("_n")
