"""Aggregates that keep missing values missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import LARGE, at_ranks


def sum_if_all(c: Column) -> Column:
    """The sum, or null if any member is missing."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def weighted_change(pct: Column, base: Column) -> Column:
    """Percent change of a total, from those of its parts and their opening values; null if one is missing or the base is not above 0."""
    whole = (F.count(pct) == F.count("*")) & (F.count(base) == F.count("*"))
    return F.when(whole & (F.sum(base) > 0), F.sum(base * (1 + pct / 100)) / F.sum(base) * 100 - 100)


def weighted_mean(c: Column, w: Column) -> Column:
    """0 without weight."""
    return F.coalesce(F.sum(c * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0))


def exact_mean(c: Column) -> Column:
    """The mean of numbers as they are written, whatever order they are added in; that of doubles can pass a threshold or not with the order.

    Sums have 18 decimals and 20 digits before; with a number that is not finite or too large for that the mean is that of the doubles.
    """
    number = c.cast("double")
    decimal = F.when(F.abs(number) < 1e19, number.try_cast("decimal(38,18)"))
    total = F.try_sum(decimal)
    return F.coalesce(F.when(F.count(decimal) == F.count(number), total.cast("double") / F.nullif(F.count(number), F.lit(0))), F.avg(number))


def floor_quantile(df: DataFrame, key: str, value: str, p: float, large: int = LARGE) -> DataFrame:
    """``key`` and ``value``: the value at floor(p * n) of each key's sorted ones, without interpolation. Keys of ``large`` rows and more are counted, not sorted."""
    x = at_ranks(df, F.col(key), F.col(value), {"at": F.least(F.col("n") - 1, F.floor(F.col("n") * p))}, large)
    return x.select(F.col("key").alias(key), F.col("at").cast(df.schema[value].dataType).alias(value))


def quantiles(df: DataFrame, key: str, value: str, large: int = LARGE, **at: float) -> DataFrame:
    """``key`` and for each name in ``at`` the quantile there of the key's values, interpolated between neighbours; keys without a value are out.

    Keys of ``large`` rows and more are counted, not sorted.
    """
    v = F.col(value).cast("double")
    x = at_ranks(df.where(~F.isnan(v)), F.col(key), v, {f"{name}_{side}": f((F.col("n") - 1) * F.lit(p)) for name, p in at.items() for side, f in (("low", F.floor), ("high", F.ceil))}, large)
    return x.select(F.col("key").alias(key), *(_between(name, p).alias(name) for name, p in at.items()))


def _between(name: str, p: float) -> Column:
    h = (F.col("n") - 1) * F.lit(p)
    part = h - F.floor(h)
    return F.col(f"{name}_low") * (1 - part) + F.col(f"{name}_high") * part


def global_quantile(df: DataFrame, value: str, p: float, large: int = LARGE) -> DataFrame:
    """One row with ``value``: the interpolated quantile of a whole table; null for an empty one."""
    x = quantiles(df.select(F.lit(0).alias("_k"), F.col(value)), "_k", value, large, at=p)
    return x.agg(F.max("at").alias(value))


def modal_gap(df: DataFrame, key: str, time: str) -> DataFrame:
    """The most frequent gap between consecutive times of a key; of equally frequent ones the smallest."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(key).orderBy(time))
    n = df.select(key, gap.alias("gap")).where("gap is not null").groupBy(key, "gap").agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by("gap", F.struct(-F.col("n"), F.col("gap"))).alias("gap"))


def skill(p: Column, reference: Column, w: Column) -> Column:
    """1 - weighted mean of p over that of the reference; null if the latter is 0."""
    return 1 - F.sum(p * w) / F.nullif(F.sum(reference * w), F.lit(0.0))


def unanimous(c: Column) -> Column:
    """The common value, "untested" without any, "mixed" if they differ."""
    return F.when(F.count(c) == 0, "untested").when(F.min(c) == F.max(c), F.min(c)).otherwise("mixed")


def regime_days(values: DataFrame, by: str) -> DataFrame:
    """``by``, ``axis`` and the distinct days with a low, mid and high value (``by, axis, day, bin``); all null where a day has two values on any axis."""
    d = values.groupBy(by, "axis", "day").agg(F.min("bin").alias("bin"), (F.min("bin") != F.max("bin")).alias("conflict"))
    bad = d.groupBy(by).agg(F.bool_or("conflict").alias("bad"))
    count = lambda k: F.when(~F.bool_or("bad"), F.count_if(F.col("bin") == k)).alias(k)
    return d.join(bad, by).groupBy(by, "axis").agg(*(count(k) for k in ("low", "mid", "high")))


def rates_by(df: DataFrame, complete: Column, **kinds: Column) -> DataFrame:
    """``kind, bucket, n, complete``: rows and the share that is complete in each bucket of each kind, in one pass."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("bucket")) for k, c in kinds.items()))
    x = df.select(F.when(complete, 1.0).otherwise(0.0).alias("_c"), F.inline(each))
    return x.groupBy("kind", "bucket").agg(F.count("*").alias("n"), F.avg("_c").alias("complete"))
