"""Values at given ranks of large keys, without sorting their rows.

A number's bits, with the sign turned round, are in the order of the numbers. Four passes over a key's rows each count 16 further bits of those that can still be
the value looked for, for all keys and ranks at once: counts are combined by the tasks before they are moved, so a key with most of the rows is spread over all tasks, and no pass
moves more than 65,536 counts for each task, key and rank. Keys of fewer rows than ``LARGE`` are sorted, in tasks of about ``SORTED`` rows however many rows there are.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import checkpointed

#: Rows from which a key's values are counted instead of sorted.
LARGE = 1 << 20
#: Rows that a task sorts, on average.
SORTED = 1 << 20
_DIGIT, _LEVELS = 16, 4
_SIGN = np.int64(np.iinfo(np.int64).max)


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """Whole numbers in the order of doubles; 0.0 and -0.0 are one, NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> np.int64(63)) & _SIGN))


@F.pandas_udf(T.DoubleType())
def _from_bits(u: pd.Series) -> pd.Series:
    bits = u.to_numpy(np.int64)
    return pd.Series((bits ^ ((bits >> np.int64(63)) & _SIGN)).view(np.float64))


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def counted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key``, ``name``, ``u`` and ``before``: the value at the 0-based ``rank`` of its key, and how many values are below it.

    ``rows`` are ``key``, ``u`` (long); ``wanted`` are ``key``, ``name``, ``rank`` (below the key's number of rows), as few as large keys and ranks, and are broadcast.
    """
    now = wanted.select(F.col("key").alias("k"), "name", "rank", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(_LEVELS):
        rest = 64 - _DIGIT * (level + 1)
        head = F.shiftright("u", rest)  # signed, so it is in order
        prefix = F.shiftright("u", rest + _DIGIT) if level else F.lit(0).cast("long")
        some = now.select("k", "prefix").distinct()
        met = rows.select("key", prefix.alias("p"), head.alias("head")).join(F.broadcast(some), F.col("key").eqNullSafe(F.col("k")) & (F.col("p") == F.col("prefix")))
        counts = met.groupBy("k", "prefix", "head").agg(F.count("*").alias("n"))
        w = Window.partitionBy("k", "prefix").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)  # over at most 65,536 counts
        counts = counts.withColumn("less", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long"))).withColumnsRenamed({"k": "ck", "prefix": "cp"})
        at = F.col("rank") - F.col("before")
        found = counts.join(F.broadcast(now), F.col("ck").eqNullSafe(F.col("k")) & (F.col("cp") == F.col("prefix")) & (F.col("less") <= at) & (at < F.col("less") + F.col("n")))
        now = checkpointed(found.select("k", "name", "rank", F.col("head").alias("prefix"), (F.col("before") + F.col("less")).alias("before")))
    return now.select(F.col("k").alias("key"), "name", F.col("prefix").alias("u"), "before")


def at_ranks(df: DataFrame, key: Column, value: Column, ranks: dict[str, Column], large: int = LARGE) -> DataFrame:
    """``key``, ``n`` (its rows) and for each name in ``ranks`` the value there and ``<name>_before``, the number of rows below it.

    ``ranks`` are 0-based, as expressions of ``n``. Null values don't count; keys without a value are out, and a null key is a key. Values keep their type if they are whole numbers
    and are doubles else.
    """
    exact = _whole(df.select(value.alias("v")).schema["v"].dataType)
    x = df.select(key.alias("key"), (value.cast("long") if exact else value.cast("double")).alias("v")).where("v is not null")
    counts = x.groupBy("key").agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()

    def light(rows: DataFrame) -> DataFrame:
        # tasks of about a million rows, each sorted once; only the rows at a rank go on
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // SORTED))
        by = Window.partitionBy("key").orderBy("v")
        n = F.count("*").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rows = rows.repartition(tasks, "key").select("key", "v", n.alias("n"), (F.row_number().over(by) - 1).alias("i"), (F.rank().over(by) - 1).cast("long").alias("below"))
        at = {name: F.col("i") == r for name, r in ranks.items()}
        each = (F.max(F.when(here, F.col(c))).alias(out) for name, here in at.items() for c, out in (("v", name), ("below", f"{name}_before")))
        return rows.where(functools.reduce(Column.__or__, at.values())).groupBy("key", "n").agg(*each)

    if most is None or most < large:
        return light(x)
    heavy = checkpointed(counts.where(F.col("n") >= large))  # at most one key for ``large`` rows
    keys = F.broadcast(heavy.select(F.col("key").alias("k")))
    mine = checkpointed(x.join(keys, F.col("key").eqNullSafe(F.col("k"))).select("key", (F.col("v") if exact else ordered_bits("v")).alias("u")))
    wanted = heavy.select("key", "n", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()))).alias("w")).select("key", "w.name", "w.rank")
    found = counted(mine, checkpointed(wanted)).withColumn("v", F.col("u") if exact else _from_bits("u"))
    picked = found.groupBy("key").agg(*(F.max(F.when(F.col("name") == name, F.struct("v", "before"))).alias(name) for name in ranks))
    flat = picked.select("key", *(c for name in ranks for c in (F.col(f"{name}.v").alias(name), F.col(f"{name}.before").alias(f"{name}_before"))))
    whole = flat.withColumnRenamed("key", "k").join(heavy, F.col("k").eqNullSafe(F.col("key"))).drop("k")
    rest = light(x.join(keys, F.col("key").eqNullSafe(F.col("k")), "left_anti"))
    return rest.unionByName(whole.select(rest.columns))


def edges(df: DataFrame, value: str, tie: str, ranks: list[int], descending: bool = False, large: int = LARGE) -> list[tuple]:
    """The (value, tie) at each of ``ranks`` (0-based) of a whole table in order of value, or the opposite, and then ``tie``, a whole number; a few rows for the driver."""
    if not ranks:
        return []
    v = -F.col(value) if descending else F.col(value)
    x = df.select(v.cast("double").alias("v"), F.col(tie).cast("long").alias("tie"))
    one = at_ranks(x, F.lit(0), F.col("v"), {f"e{i}": F.lit(r) for i, r in enumerate(ranks)}, large).first()
    if one is None:
        return []
    at = [(one[f"e{i}"], r - one[f"e{i}_before"]) for i, r in enumerate(ranks)]
    # among the rows of an edge's value, the one at what is left of the rank
    among = x.join(F.broadcast(df.sparkSession.createDataFrame(sorted({(a,) for a, _ in at}), "at double")), F.col("v") == F.col("at"))
    names = {f"e{i}": (a, left) for i, (a, left) in enumerate(at)}
    picked = {r.key: r for r in at_ranks(among, F.col("at"), F.col("tie"), {name: F.lit(left) for name, (_, left) in names.items()}, large).collect()}
    return [((-a if descending else a), picked[a][name]) for name, (a, _) in names.items()]


def equal_bins(df: DataFrame, bins: int, value: str, tie: str, descending: bool = False, name: str = "bin", large: int = LARGE) -> DataFrame:
    """Bins of equal frequency over a whole table in order of ``value`` and ``tie``: a row's bin is floor(((rank) * bins - 1) / n) of its rank from 1.

    The first row of each bin is selected; rows are then held against these few, so none is sorted or moved. ``df`` is read a few times and should be stored. Rows with a null value are out.
    """
    df = df.where(F.col(value).isNotNull())
    n = df.count()
    first = sorted({-(-(b * n + 1) // bins) - 1 for b in range(1, bins)} - {0})
    at = edges(df, value, tie, [r for r in first if r < n], descending, large) if n else []
    v, t = F.col(value), F.col(tie)
    rank = [r for r in first if r < n]
    out = F.lit(bins - 1).cast("long")
    for (a, i), r in zip(at, rank):
        beyond = (v < F.lit(a)) if descending else (v > F.lit(a))
        out = F.when(beyond | ((v == F.lit(a)) & (t >= F.lit(i))), F.lit((r + 1) * bins - 1).cast("long")).otherwise(out)
    return df.withColumn(name, F.floor(out / max(n, 1)).cast("int"))
