"""Candles: from ticks, from raw rows, and from finer candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import candle_flow, floor_to, to_number

#: Positional columns of a raw candle row, all text.
RAW = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_base", "taker_quote", "ignore")


def from_events(events: DataFrame, step_ms: int, symbol: Column | None = None) -> DataFrame:
    """Bars ``symbol, t, o, h, l, c, v, tb, trades`` of ticks (``ts, event_id, event_type, value, props``).

    One hash aggregation with partial sums: opening and closing prices are kept as the values of the least and greatest
    (time, id), so nothing is sorted and a hot symbol is combined before the shuffle.
    """
    order = F.struct("ts", "event_id")
    e = events.select(
        (F.col("event_type") if symbol is None else symbol).alias("symbol"), floor_to(F.unix_millis(F.col("ts").cast("timestamp")), step_ms).alias("t"),
        "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return e.groupBy("symbol", "t").agg(
        F.min_by("value", order).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", order).alias("c"),
        F.sum("value").alias("v"), F.sum(F.when(F.col("k") >= 50, F.col("value")).otherwise(0.0)).alias("tb"), F.count("*").alias("trades"),
    )


def from_raw(raw: DataFrame, cutoff_ms: int, step_ms: int) -> DataFrame:
    """Validated bars of raw candle rows (``symbol, family, fx, contract_size`` and ``RAW`` as text), with ``contiguous``.

    Kept are rows that closed before the cutoff, not before they opened, with a price above 0. A series is contiguous if its bars are
    exactly one step apart and the last one ends at the cutoff. Flows are null where they are unknown or impossible.
    """
    n = {c: to_number(F.col(c)) for c in RAW}
    bars = raw.select("symbol", "family", "fx", "contract_size", *(n[c].alias(c) for c in RAW))
    bars = bars.where((F.col("close_time") < cutoff_ms) & (F.col("close_time") >= F.col("open_time")) & (F.col("close") > 0))
    w = Window.partitionBy("symbol").orderBy("open_time")
    gap = F.col("open_time") - F.lag("open_time").over(w)
    bars = bars.withColumn("ok", F.coalesce(gap == step_ms, F.lit(True)))
    whole = Window.partitionBy("symbol")
    contiguous = F.bool_and("ok").over(whole) & (F.max("close_time").over(whole) == cutoff_ms - 1)
    row = {k: F.col(k) for k in ("quote_volume", "taker_quote", "volume", "taker_base")}
    flow = candle_flow(F.col("family"), row, F.col("fx"), F.col("contract_size"))
    return bars.select(
        "symbol", F.col("open_time").cast("long").alias("t"), F.col("close_time").cast("long").alias("ct"), F.col("open").alias("o"), F.col("high").alias("h"),
        F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("trades"), flow.alias("flow"), contiguous.alias("contiguous"),
    )


def coarser(bars: DataFrame, step_ms: int, factor: int) -> DataFrame:
    """Bars of ``factor`` steps; only complete groups of aligned bars."""
    big = step_ms * factor
    g = bars.withColumn("slot", floor_to(F.col("t"), big)).groupBy("symbol", "slot").agg(
        F.count("*").alias("n"), F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"),
        F.sum("v").alias("v"), F.sum("tb").alias("tb"), F.sum("trades").alias("trades"), F.bool_and(F.col("t") % step_ms == 0).alias("aligned"),
    )
    return g.where(f"n = {factor} and aligned").withColumnRenamed("slot", "t").drop("n", "aligned")


def gaps(bars: DataFrame, step_ms: int) -> DataFrame:
    """Where consecutive bars of a symbol are not one step apart; reported, never filled."""
    after = F.lag("t").over(Window.partitionBy("symbol").orderBy("t"))
    return bars.select("symbol", after.alias("after"), F.col("t").alias("next")).where(F.col("next") - F.col("after") != step_ms)


def series_facts(bars: DataFrame, step_ms: int, end_ms: int) -> DataFrame:
    """Counts by symbol: bars, gaps, bars that contradict themselves, and steps missing at the end."""
    w = Window.partitionBy("symbol").orderBy("t")
    x = bars.withColumn("gap", F.coalesce(F.col("t") - F.lag("t").over(w) != step_ms, F.lit(False)))
    bad = (F.col("h") < F.greatest("o", "c", "l")) | (F.col("l") > F.least("o", "c", "h"))
    return x.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count_if("gap").alias("gaps"), F.count_if(bad).alias("bad"), ((end_ms - F.max("t")) / step_ms).cast("long").alias("short_of_end")
    )


#: Bars without a trade in a row that show that a contract is dead. Fixed value.
FROZEN_RUN = 24


def trimmed(bars: DataFrame, step_ms: int, min_run: int = FROZEN_RUN, keep_partial_last: bool = False) -> DataFrame:
    """By symbol what is left of a contract that was taken off (``symbol, t, o, h, l, c, v, trades, delivery``), and why the rest is not.

    A frozen bar has no volume and no trade, and one price. Bars are cut at the first of the delivery (null: none) and the first ``min_run`` frozen bars in a
    row; frozen bars at the very end of what is left go too, those before a live bar stay. With ``keep_partial_last`` the bar that the delivery falls
    into is kept, and named, because it ends the path of a label; no decision may be taken on it.
    """
    series, by = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("t")
    frozen = (F.col("v") == 0) & (F.col("trades") == 0) & (F.col("o") == F.col("h")) & (F.col("h") == F.col("l")) & (F.col("l") == F.col("c"))
    x = bars.withColumn("frozen", F.coalesce(frozen, F.lit(False))).withColumn("i", F.row_number().over(by) - 1)
    x = x.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("symbol", "frozen").orderBy("t")))
    x = x.withColumn("run", F.count("*").over(Window.partitionBy("symbol", "frozen", "g"))).withColumn("n", F.count("*").over(series))
    before = F.col("t") < F.col("delivery") if keep_partial_last else F.col("t") + step_ms <= F.col("delivery")
    x = x.withColumn("del", F.count_if(F.coalesce(before, F.lit(True))).over(series))
    x = x.withColumn("sig", F.coalesce(F.min(F.when(F.col("frozen") & (F.col("run") >= min_run), F.col("i"))).over(series), F.col("n")))
    x = x.withColumn("first", F.least("del", "sig"))
    x = x.withColumn("cut", F.coalesce(F.max(F.when(~F.col("frozen") & (F.col("i") < F.col("first")), F.col("i") + 1)).over(series), F.lit(0)))
    why = F.when(F.col("del") == F.col("sig"), "both").when(F.col("del") < F.col("sig"), "delivery").otherwise("signature")
    trailing = F.col("cut") < F.col("first")
    cut_by = F.when(F.col("first") == F.col("n"), F.when(trailing, "trailing")).otherwise(F.concat(why, F.when(trailing, "+trailing").otherwise("")))
    partial = F.when((F.col("i") == F.col("cut") - 1) & (F.col("t") + step_ms > F.col("delivery")), F.col("t")) if keep_partial_last else F.lit(None).cast("long")
    one = lambda c: F.max(c)  # noqa: E731 - the same on all rows of a symbol
    return x.groupBy("symbol").agg(
        one("cut").cast("long").alias("kept"), one(cut_by).alias("cut_by"), F.max(F.when(F.col("i") == F.col("cut"), F.col("t"))).alias("cut_at"), one(F.col("n") - F.col("del")).alias("by_delivery"), one(F.col("n") - F.col("sig")).alias("by_signature"),
        one(F.col("first") - F.col("cut")).cast("long").alias("by_trailing"), F.count_if(F.col("frozen") & (F.col("i") < F.col("cut"))).alias("still_inside"), F.max(partial).alias("partial_last"),
    )
