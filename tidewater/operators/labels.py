"""Outcomes of forecasts: triple barriers, splits in time, and sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import overlaps

CLASSES = ("down", "flat", "up")


def triple_barrier(bars: DataFrame, horizon: int, step_ms: int, k: float, cost: float, settled: Column | None = None, same_bar: str = "down") -> DataFrame:
    """``symbol, t, label, touch, ambiguous`` of bars with ``atr``: which barrier the next ``horizon`` bars touch first.

    Barriers are k * ATR / close + cost away. Both in one bar is ``same_bar``, and ambiguous. A gap makes what comes after it unknown, so an earlier
    touch counts and a later one doesn't. A window that is short is missing, unless the series ends by settlement (``settled``).
    """
    w = Window.partitionBy("symbol").orderBy("t").rowsBetween(1, horizon)
    x = bars.withColumn("_next", F.collect_list(F.struct("t", "h", "l")).over(w)).withColumn("_width", k * F.col("atr") / F.col("c") + cost)
    up, low = F.col("c") * (1 + F.col("_width")), F.col("c") * (1 - F.col("_width"))

    def step(s, b):
        live = s["label"].isNull()
        gap = b["t"] - s["t"] != step_ms
        high, under = b["h"] >= up, b["l"] <= low
        hit = F.when(gap, "gap").when(high & under, same_bar).when(high, "up").when(under, "down")
        return F.struct(
            b["t"].alias("t"), F.when(live, hit).otherwise(s["label"]).alias("label"), F.when(live & hit.isNotNull(), b["t"]).otherwise(s["touch"]).alias("touch"),
            F.when(live, F.coalesce(high & under & ~gap, F.lit(False))).otherwise(s["ambiguous"]).alias("ambiguous"),
        )

    start = F.struct(F.col("t").alias("t"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("touch"), F.lit(False).alias("ambiguous"))
    x = x.withColumn("_end", F.aggregate("_next", start, step))
    whole = (F.size("_next") == horizon) | (settled if settled is not None else F.lit(False))
    label = F.when(whole & F.col("_width").isNotNull(), F.when(F.col("_end.label") == "gap", None).otherwise(F.coalesce(F.col("_end.label"), F.lit("flat"))))
    return x.select("symbol", "t", label.alias("label"), F.when(label.isNotNull() & (label != "flat"), F.col("_end.touch")).alias("touch"), F.coalesce(label.isNotNull() & F.col("_end.ambiguous"), F.lit(False)).alias("ambiguous"))


def residual_barrier(bars: DataFrame, horizon: int, beta: Column, width: Column) -> DataFrame:
    """``symbol, t, label``: whether the close, less beta times the benchmark's (``mc``), first leaves the width upwards or downwards."""
    w = Window.partitionBy("symbol").orderBy("t").rowsBetween(1, horizon)
    x = bars.withColumn("_next", F.collect_list(F.struct("c", "mc")).over(w)).withColumns({"_b": beta, "_w": width})
    path = F.transform("_next", lambda b: (b["c"] / F.col("c") - 1) - F.col("_b") * (b["mc"] / F.col("mc") - 1))
    left = F.try_element_at(F.filter(path, lambda p: F.abs(p) >= F.col("_w")), F.lit(1))
    label = F.when(left >= F.col("_w"), "up").when(left <= -F.col("_w"), "down").otherwise("flat")
    return x.select("symbol", "t", F.when((F.size("_next") == horizon) & F.col("_b").isNotNull() & F.col("_w").isNotNull(), label).alias("label"))


def walk_forward(samples: DataFrame, starts: list[tuple[int, int]], embargo: int, earliest_test: int) -> DataFrame:
    """``samples`` by fold with ``role``: test inside [start, end), train if they end an embargo before it, else purged; later ones are out.

    Folds are a short list of literals, so each sample is repeated for the folds that it is not later than. A test that begins before
    ``earliest_test``, in the days on which the rules themselves were chosen, is refused.
    """
    if not starts or min(a for a, _ in starts) < earliest_test:
        raise ValueError("a test period begins before the days that rules were chosen on have ended")
    if any(z <= a for a, z in starts):
        raise ValueError("empty test period")
    folds = F.array(*(F.struct(F.lit(i).alias("fold"), F.lit(a).alias("start"), F.lit(z).alias("until")) for i, (a, z) in enumerate(starts)))
    x = samples.withColumn("f", F.explode(folds)).where(F.col("time") < F.col("f.until"))
    role = F.when(F.col("time") >= F.col("f.start"), "test").when(F.col("end") <= F.col("f.start") - embargo, "train").otherwise("purged")
    return x.select("*", F.col("f.fold").alias("fold"), F.col("f.start").alias("start"), F.col("f.until").alias("until"), role.alias("role")).drop("f")


def fold_violations(x: DataFrame, embargo: int) -> DataFrame:
    """``fold, id, violation`` of samples by fold: learnt from too late, tested outside the block, or both learnt from and tested; none if folds are sound."""
    role = F.col("role")
    wrong = F.array(
        F.when((role == "train") & (F.col("end") > F.col("start") - embargo), "train label reaches into the embargo"),
        F.when((role == "test") & ((F.col("time") < F.col("start")) | (F.col("time") >= F.col("until"))), "test outside its block"),
    )
    each = x.select("fold", "id", F.explode(F.filter(wrong, lambda v: v.isNotNull())).alias("violation"))
    both = x.where(role.isin("train", "test")).groupBy("fold", "id").agg(F.countDistinct("role").alias("n")).where("n = 2")
    return each.unionByName(both.select("fold", "id", F.lit("in both train and test").alias("violation")))


def uniqueness(spans: DataFrame, parts: int | None = None) -> DataFrame:
    """``id, group, weight`` of spans (``id, group, time, end``): the mean over a span's time of one over the spans of its group there; null for one without a length.

    The integral of one over the spans is known wherever a span begins or ends, so a span reads it at both of its ends: as many rows as spans, however long they are.
    """
    at = overlaps(spans.select("group", "time", "end"), parts)
    x = spans.select("id", F.col("group"), "time", "end")
    for side in ("time", "end"):
        y = at.select(F.col("group").alias("_g"), F.col("at").alias("_at"), F.col("area").alias(f"_{side}"))
        x = x.join(y, F.col("group").eqNullSafe(F.col("_g")) & (F.col(side) == F.col("_at")), "left").drop("_g", "_at")
    length = F.col("end") - F.col("time")
    return x.select("id", "group", F.when(length > 0, (F.col("_end") - F.col("_time")) / length).alias("weight"))
