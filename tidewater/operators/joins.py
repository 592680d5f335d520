"""Joins with a meaning: as-of, unique match, outer diff, overlap, and lookups with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import by_ranges, carried, checkpointed, with_carried


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], parts: int | None = None) -> DataFrame:
    """Each left row with the ``values`` of the last right row of its key that is not later; null if there is none.

    Both sides are put in one order by (key, time), and the last right row is carried forward: linear in the rows, where a range join would pair each left row
    with all earlier right ones. Rows are dealt to ranges of that order, so a key with most of the rows is spread over several; a range that goes on with a key gets the last right row of
    the ranges before, of which there is one for each range. At the same time right rows come first; among right rows of one time the one with the largest values wins. A null key is a key.
    """
    packed = F.struct(F.col(right_time).alias("_at"), *values)
    l = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(_type(right, right_time, values)).alias("_r"))
    r = right.select(*(F.col(c) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), packed.alias("_r"))
    ranged = checkpointed(by_ranges(l.unionByName(r), parts, F.col(key), F.col("_t"), F.col("_side")).withColumn("_part", F.spark_partition_id()))
    last = ranged.groupBy(key, "_part").agg(F.max("_r").alias("_last"))  # the latest, and of one time the largest
    before = carried(last, key, _before=F.last("_last", ignorenulls=True))
    w = Window.partitionBy(key, "_part").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = with_carried(ranged.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1"), before, key).withColumn("_r", F.coalesce("_r", "_before"))
    return found.select(*left.columns, *(F.col(f"_r.{v}").alias(v) for v in values))


def _type(df: DataFrame, time: str, values: list[str]) -> str:
    return df.select(F.struct(F.col(time).alias("_at"), *values).alias("x")).schema["x"].dataType.simpleString()


def unique_match(left: DataFrame, right: DataFrame, key: str, ok: Column) -> DataFrame:
    """Left rows with the right row of their key, if the key has exactly one there and ``ok`` holds; else nulls."""
    alone = right.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")
    joined = left.join(alone, key, "left")
    return joined.select(*left.columns, *(F.when(ok, F.col(c)).alias(c) for c in right.columns if c != key))


def position_changes(before: DataFrame, after: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Events between two snapshots of ``address, coin, side, notional``: opened, closed, reversed, increased, reduced.

    Only addresses that the first snapshot knows are compared: without a base, a position is not new but first seen.
    """
    b = before.select("address", "coin", F.col("side").alias("from_side"), F.col("notional").alias("from_notional"))
    a = after.select("address", "coin", F.col("side").alias("to_side"), F.col("notional").alias("to_notional"))
    a = a.join(before.select("address").distinct(), "address", "left_semi")
    x = b.join(a, ["address", "coin"], "full_outer")
    moved = F.abs(F.col("to_notional") - F.col("from_notional")) / F.col("from_notional") >= threshold
    kind = (
        F.when(F.col("from_side").isNull(), "opened").when(F.col("to_side").isNull(), "closed").when(F.col("from_side") != F.col("to_side"), "reversed")
        .when((F.col("from_notional") > 0) & moved, F.when(F.col("to_notional") > F.col("from_notional"), "increased").otherwise("reduced"))
    )
    return x.withColumn("type", kind).where("type is not null")


def overlaps(spans: DataFrame, parts: int | None = None) -> DataFrame:
    """``group, since, at, n, area``: from ``since`` to ``at`` there are ``n`` spans (``group, time, end``, half-open), and the integral of 1/n up to ``at`` is ``area``.

    A span adds one where it begins and takes one where it ends, so there is a row for each time at which any does; where there is none the integral stands still. Running sums
    over the ends replace pairs of spans. Ends are dealt to ranges of (group, time), and what a group has before a range is added, so a large group is spread over several.
    """
    ends = spans.select("group", F.explode(F.array(F.struct(F.col("time").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.select("group", "e.at", "e.d").groupBy("group", "at").agg(F.sum("d").alias("d"))
    ranged = checkpointed(by_ranges(ends, parts, F.col("group"), F.col("at")).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("group", "_part").orderBy("at")
    zero = lambda c: F.coalesce(c, F.lit(0))
    before = carried(ranged.groupBy("group", "_part").agg(F.sum("d").alias("d"), F.max("at").alias("last")), "group", _n0=F.sum("d"), _last=F.max("last"))
    x = with_carried(ranged, before, "group").select("group", "_part", "at", F.coalesce(F.lag("at").over(here), "_last").alias("since"), (zero(F.col("_n0")) + F.sum("d").over(here) - F.col("d")).alias("n"))
    x = x.withColumn("piece", F.when(F.col("n") > 0, (F.col("at") - F.col("since")) / F.col("n")).otherwise(0.0))
    before = carried(x.groupBy("group", "_part").agg(F.sum("piece").alias("piece")), "group", _area=F.sum("piece"))
    return with_carried(x, before, "group").select("group", "since", "at", "n", (zero(F.col("_area")) + F.sum("piece").over(here)).alias("area"))


def overlap_counts(spans: DataFrame, step_ms: int) -> DataFrame:
    """``group, slot, n``: how many spans (``group, time, end``, half-open) cover each slot of time that any covers."""
    slots = F.sequence(F.col("since"), F.col("at") - step_ms, F.lit(step_ms))
    return overlaps(spans).where("n > 0").select("group", F.explode(slots).alias("slot"), "n")


def reconciled(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """How two versions of a table differ: rows of one alone, and common rows that agree or not."""
    left, right = a.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(1).alias("_a")), b.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(1).alias("_b"))
    same = F.lit(True)
    for v in values:
        same = same & (F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) <= tolerance * F.greatest(F.lit(1.0), F.abs(f"b_{v}")))
    state = F.when(F.col("_a").isNull(), "only right").when(F.col("_b").isNull(), "only left").when(same, "same").otherwise("differs")
    return left.join(right, keys, "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def with_fallback(new: DataFrame, old: DataFrame, key: str, complete: str, value: str) -> DataFrame:
    """The new value where it is complete, else the last complete one with a mark, else the partial one."""
    o = old.where(complete).select(key, F.col(value).alias("_old"))
    use_old = (~F.col(complete)) & F.col("_old").isNotNull()
    return new.join(o, key, "left").select(key, F.when(use_old, F.col("_old")).otherwise(F.col(value)).alias(value), use_old.alias("stale"))
