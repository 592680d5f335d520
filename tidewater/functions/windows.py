"""Expressions over the bars of one symbol in order of time.

All need exact windows: where the frame is short or a value in it is missing, null or not finite, the result is null. With ``step_ms`` the bars of the
frame must be one step apart too, or a gap gives null; without it the rows are taken as they follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalars import change, finite

#: Bars of the trailing window, with those that the mean range before it needs, and the longest run that is counted. Fixed values.
TRAIL, NEED, RUN = 336, 349, 168

def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("t")


def frame(a: int, b: int = 0, w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_time()).rowsBetween(a, b)


def full(c: Column, n: int, w: WindowSpec | None = None, step_ms: int | None = None) -> Column:
    """Whether the last n rows all have a finite value and, with a step, no gap."""
    every = F.count(finite(c)).over(frame(-(n - 1), 0, w)) == n
    return every if step_ms is None else every & contiguous(F.col("t"), n, step_ms, w)


def contiguous(t: Column, n: int, step_ms: int, w: WindowSpec | None = None) -> Column:
    """Whether the last n bars are exactly one step apart.

    Times of a series are distinct multiples of the step, so that n of them span n - 1 steps only without a gap.
    """
    return F.coalesce(t - F.lag(t, n - 1).over(w or by_time()) == (n - 1) * step_ms, F.lit(False))


def true_range(w: WindowSpec | None = None) -> Column:
    previous = F.lag("c").over(w or by_time())
    return F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - previous), F.abs(F.col("l") - previous))


def mean_of(c: str, n: int, w: WindowSpec | None = None, step_ms: int | None = None) -> Column:
    """The plain mean of the last n values."""
    return F.when(full(F.col(c), n, w, step_ms), F.avg(c).over(frame(-(n - 1), 0, w)))


def midrank(c: str, n: int, w: WindowSpec | None = None, step_ms: int | None = None) -> Column:
    """100 times the share of the last n values below the current one, ties counting half."""
    x = F.collect_list(finite(F.col(c))).over(frame(-(n - 1), 0, w))
    v = F.col(c)
    below, same = F.size(F.filter(x, lambda y: y < v)), F.size(F.filter(x, lambda y: y == v))
    return F.when(full(F.col(c), n, w, step_ms), 100.0 * (below + 0.5 * same) / n)


def ema(c: str, period: int, n: int, w: WindowSpec | None = None, step_ms: int | None = None) -> Column:
    """Exponential mean over the last n values, seeded by the mean of the first ``period`` of them."""
    x = F.collect_list(finite(F.col(c))).over(frame(-(n - 1), 0, w))
    seed = F.aggregate(F.slice(x, 1, period), F.lit(0.0), lambda a, b: a + b) / period
    return F.when(full(F.col(c), n, w, step_ms), F.aggregate(F.slice(x, period + 1, max(1, n - period)), seed, lambda e, v: e + 2.0 / (period + 1) * (v - e)))


def rsi(c: str, period: int, n: int, w: WindowSpec | None = None, step_ms: int | None = None) -> Column:
    """Relative strength over the last n values: means of gains and losses of the first steps, then smoothed ones."""
    x = F.collect_list(finite(F.col(c))).over(frame(-(n - 1), 0, w))
    steps = F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda a, b: a - b)
    start = F.struct(F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))
    up, down = (lambda d: F.greatest(d, F.lit(0.0))), (lambda d: F.greatest(-d, F.lit(0.0)))
    seed = F.aggregate(F.slice(steps, 1, period), start, lambda s, d: F.struct((s["gain"] + up(d) / period).alias("gain"), (s["loss"] + down(d) / period).alias("loss")))
    smooth = lambda old, new: (old * (period - 1) + new) / period
    end = F.aggregate(F.slice(steps, period + 1, max(1, n - 1 - period)), seed, lambda s, d: F.struct(smooth(s["gain"], up(d)).alias("gain"), smooth(s["loss"], down(d)).alias("loss")))
    value = F.when(end["loss"] == 0, F.when(end["gain"] == 0, 50.0).otherwise(100.0)).otherwise(100.0 - 100.0 / (1.0 + end["gain"] / end["loss"]))
    return F.when(full(F.col(c), n, w, step_ms), value)


def exact_change(steps: int, step_ms: int, w: WindowSpec | None = None) -> Column:
    """Percent change of the close over exactly so many steps."""
    return F.when(F.col("t") - F.lag("t", steps).over(w or by_time()) == steps * step_ms, change(F.col("c"), F.lag("c", steps).over(w or by_time())))


def volume_ratio(last: int, base: int, w: WindowSpec | None = None, step_ms: int | None = None) -> Column:
    """Volume of the last bars against as many of the ``base`` bars before."""
    recent, before = F.sum("v").over(frame(-(last - 1), 0, w)), F.sum("v").over(frame(-(last + base - 1), -last, w)) / (base / last)
    return F.when(full(F.col("v"), last + base, w, step_ms) & (before > 0), recent / before)


def slope(y: str, x: str, n: int, w: WindowSpec | None = None, step_ms: int | None = None) -> Column:
    """Least-squares slope of y on x over the last n rows."""
    return F.when(full(F.col(y), n, w, step_ms) & full(F.col(x), n, w), F.regr_slope(y, x).over(frame(-(n - 1), 0, w)))


def streak(c: str, n: int, w: WindowSpec | None = None) -> Column:
    """How many of the last n values have had the sign of the current one without a break, signed; null if it is missing."""
    x = F.reverse(F.collect_list(F.coalesce(F.signum(finite(F.col(c))), F.lit(9.0))).over(frame(-(n - 1), 0, w)))
    now = F.signum(F.col(c))
    run = F.aggregate(x, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, v: F.struct((s["n"] + F.when(s["on"] & (v == now), 1).otherwise(0)).alias("n"), (s["on"] & (v == now)).alias("on")), lambda s: s["n"])
    return F.when(now.isNull(), None).otherwise((run * now).cast("int"))
