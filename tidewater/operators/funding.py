"""Funding settlements: intervals inferred from gaps, rates made comparable, and z-scores at decision times."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, HOUR_MS
from .sliding import SortedWindow

#: Intervals that contracts settle by, in hours, and how far a gap may be off. Fixed values.
INTERVALS, SNAP = (1, 2, 4, 8), 0.1


def snapped(gap_ms: Column) -> Column:
    """The interval that a gap stands for; null if none is near."""
    hours = gap_ms / HOUR_MS
    out = F.lit(None).cast("int")
    for n in INTERVALS:
        out = F.when(F.abs(hours - n) <= SNAP * n, n).otherwise(out)
    return out


def normalised(funding: DataFrame) -> DataFrame:
    """``symbol, time, rate, hours, next_hours, next_time, daily`` (percent a day) of settlements; rows without an interval are out.

    Whether a row is dropped because the next interval differs depends on what is visible, see ``visible_at``.
    """
    w = Window.partitionBy("symbol").orderBy("time")
    x = funding.withColumns({"hours": snapped(F.col("time") - F.lag("time").over(w)), "next_time": F.lead("time").over(w)})
    x = x.withColumn("next_hours", snapped(F.col("next_time") - F.col("time")))
    return x.where("hours is not null").withColumn("daily", F.col("rate") * 100 * 24 / F.col("hours"))


def kept(x: DataFrame) -> DataFrame:
    """Rows whose next interval is the same; the last one has no successor and stays."""
    return x.where("next_time is null or next_hours <=> hours")


def by_actual_gap(funding: DataFrame) -> DataFrame:
    """The other rule: rates over their actual gaps, if these are within half and twice the symbol's median gap."""
    gap = F.col("time") - F.lag("time").over(Window.partitionBy("symbol").orderBy("time"))
    x = funding.withColumn("gap", gap).where("gap is not null")
    median = x.groupBy("symbol").agg(F.median("gap").alias("m"))
    return x.join(median, "symbol").where("gap between 0.5 * m and 2 * m").withColumn("daily", F.col("rate") * 100 * DAY_MS / F.col("gap"))


class _Seen:
    """Settlements of a symbol that a decision sees, as time goes on: those that are kept, and the last one whatever its successor will show."""

    def __init__(self, days: int):
        self.length, self.rows, self.sorted, self.last = days * DAY_MS, deque(), SortedWindow(), None

    def settle(self, time: int, daily: float, keep: bool) -> None:
        self.last = (time, daily, keep)
        if keep:
            self.rows.append((time, daily))
            self.sorted.add(daily)

    def at(self, t: int) -> tuple:
        """Their number, median, spread, the last rate, and the times of the last and the first."""
        while self.rows and self.rows[0][0] <= t - self.length:
            self.sorted.remove(self.rows.popleft()[1])
        loose = self.last is not None and not self.last[2] and self.last[0] > t - self.length
        if loose:
            self.sorted.add(self.last[1])
        n = len(self.sorted)
        if n:
            first, last = (self.rows[0][0] if self.rows else self.last[0]), (self.last[0] if loose else self.rows[-1][0])
            now = self.last[1] if loose else self.rows[-1][1]
            out = (n, self._quantile(0.5), self._quantile(0.75) - self._quantile(0.25), now, last, first)
        else:
            out = (0, None, None, None, None, None)
        if loose:
            self.sorted.remove(self.last[1])
        return out

    def _quantile(self, p: float) -> float:
        h = (len(self.sorted) - 1) * p
        low = int(h)
        part = h - low
        return self.sorted[low] if not part else self.sorted[low] * (1 - part) + self.sorted[low + 1] * part


def z_scores(decisions: DataFrame, normal: DataFrame, floor: float, days: int = 30, least: int = 60, span_days: int = 25, stale_ms: int = 9 * HOUR_MS, tile_days: int | None = None) -> DataFrame:
    """``symbol, at, z, why`` (why z is missing, where it is): the last rate against median and spread of those in the ``days`` before ``at``, clipped at 5; a row for each decision, equal ones once.

    The window is by time and ends at the decision: a row that is the last one visible then is kept though its successor may later show that its
    interval changed. Settlements and decisions are put in one order by tiles of time, eight windows wide unless ``tile_days`` says otherwise; a settlement that the next tile looks back to is in both, so what is
    moved is an eighth more than there is. Rates enter a sorted window and leave it.
    """
    width, reach = max(tile_days or 8 * days, days) * DAY_MS, days * DAY_MS
    own = lambda c: F.floor(F.col(c) / width)
    keep = F.col("next_time").isNull() | F.col("next_hours").eqNullSafe(F.col("hours"))
    tiles = F.when(F.col("time") >= (own("time") + 1) * width - reach, F.array(own("time"), own("time") + 1)).otherwise(F.array(own("time")))
    rows = normal.where(F.col("daily").isNotNull()).select("symbol", F.explode(tiles).alias("tile"), F.col("time").alias("t"), F.lit(0).alias("side"), F.col("daily").cast("double").alias("daily"), keep.alias("keep"))
    asked = decisions.where("at is not null").select("symbol", F.col("at").cast("long").alias("at")).distinct()
    asked = asked.select("symbol", own("at").alias("tile"), F.col("at").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("daily"), F.lit(False).alias("keep"))
    ordered = rows.unionByName(asked).repartition("symbol", "tile").sortWithinPartitions("symbol", "tile", "t", "side")
    names = ["symbol", "at", "n", "m", "iqr", "now", "last", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, None
        for batch in batches:
            out = []
            for symbol, tile, t, side, daily, kept_ in zip(*(c.to_pylist() for c in batch.columns)):
                if (symbol, tile) != key:
                    key, seen = (symbol, tile), _Seen(days)
                if side == 0:
                    seen.settle(t, daily, kept_)
                else:
                    out.append((symbol, t, *seen.at(t)))
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = ordered.schema["symbol"].dataType.simpleString()
    g = ordered.mapInArrow(run, f"symbol {kind}, at long, n long, m double, iqr double, now double, last long, first long")
    ok = (F.col("n") >= least) & (F.col("last") - F.col("first") >= span_days * DAY_MS) & (F.col("at") - F.col("last") <= stale_ms)
    z = (F.col("now") - F.col("m")) / F.greatest("iqr", F.lit(floor))
    why = (
        F.when(F.col("n") == 0, f"no settlement in {days} days").when(F.col("n") < least, f"fewer than {least} settlements in {days} days")
        .when(F.col("last") - F.col("first") < span_days * DAY_MS, f"settlements of less than {span_days} days").when(~ok, f"last settlement more than {stale_ms // HOUR_MS} hours before")
    )
    return g.select("symbol", "at", F.when(ok, F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z))).alias("z"), why.alias("why"))


def interval_check(funding: DataFrame) -> DataFrame:
    """By symbol, settlements (``symbol, time, truth``) whose interval follows from the gaps, against the true interval.

    ``compared`` and ``matched``; ``lagging`` have the interval of the row before as their true one; ``refused`` have no interval or one that changes at the next
    row, of which ``refused_by_next`` fit none but are followed by a gap that is the true one. Changes are ``longer``, ``shorter`` or ``broken``.
    """
    w = Window.partitionBy("symbol").orderBy("time")
    gap, ahead = F.col("time") - F.lag("time").over(w), F.lead("time").over(w) - F.col("time")
    x = funding.withColumns({"gap": gap, "hours": snapped(gap), "next_gap": ahead, "next_hours": snapped(ahead)})
    some = F.col("hours").isNotNull()
    x = x.withColumn("kept", some & (F.col("next_gap").isNull() | F.col("next_hours").eqNullSafe(F.col("hours"))))
    # the interval of the row before among those that are kept
    x = x.withColumn("before", F.last(F.when(F.col("kept"), F.col("hours")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    known, right, off = F.col("gap").isNotNull(), F.col("hours") == F.col("truth"), F.col("next_hours") - F.col("hours")
    return x.groupBy("symbol").agg(
        n(F.col("kept")).alias("compared"), n(F.col("kept") & right).alias("matched"), n(F.col("kept") & ~right & (F.col("truth") == F.col("before"))).alias("lagging"), n(known & ~F.col("kept")).alias("refused"),
        n(known & ~some & (F.col("next_hours") == F.col("truth"))).alias("refused_by_next"), n(off > 0).alias("longer"), n(off < 0).alias("shorter"), n(some & F.col("next_gap").isNotNull() & F.col("next_hours").isNull()).alias("broken"),
    )
