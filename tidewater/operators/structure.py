"""Market structure by symbol: what needs a state that runs along the bars.

A symbol's bars are dealt to tiles, so that a long series is many tasks. What a tile does to the zigzag is summed up without knowing the state that it begins with; the summaries of a
symbol, a few numbers for each tile, are gone through in order, and each tile is then walked once from its true state. A tile also has the bars before it that look-backs need.
Grids and snapshots take a symbol as one group.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import structure as s
from .ranking import keyed_rank
from .scale import checkpointed
from .sliding import SortedWindow

#: Bars of a tile, unless look-backs ask for more.
TILE = 4096
_DEALT = ["symbol", "tile", "place", "t", "h", "l", "c"]
_ENTRY = "symbol string, tile long, direction int, hi long, high double, lo long, low double"


def _dealt(bars: DataFrame, reach: int, tile: int) -> DataFrame:
    """Bars with their ``place`` in the symbol's order (from 0) by ``tile``; those that the next tile reaches back to are in both."""
    x = keyed_rank(bars.select("symbol", "t", "h", "l", "c"), "symbol", [F.col("t")], "place").withColumn("place", F.col("place") - 1)
    own = F.floor(F.col("place") / tile)
    tiles = F.when(F.col("place") >= (own + 1) * tile - reach, F.array(own, own + 1)).otherwise(F.array(own))
    return checkpointed(x.withColumn("tile", F.explode(tiles)).select(*_DEALT))


class _Bars:
    """A tile's bars in order, with mean ranges; the zigzag goes through those of its stretch, which ends ``back`` before the tile does, so that the next tile's begins where its look-back does."""

    def __init__(self, pdf, tile: int, back: int, period: int, by_time: bool):
        pdf = pdf.sort_values("place")
        self.symbol, self.k = pdf.symbol.iloc[0], int(pdf.tile.iloc[0])
        self.place, self.t = pdf.place.tolist(), pdf.t.tolist()
        self.h, self.l, self.c = (pdf[k].tolist() for k in ("h", "l", "c"))
        self.atr = s.atr_series(self.h, self.l, self.c, period)
        self.at = self.t if by_time else self.place
        start, end = self.k * tile - back if self.k else 0, (self.k + 1) * tile - back
        self.first = bisect_left(self.place, start)  # of the stretch
        self.last = bisect_left(self.place, end)
        self.own = bisect_left(self.place, self.k * tile)

    def zigzag(self, entry: tuple | None, mult: float, pct: bool, end: int) -> s.Zigzag:
        z = s.Zigzag(mult, pct)
        if entry is not None:
            z.direction, hi, high, lo, low = entry
            z.high, z.low = (hi, high), (lo, low)
        for i in range(self.first, end):
            z.n = self.at[i]
            z.feed(self.h[i], self.l[i], self.atr[i], self.c[i])
        return z


def _state(z: s.Zigzag) -> tuple:
    """Before any bar the extremes are such that every bar is beyond them."""
    return (z.direction, *(z.high or (-1, -math.inf)), *(z.low or (-1, math.inf)))


def _entries(dealt: DataFrame, tile: int, back: int, period: int, by_time: bool, mult: float, pct: bool) -> DataFrame:
    """The zigzag's state before the stretch of each tile; tiles that begin without one have no row.

    A symbol's first stretch is walked. Its state has no direction only as long as there was no swing: the stretches that come in without one are walked too, one of each symbol at a time.
    """
    import pandas as pd

    columns = ["symbol", "tile", "summary", "direction", "hi", "high", "lo", "low"]
    schema = "symbol string, tile long, summary string, direction int, hi long, high double, lo long, low double"

    def summed(pdf):
        b = _Bars(pdf, tile, back, period, by_time)
        x = s.Stretch(b.at[b.first : b.last], b.h[b.first : b.last], b.l[b.first : b.last], b.c[b.first : b.last], b.atr[b.first : b.last], mult, pct)
        state = _state(b.zigzag(None, mult, pct, b.last)) if b.k == 0 else None
        out = pd.DataFrame([(b.symbol, b.k, json.dumps(x.summary()), *(state or (None,) * 5))], columns=columns)
        return out.astype({"direction": "Int32", "hi": "Int64", "lo": "Int64"})

    def chained(batches: Iterator) -> Iterator:
        symbol, state = None, None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.symbol != symbol:
                    symbol, state = r.symbol, None
                if state is not None:
                    rows.append((symbol, r.tile, *state))
                if not pd.isna(r.direction):  # it was walked
                    state = (int(r.direction), int(r.hi), r.high, int(r.lo), r.low)
                elif state is not None and state[0]:
                    d, at, price = s.after(json.loads(r.summary), state[0], *(state[1:3] if state[0] == 1 else state[3:5]))
                    state = (d, at, price, at, price)
                else:
                    state = None
            yield pd.DataFrame(rows, columns=["symbol", "tile", "direction", "hi", "high", "lo", "low"])

    def walked(key, pdf, entry):
        if not len(pdf) or not len(entry):
            return pd.DataFrame([], columns=["symbol", "tile", "direction", "hi", "high", "lo", "low"])
        b = _Bars(pdf, tile, back, period, by_time)
        return pd.DataFrame([(b.symbol, b.k, *_state(b.zigzag(tuple(entry.iloc[0])[2:7], mult, pct, b.last)))], columns=["symbol", "tile", "direction", "hi", "high", "lo", "low"])

    summaries = checkpointed(dealt.groupBy("symbol", "tile").applyInPandas(summed, schema))
    while True:
        found = checkpointed(summaries.repartition("symbol").sortWithinPartitions("symbol", "tile").mapInPandas(chained, _ENTRY))
        done = summaries.where("direction is not null").select("symbol", "tile")
        stuck = found.where("direction = 0").join(done, ["symbol", "tile"], "left_anti")
        if stuck.isEmpty():
            return found
        some = dealt.join(stuck.select("symbol", "tile"), ["symbol", "tile"], "left_semi")
        more = some.groupBy("symbol", "tile").cogroup(stuck.groupBy("symbol", "tile")).applyInPandas(walked, _ENTRY)
        new = more.select("symbol", "tile", *(F.col(c).alias(f"_{c}") for c in ("direction", "hi", "high", "lo", "low")))
        summaries = checkpointed(summaries.join(new, ["symbol", "tile"], "left").select("symbol", "tile", "summary", *(F.coalesce(c, f"_{c}").alias(c) for c in ("direction", "hi", "high", "lo", "low"))))


def _walk(dealt: DataFrame, entries: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of each tile's bars and the state before its stretch, which may be None."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, pdf, entry):
        return f(pdf, tuple(entry.iloc[0])[2:7] if len(entry) else None) if len(pdf) else pd.DataFrame([], columns=names)

    return dealt.groupBy("symbol", "tile").cogroup(entries.groupBy("symbol", "tile")).applyInPandas(run, schema)


def swings(bars: DataFrame, mult: float = s.PARAMS["mult"], period: int = s.PARAMS["atr_period"], pct: bool = False, tile: int = TILE) -> DataFrame:
    """``symbol, t, price, type, confirmed``: the zigzag swings of each symbol (``symbol, t, h, l, c``), with the bar that confirms each.

    A turn is ``mult`` mean ranges, or with ``pct`` that many per cent of the extreme's price.
    """
    import pandas as pd

    tile = max(tile, 2 * (period + 1))
    dealt = _dealt(bars, period + 1, tile)
    entries = _entries(dealt, tile, 0, period, True, mult, pct)

    def run(pdf, entry):
        b = _Bars(pdf, tile, 0, period, True)
        found = b.zigzag(entry, mult, pct, b.last).swings
        return pd.DataFrame([(b.symbol, int(i), price, kind, int(j)) for i, price, kind, j in found], columns=["symbol", "t", "price", "type", "confirmed"])

    return _walk(dealt, entries, run, "symbol string, t long, price double, type string, confirmed long")


FEATURES = "symbol string, t long, state string, reason string, top double, bottom double, f1 double, f1_occurred int, f2_up int, f2_down int, f3 double"


def features(bars: DataFrame, lookback: int, sweep_window: int, step_ms: int, every: int = 1, params: dict | None = None, tile: int = TILE) -> DataFrame:
    """The structure features of every ``every``-th bar, each from bars up to it alone.

    Short or broken history makes them missing, with the reason. Swings and closes enter sorted windows and leave them, so a bar costs what its levels do, not its look-back.
    """
    import pandas as pd

    p = s.PARAMS | {"lookback": lookback} | (params or {})
    period = p["atr_period"]
    need = lookback + period + 1
    back = lookback + 1
    reach = max(need, sweep_window) + back
    tile = max(tile, 4 * reach)
    dealt = _dealt(bars, reach, tile)
    entries = _entries(dealt, tile, back, period, False, p["mult"], False)

    def run(pdf, entry):
        b = _Bars(pdf, tile, back, period, False)
        found = deque(b.zigzag(entry, p["mult"], False, len(b.place)).swings)
        seen, touches, closes, rows = deque(), {"high": [], "low": []}, SortedWindow(), []
        # swings that turned before the tile's look-back are in no window; closes enter from its first bar on
        begin = max(0, b.own - lookback - 1)
        for i in range(begin, len(b.place)):
            at = b.place[i]
            while found and found[0][3] <= at:
                x = found.popleft()
                seen.append(x)
                insort(touches[x[2]], (x[1], x[0]))
            while seen and seen[0][0] <= at - lookback:
                x = seen.popleft()
                del touches[x[2]][bisect_left(touches[x[2]], (x[1], x[0]))]
            if s.known(b.c[i]):
                closes.add(b.c[i])
            if i - lookback >= begin and s.known(b.c[i - lookback]):
                closes.remove(b.c[i - lookback])
            if i < b.own or at % every:
                continue
            if at + 1 < need:
                x = {"state": "unavailable", "reason": f"history too short: {need} bars needed"}
            elif b.t[i] - b.t[i - need + 1] != (need - 1) * step_ms:
                x = {"state": "unavailable", "reason": "bars missing where the structure is looked for"}
            else:
                unit = b.atr[i]
                known = list(seen)
                r = s.unready(at, unit, p)
                if r is None:
                    sides = (s.chained(touches[side], p["tol_atr"] * unit, p["min_touches"]) for side in ("high", "low"))
                    r = s.ranged(unit, known, *sides, lambda bottom, top: (closes.rank(top)[1] - closes.rank(bottom)[0]) / lookback, p)
                x = s.features_of(r, known, lambda bottom, i=i, unit=unit: s.sweep(i, b.l, b.c, bottom, unit, sweep_window))
            f1 = x.get("f1")
            rows.append((b.symbol, b.t[i], x["state"], x["reason"], x.get("top"), x.get("bottom"), f1, None if f1 is None else int(f1 > 0), x.get("f2_up"), x.get("f2_down"), x.get("f3")))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in FEATURES.split(", ")])
        return out.astype({k: "Int32" for k in ("f1_occurred", "f2_up", "f2_down")})

    return _walk(dealt, entries, run, FEATURES)


SNAPSHOT = "symbol string, t long, state string, reason string, top double, bottom double, height_atr double, containment double, top_touches int, bottom_touches int, swing_count int, coverage double, swings array<struct<t:long,price:double,type:string,confirmed:long>>"


def snapshots(bars: DataFrame, lookback: int, params: dict | None = None) -> DataFrame:
    """The structure as of each symbol's last bar: the range with its measures, or why there is none, and the swings that are known in the look-back."""
    p = s.PARAMS | {"lookback": lookback} | (params or {})

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("t")
        h, l, c, t = (pdf[k].tolist() for k in ("h", "l", "c", "t"))
        atr = s.atr_series(h, l, c, p["atr_period"])
        x = s.snapshot_at(len(t) - 1, h, l, c, atr, s.swings_of(h, l, atr, p["mult"], c), p)
        swings = [{"t": t[i], "price": price, "type": kind, "confirmed": t[j]} for i, price, kind, j in x["swings"]]
        names = [f.split()[0] for f in SNAPSHOT.split(", ")]
        row = {"symbol": pdf.symbol.iloc[0], "t": t[-1], "swing_count": len(swings)} | x | {"swings": swings}
        return pd.DataFrame([[row.get(k) for k in names]], columns=names).astype({k: "Int32" for k in ("top_touches", "bottom_touches")})

    return bars.select("symbol", "t", "h", "l", "c").groupBy("symbol").applyInPandas(run, SNAPSHOT)


GRID = "symbol string, t long, mult double, tol double, state string, height_atr double, containment double, touches int"


def range_points(bars: DataFrame, lookback: int, every: int, mults: list[float], tols: list[float]) -> DataFrame:
    """What range detection finds at every ``every``-th bar for each threshold of a turn and each tolerance of a level, without a limit to the height: the
    distribution must not be cut by the limit that it is to inform. ``touches`` are those of the boundary that has fewer."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("t")
        h, l, c, t = (pdf[k].tolist() for k in ("h", "l", "c", "t"))
        atr, rows = s.atr_series(h, l, c, s.PARAMS["atr_period"]), []
        for mult in mults:
            swings = s.swings_of(h, l, atr, mult, c)
            for tol in tols:
                p = s.PARAMS | {"lookback": lookback, "tol_atr": tol, "max_height_atr": float("inf")}
                for at in range(lookback + s.PARAMS["atr_period"], len(t), every):
                    x = s.range_at(at, h, l, c, atr, swings, p)
                    touches = min(x["top_touches"], x["bottom_touches"]) if x["state"] == "range" else None
                    rows.append((pdf.symbol.iloc[0], t[at], mult, tol, x["state"], x.get("height_atr"), x.get("containment"), touches))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in GRID.split(", ")]).astype({"touches": "Int32"})

    return bars.select("symbol", "t", "h", "l", "c").groupBy("symbol").applyInPandas(run, GRID)
