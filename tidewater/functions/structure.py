"""Kernels over one symbol's bars in order of time: swings, levels, ranges, sweeps.

Plain functions on lists, so that they can be tested without Spark and used by both the batch and the streaming operators.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

#: Fixed values of the production rule; the four-hour series uses half the look-back.
PARAMS = {"atr_period": 14, "mult": 2.0, "lookback": 168, "min_swings": 4, "tol_atr": 0.5, "min_touches": 2, "max_height_atr": 25.0}
SWEEP_DECAY = 0.97


@dataclass
class Zigzag:
    """Alternating swings; a swing is known once price has turned by a threshold. Feeding bars one by one never changes what was said before."""

    #: of the mean range, or with ``pct`` of the extreme's price, per cent
    mult: float
    pct: bool = False
    direction: int = 0
    high: tuple[int, float] | None = None
    low: tuple[int, float] | None = None
    n: int = 0
    swings: list[tuple[int, float, str, int]] = field(default_factory=list)

    def feed(self, h: float, l: float, atr: float | None, c: float = 0.0) -> tuple[int, float, str, int] | None:
        """The swing (index, price, type, confirming index) that this bar confirms; a bar with a price that is not finite is passed over."""
        j, self.n = self.n, self.n + 1
        if not all(map(math.isfinite, (h, l, c))):
            return None
        if self.direction == 0:
            if self.high is None or h > self.high[1]:
                self.high = (j, h)
            if self.low is None or l < self.low[1]:
                self.low = (j, l)
            if self.low[0] > self.high[0]:
                return self._turn(j, h, l, atr, up=True)
            return self._turn(j, h, l, atr, up=False) if self.high[0] > self.low[0] else None
        if self.direction == 1:
            if h > self.high[1]:
                self.high = (j, h)
                return None
            return self._turn(j, h, l, atr, up=False)
        if l < self.low[1]:
            self.low = (j, l)
            return None
        return self._turn(j, h, l, atr, up=True)

    def _turn(self, j: int, h: float, l: float, atr: float | None, up: bool):
        at, price = self.low if up else self.high
        moved = h - price if up else price - l
        needed = abs(price) * self.mult / 100 if self.pct else self.mult * atr if known(atr) else math.inf
        if j <= at or not moved >= needed:
            return None
        swing = (at, price, "low" if up else "high", j)
        self.swings.append(swing)
        if up:
            self.direction, self.high = 1, (j, h)
        else:
            self.direction, self.low = -1, (j, l)
        return swing


class Stretch:
    """What a stretch of bars does to a zigzag that enters it with a direction: its state at the end, from the price of the extreme that it has.

    A rising zigzag with extreme H goes on unchanged until the first bar that is higher, from where on H doesn't matter, or the first that is low enough to turn it, which the lowest price
    that a bar turns tells. Only bars that are higher than all before, or turn a lower extreme than all before, can be the first of their kind, so the answer for every H
    is in two sorted lists; what follows is the same for all that come to a bar in the same direction, and is walked once. Stretches are put one behind the other by looking up.
    """

    def __init__(self, at: list[int], h: list[float], l: list[float], c: list[float], atr: list[float | None], mult: float, pct: bool = False):
        self.at, self.h, self.l, self.atr, self.mult, self.pct = at, h, l, atr, mult, pct
        self.whole = [all(map(known, x)) for x in zip(h, l, c)]
        self._ends: dict[tuple[int, int], tuple[int, int]] = {}

    def _turns(self, d: int, price: float, j: int) -> bool:
        moved = price - self.l[j] if d == 1 else self.h[j] - price
        needed = abs(price) * self.mult / 100 if self.pct else self.mult * self.atr[j] if known(self.atr[j]) else math.inf
        return moved >= needed

    def _limit(self, d: int, j: int) -> float | None:
        """The lowest high, or highest low, that bar j turns, to the last bit."""
        if not self.pct and not known(self.atr[j]):
            return None
        m = self.mult / 100
        x = self.l[j] if d == 1 else self.h[j]
        guess = x + d * self.mult * self.atr[j] if not self.pct else x / (1 - d * m) if x >= 0 else x / (1 + d * m)
        inward, outward = (-math.inf, math.inf) if d == 1 else (math.inf, -math.inf)
        while not self._turns(d, guess, j):
            guess = math.nextafter(guess, outward)
        while self._turns(d, math.nextafter(guess, inward), j):
            guess = math.nextafter(guess, inward)
        return guess

    def _next(self, d: int, i: int) -> tuple[int, int] | None:
        price = self.h[i] if d == 1 else self.l[i]
        for j in range(i + 1, len(self.at)):
            if self.whole[j]:
                if (self.h[j] > price) if d == 1 else (self.l[j] < price):
                    return d, j
                if self._turns(d, price, j):
                    return -d, j
        return None

    def _end(self, d: int, i: int) -> tuple[int, int, float]:
        path, now = [], (d, i)
        while now not in self._ends:
            path.append(now)
            following = self._next(*now)
            if following is None:
                self._ends[now] = now
                break
            now = following
        end = self._ends[now]
        self._ends |= dict.fromkeys(path, end)
        return end[0], self.at[end[1]], self.h[end[1]] if end[0] == 1 else self.l[end[1]]

    def summary(self) -> dict[str, list]:
        """For each direction, in order of the bars: (price, bar, end) of new extremes, and of the limits at which a turn begins. Prices are negated for the falling one, so that both are alike."""
        out = {}
        for d in (1, -1):
            beyond, turn = [], []
            for j in range(len(self.at)):
                if not self.whole[j]:
                    continue
                price = d * (self.h[j] if d == 1 else self.l[j])
                if not beyond or price > beyond[-1][0]:
                    beyond.append((price, j, self._end(d, j)))
                if (limit := self._limit(d, j)) is not None and (not turn or d * limit < turn[-1][0]):
                    turn.append((d * limit, j, self._end(-d, j)))
            out[str(d)] = [beyond, turn]
        return out


def after(summary: dict[str, list], d: int, at: int, price: float) -> tuple[int, int, float]:
    """The state (direction, bar of the extreme, its price) behind a stretch with this summary."""
    beyond, turn = summary[str(d)]
    i = bisect_right(beyond, d * price, key=lambda x: x[0])
    j = bisect_left(turn, -d * price, key=lambda x: -x[0])
    first = min((x for x in (beyond[i] if i < len(beyond) else None, turn[j] if j < len(turn) else None) if x), key=lambda x: x[1], default=None)
    if first and i < len(beyond) and beyond[i][1] == first[1]:
        first = beyond[i]  # a bar that is higher doesn't turn
    return tuple(first[2]) if first else (d, at, price)


def known(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


def atr_series(h: list[float], l: list[float], c: list[float], n: int) -> list[float | None]:
    """The plain mean of the last n true ranges; None for the first n - 1 bars and where one of them is not a number."""
    tr = [max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) if i and all(map(known, (h[i], l[i], c[i - 1]))) else h[i] - l[i] if not i else math.nan for i in range(len(h))]
    windows = (tr[i - n + 1 : i + 1] if i >= n - 1 else [math.nan] for i in range(len(tr)))
    return [sum(w) / n if all(map(known, w)) else None for w in windows]


def swings_of(h: list[float], l: list[float], atr: list[float | None], mult: float, c: list[float] | None = None) -> list[tuple[int, float, str, int]]:
    z = Zigzag(mult)
    for x in zip(h, l, atr, c or [0.0] * len(h)):
        z.feed(*x)
    return z.swings


def levels(swings: list[tuple[int, float, str, int]], side: str, tol: float, min_touches: int) -> list[dict]:
    """Swings of one side, chained by price while the next is within ``tol`` of the last member."""
    return chained(sorted((s[1], s[0]) for s in swings if s[2] == side), tol, min_touches)


def chained(touches: list[tuple[float, int]], tol: float, min_touches: int) -> list[dict]:
    """Levels of (price, bar) in order of price."""
    chains: list[list] = []
    for x in touches:
        if chains and x[0] - chains[-1][-1][0] <= tol:
            chains[-1].append(x)
        else:
            chains.append([x])
    return [{"high": g[-1][0], "low": g[0][0], "touches": len(g), "last": max(i for _, i in g)} for g in chains if len(g) >= min_touches]


def in_window(swings: list[tuple[int, float, str, int]], at: int, lookback: int) -> list[tuple[int, float, str, int]]:
    """The swings that are known at a bar and turned within its look-back."""
    return [s for s in swings if s[3] <= at and s[0] > at - lookback]


def range_at(at: int, h, l, c, atr, swings, p: dict) -> dict:
    """``state`` (range, no_range or unavailable) with a reason, or the boundaries and how well closes stay within them, as of a bar."""
    unit = atr[at]
    if blocked := unready(at, unit, p):
        return blocked
    seen = in_window(swings, at, p["lookback"])
    highs, lows = (levels(seen, side, p["tol_atr"] * unit, p["min_touches"]) for side in ("high", "low"))
    closes = c[at - p["lookback"] + 1 : at + 1]
    return ranged(unit, seen, highs, lows, lambda bottom, top: sum(bottom <= x <= top for x in closes) / len(closes), p)


def unready(at: int, unit: float | None, p: dict) -> dict | None:
    if at + 1 < p["lookback"]:
        return {"state": "unavailable", "reason": f"look-back of {p['lookback']} bars not filled"}
    return None if known(unit) and unit > 0 else {"state": "unavailable", "reason": "no mean range"}


def ranged(unit: float, seen: list, highs: list[dict], lows: list[dict], within, p: dict) -> dict:
    """Of each side's levels that with the most touches counts, of equals the one touched last; its outermost swing is the boundary. ``within`` gives the share of closes between two prices."""
    strongest = lambda of: max(of, key=lambda v: (v["touches"], v["last"]), default=None)
    roof, floor = strongest(highs), strongest(lows)
    why = None
    if len(seen) < p["min_swings"]:
        why = f"under {p['min_swings']} swings known"
    elif len({s[2] for s in seen}) == 1:
        why = "swings of one side only"
    elif roof is None:
        why = f"no level of highs touched {p['min_touches']} times"
    elif floor is None:
        why = f"no level of lows touched {p['min_touches']} times"
    elif roof["high"] <= floor["low"]:
        why = "levels crossed"
    elif roof["high"] - floor["low"] > p["max_height_atr"] * unit:
        why = f"taller than {p['max_height_atr']} mean ranges"
    if why:
        return {"state": "no_range", "reason": why, "known": seen}
    top, bottom = roof["high"], floor["low"]
    return {
        "state": "range", "reason": None, "top": top, "bottom": bottom, "containment": within(bottom, top), "known": seen,
        "height_atr": (top - bottom) / unit, "top_touches": roof["touches"], "bottom_touches": floor["touches"],
    }


def sweep(at: int, l, c, bottom: float, unit: float, window: int) -> float:
    """How deep a bar of the window dipped under the bottom and still closed at or above it, in mean ranges and fading with age; 0 if none did."""
    ages = range(min(window, at + 1))
    return max(((bottom - l[at - k]) / unit * SWEEP_DECAY**k for k in ages if l[at - k] < bottom <= c[at - k]), default=0.0)


def trend_of(seen: list[tuple[int, float, str, int]]) -> tuple[int, int] | None:
    """(rising, falling) by the last two swings of each side; None with fewer, or under four in all, as 0 would claim that there is no trend."""
    last = {side: [s[1] for s in seen if s[2] == side][-2:] for side in ("high", "low")}
    if len(seen) < 4 or any(len(v) < 2 for v in last.values()):
        return None
    moves = [b - a for a, b in last.values()]
    return int(all(m > 0 for m in moves)), int(all(m < 0 for m in moves))


def features_at(at: int, h, l, c, atr, swings, p: dict, sweep_window: int) -> dict:
    """Sweep strength below the range (f1), whether there was one, rising and falling structure (f2), and containment (f3), as of a bar."""
    return features_of(range_at(at, h, l, c, atr, swings, p), in_window(swings, at, p["lookback"]), lambda bottom: sweep(at, l, c, bottom, atr[at], sweep_window))


def features_of(found: dict, seen: list, swept) -> dict:
    """Without a range f1 and f3 are truly 0."""
    out: dict = {"state": found["state"], "reason": found["reason"], "f1": None, "f2_up": None, "f2_down": None, "f3": None}
    if found["state"] == "no_range":
        out |= {"f1": 0.0, "f3": 0.0}
    elif found["state"] == "range":
        out |= {"f1": swept(found["bottom"]), "f3": found["containment"], "top": found["top"], "bottom": found["bottom"]}
    if turn := trend_of(seen):
        out |= {"f2_up": turn[0], "f2_down": turn[1]}
    return out


def snapshot_at(at: int, h, l, c, atr, swings, p: dict) -> dict:
    """The structure as of a bar: the range or why there is none, the swings in the window, and the share of bars so far whose prices are numbers."""
    found = range_at(at, h, l, c, atr, swings, p)
    seen = in_window(swings, at, p["lookback"])
    whole = sum(known(h[i]) and known(l[i]) and known(c[i]) for i in range(at + 1))
    return {k: v for k, v in found.items() if k != "known"} | {"swings": seen, "coverage": whole / (at + 1)}
