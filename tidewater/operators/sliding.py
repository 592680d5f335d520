"""Order statistics over sliding windows of long series.

A series is dealt to tiles of time. Each row goes to its own tile and, where the windows of the next one reach back to it, to that tile too, so one
series is spread over as many tasks as it has tiles, and a tile needs nothing but its own rows. Within a tile rows come in order; values enter a sorted window and leave it
again, which costs the logarithm of the window for a row where a list of the window would cost all of it.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import keyed_rank


class SortedWindow:
    """Values in order, in blocks, so that adding and removing move at most a block."""

    def __init__(self, block: int = 512):
        self.block, self.blocks, self.last, self.n = block, [], [], 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> float:
        for b in self.blocks:
            if k < len(b):
                return b[k]
            k -= len(b)
        raise IndexError(k)

    def add(self, x: float) -> None:
        self.n += 1
        if not self.blocks:
            self.blocks, self.last = [[x]], [x]
            return
        i = min(bisect_left(self.last, x), len(self.blocks) - 1)
        b = self.blocks[i]
        insort(b, x)
        if len(b) > 2 * self.block:
            self.blocks[i : i + 1] = [b[: self.block], b[self.block :]]
            self.last[i : i + 1] = [b[self.block - 1], b[-1]]
        else:
            self.last[i] = b[-1]

    def remove(self, x: float) -> None:
        i = bisect_left(self.last, x)
        b = self.blocks[i]
        del b[bisect_left(b, x)]
        self.n -= 1
        if b:
            self.last[i] = b[-1]
        else:
            del self.blocks[i], self.last[i]

    def rank(self, x: float, key: Callable[[float], float] | None = None) -> tuple[int, int]:
        """How many values, or their ``key``, which must not fall as they rise, are below x and at most x."""
        below = upto = 0
        for b in self.blocks:
            if (key(b[-1]) if key else b[-1]) < x:
                below += len(b)
                upto += len(b)
                continue
            below += bisect_left(b, x, key=key)
            more = bisect_right(b, x, key=key)
            upto += more
            if more < len(b):
                break
        return below, upto

    def median(self) -> float:
        return (self[(self.n - 1) // 2] + self[self.n // 2]) / 2


class _Whole:
    """The last n rows of a series, empty again after a missing value or a gap."""

    def __init__(self, n: int, step: int):
        self.n, self.step, self.rows, self.at = n, step, deque(), None

    def enter(self, t: int, x: float | None) -> tuple[bool, float | None]:
        """Whether what was held is void, and the value that leaves because of its age; ``x`` is held unless it is missing."""
        void = x is None or not math.isfinite(x) or (self.at is not None and t - self.at != self.step)
        if void:
            self.rows.clear()
        self.at, left = t, None
        if x is not None and math.isfinite(x):
            self.rows.append(x)
            if len(self.rows) > self.n:
                left = self.rows.popleft()
        return void, left


class _MidRank:
    def __init__(self, n: int, step: int):
        self.whole, self.sorted, self.n = _Whole(n, step), SortedWindow(), n

    def feed(self, t: int, x: float | None) -> float | None:
        void, left = self.whole.enter(t, x)
        if void:
            self.sorted = SortedWindow()
        if left is not None:
            self.sorted.remove(left)
        if self.whole.rows:
            self.sorted.add(x)
        if len(self.sorted) < self.n:
            return None
        below, upto = self.sorted.rank(x)
        return 100.0 * (below + 0.5 * (upto - below)) / self.n


class _ShareAtMost:
    def __init__(self, n: int, least: int):
        self.n, self.least, self.rows, self.sorted = n, least, deque(), SortedWindow()

    def feed(self, t: int, x: float | None) -> float | None:
        size = len(self.sorted)
        out = None
        if size >= self.least:
            out = 100.0 * (self.sorted.rank(x)[1] if x is not None else 0) / size
        self.rows.append(x)
        if x is not None:
            self.sorted.add(x)
        if len(self.rows) > self.n:
            gone = self.rows.popleft()
            if gone is not None:
                self.sorted.remove(gone)
        return out


class _DryUp:
    """The mid-rank of the last value's ratio to the median of its slot, among those of the window; slots are steps modulo ``slots``."""

    def __init__(self, n: int, step: int, slots: int, least: int):
        self.whole, self.n, self.step, self.slots, self.least = _Whole(n, step), n, step, slots, least
        self.by = {}

    def feed(self, t: int, x: float | None) -> float | None:
        void, left = self.whole.enter(t, x)
        if void:
            self.by = {}
        now = t // self.step
        if left is not None:
            self.by[(now - self.n) % self.slots].remove(left)
        if not self.whole.rows:
            return None
        slot = now % self.slots
        self.by.setdefault(slot, SortedWindow()).add(x)
        if len(self.whole.rows) < self.n:
            return None
        medians = {s: w.median() for s, w in self.by.items() if len(w)}
        if any(len(self.by[s]) < self.least or m <= 0 for s, m in medians.items()):
            return None
        ratio, below, upto = x / medians[slot], 0, 0
        for s, m in medians.items():
            a, b = self.by[s].rank(ratio, lambda v, m=m: v / m)
            below, upto = below + a, upto + b
        return 100.0 * (below + 0.5 * (upto - below)) / self.n


class _RunBelowMedian:
    """Rows back from the current one that are below the median of the window without a break, ``longest`` at most."""

    def __init__(self, n: int, step: int, longest: int):
        self.whole, self.sorted, self.n, self.longest = _Whole(n, step), SortedWindow(), n, longest
        self.falling: list[tuple[float, int]] = []  # values that no later one is at least as large as, with their places
        self.place = 0

    def feed(self, t: int, x: float | None) -> float | None:
        void, left = self.whole.enter(t, x)
        if void:
            self.sorted, self.falling = SortedWindow(), []
        if left is not None:
            self.sorted.remove(left)
        self.place += 1
        if not self.whole.rows:
            return None
        self.sorted.add(x)
        while self.falling and self.falling[-1][0] <= x:
            self.falling.pop()
        self.falling.append((x, self.place))
        if self.falling[0][1] <= self.place - self.n:
            del self.falling[0]
        if len(self.sorted) < self.n:
            return None
        k = bisect_right(self.falling, -self.sorted.median(), key=lambda e: -e[0])  # the first k are at least the median
        return float(min(self.place - self.falling[k - 1][1] if k else self.longest, self.longest))


@dataclass(frozen=True)
class Measure:
    """A statistic of a numeric ``column`` over its last ``n`` rows; ``kernel`` makes what is fed them in order."""

    column: str
    n: int
    kernel: Callable[[int], object]


def mid_rank(column: str, n: int) -> Measure:
    """100 times the share of the last n values below the current one, ties counting half; null unless all are there, finite, and a step apart."""
    return Measure(column, n, lambda step: _MidRank(n, step))


def share_at_most(column: str, n: int, least: int = 8) -> Measure:
    """Percent of up to n earlier values that are at most the current one; null below ``least`` of them. Missing values are left out."""
    return Measure(column, n + 1, lambda step: _ShareAtMost(n, least))


def dry_up(column: str, n: int, slots: int = 24, least: int = 8) -> Measure:
    """The mid-rank of the current value over the median of its slot among those ratios of the last n; null unless all are there and each slot has ``least`` and a median above 0."""
    return Measure(column, n, lambda step: _DryUp(n, step, slots, least))


def run_below_median(column: str, n: int, longest: int) -> Measure:
    """How many of the last ``longest`` values are below the median of the last n without a break, from the current one back."""
    return Measure(column, max(n, longest), lambda step: _RunBelowMedian(n, step, longest))


def sliding(df: DataFrame, measures: dict[str, Measure], step: int, by: tuple[str, ...] = ("symbol",), time: str = "t", tile: int = 4096) -> DataFrame:
    """The columns of ``df`` and ``measures`` by name (double), windows being within ``by`` and in order of ``time``, whose values are distinct multiples of ``step`` in a series.

    Tiles have ``tile`` steps, or eight windows if that is more, so that rows sent twice are an eighth at most. Other columns of any type are carried along; a name of a
    measure that ``df`` has already is an error. Rows with a null ``time`` have no place in a series and are left out. An empty table gives an empty result.
    """
    reach = max(m.n for m in measures.values()) - 1
    width = max(tile, 8 * reach, 1) * step
    own = F.floor(F.col(time) / width)
    tiles = F.when(F.col(time) >= (own + 1) * width - reach * step, F.array(own, own + 1)).otherwise(F.array(own))
    kept = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    values = [F.col(m.column).cast("double").alias(f"_x{i}") for i, m in enumerate(measures.values())]
    dealt = df.where(F.col(time).isNotNull()).select(*keys, F.explode(tiles).alias("_tile"), F.col(time).cast("long").alias("_t"), own.alias("_own"), *values, kept)
    # a copy need not carry its row
    dealt = dealt.withColumn("_row", F.when(F.col("_tile") == F.col("_own"), F.col("_row"))).drop("_own")
    place = [f"_k{i}" for i in range(len(by))] + ["_tile"]
    ordered = dealt.repartition(*place).sortWithinPartitions(*place, "_t")
    n_keys, kernels = len(place), list(measures.values())
    out = [f"_m{i}" for i in range(len(measures))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fed = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[: n_keys + 1 + len(kernels)]]
            found = [[] for _ in kernels]
            for i, key in enumerate(zip(*columns[:n_keys])):
                if key != now:
                    now, fed = key, [m.kernel(step) for m in kernels]
                for k, f in enumerate(fed):
                    found[k].append(f.feed(columns[n_keys][i], columns[n_keys + 1 + k][i]))
            rows = batch.column(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(v, pa.float64()) for v in found)], ["_row", *out]).filter(rows.is_valid())

    schema = f"_row {ordered.schema['_row'].dataType.simpleString()}, " + ", ".join(f"{m} double" for m in out)
    done = ordered.mapInArrow(run, schema)
    return done.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns), *(F.col(m).alias(name) for m, name in zip(out, measures)))


def sliding_rows(df: DataFrame, measures: dict[str, Measure], key: str, order: list[Column], tile: int = 4096) -> DataFrame:
    """``sliding`` over rows as they follow each other, whatever lies between them: rows are numbered within ``key`` first, and tiles are ranges of numbers."""
    placed = keyed_rank(df, key, order, "_place")
    return sliding(placed, measures, 1, (key,), "_place", tile).drop("_place")
