"""Position cycles: from the first opening order to a flat position, rebuilt from a log of orders without ids.

Orders are dealt by trader, symbol and side and sorted by time within a task, which walks them one by one: what it holds is the state of one
position, however many orders a trader has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("trader", "symbol", "side")
CYCLES = "trader long, symbol string, side string, opened long, closed long, turnover double, pnl double, open_notional double, adds long, kind string"


@dataclass
class _Position:
    opened: int
    trusted: bool
    qty: float = 0.0
    open_notional: float = 0.0
    turnover: float = 0.0
    pnl: float | None = 0.0
    adds: int = 0


class Cycles:
    """Turns orders in order of time into cycles.

    strict: a cycle counts only after a known flat point, the first one is "boundary"; closing more than is held drops the position
    as "unmatched". Otherwise the first cycle is trusted, and what is beyond the held quantity is clipped and reported.
    """

    def __init__(self, strict: bool):
        self.strict, self.flat, self.now = strict, not strict, None

    def feed(self, time: int, opens: bool, qty: float, price: float, pnl: float | None) -> list[tuple]:
        s = self.now
        if opens:
            s = self.now = s or _Position(time, self.flat)
            s.qty += qty
            s.open_notional += qty * price
            s.turnover += qty * price
            s.adds += 1
            return []
        unmatched = (time, time, 0.0, None, 0.0, 0, "unmatched")
        if s is None:
            return [unmatched]
        tolerance = max(1e-9, s.qty * 1e-8) if self.strict else max(1e-10, s.open_notional / max(price, 1e-12) * 1e-9)
        out = []
        if qty > s.qty + tolerance:
            out.append(unmatched)
            if self.strict:
                self.now, self.flat = None, False
                return out
        used = qty if self.strict else min(qty, s.qty)
        s.qty -= used
        s.turnover += used * price
        s.pnl = None if s.pnl is None or pnl is None else s.pnl + pnl
        if s.qty <= tolerance:
            out.append((s.opened, time, s.turnover, s.pnl, s.open_notional, s.adds, "cycle" if s.trusted else "boundary"))
            self.now, self.flat = None, True
        return out

    def end(self) -> list[tuple]:
        s = self.now
        return [(s.opened, None, s.turnover, s.pnl, s.open_notional, s.adds, "open")] if s else []


class Cost:
    """What is left of a position at cost: a closing order reduces cost in proportion to quantity."""

    def __init__(self):
        self.qty = self.cost = 0.0

    def feed(self, time: int, opens: bool, qty: float, price: float, pnl: float | None) -> list[tuple]:
        if opens:
            self.qty, self.cost = self.qty + qty, self.cost + qty * price
        elif self.qty > 0:
            used = min(qty, self.qty)
            self.qty, self.cost = self.qty - used, self.cost * (1 - used / self.qty)
            if self.qty <= max(1e-10, used * 1e-9):
                self.qty = self.cost = 0.0
        return []

    def end(self) -> list[tuple]:
        return [(self.qty, self.cost)]


def walk(orders: list[tuple], strict: bool) -> Iterator[tuple]:
    """The cycles of one position's orders (time, opens, quantity, price, pnl)."""
    c = Cycles(strict)
    for order in orders:
        yield from c.feed(*order)
    yield from c.end()


def _walked(orders: DataFrame, start, schema: str) -> DataFrame:
    """Rows of ``schema``, whose first columns are ``KEY``, that a fresh ``start()`` makes of each key's orders."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def table(rows: list[tuple]):
            out = pd.DataFrame(rows, columns=names)
            return out.astype({c: "Int64" for c in ("opened", "closed") if c in names})

        key, state = None, None
        for pdf in batches:
            rows: list[tuple] = []
            for *k, time, opens, qty, price, pnl in pdf[[*KEY, "time", "opens", "qty", "price", "pnl"]].itertuples(index=False):
                if tuple(k) != key:
                    if state:
                        rows += [(*key, *x) for x in state.end()]
                    key, state = tuple(k), start()
                rows += [(*key, *x) for x in state.feed(time, opens, qty, price, None if pnl != pnl else pnl)]
            if rows:
                yield table(rows)
        if state and (last := state.end()):
            yield table([(*key, *x) for x in last])

    dealt = orders.where("qty > 0 and price > 0").repartition(*KEY).sortWithinPartitions(*KEY, "time", "ordinal")
    return dealt.mapInPandas(run, schema)


def cycles(orders: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of ``CYCLES`` for orders (``trader, symbol, side`` LONG or SHORT, ``opens, qty, price, pnl, time, ordinal``).

    Orders of one time keep the order of ``ordinal``. Orders without a positive quantity and price are left out.
    """
    return _walked(orders, lambda: Cycles(strict), CYCLES)


def open_cost(orders: DataFrame) -> DataFrame:
    """``trader, symbol, side, qty, cost``: open positions at cost. Rows as for ``cycles``."""
    return _walked(orders, Cost, "trader long, symbol string, side string, qty double, cost double")


def votes(held: DataFrame, orders: DataFrame, since: int, until: int) -> DataFrame:
    """By trader and symbol: ``long`` and ``short`` at cost and ``holding``, the side times the root of the symbol's share of what the trader holds; of the orders
    from ``since`` to ``until`` the ``turnover``, their number, and ``flow``, the net side times the root of the symbol's share of the trader's turnover."""
    of = Window.partitionBy("trader")
    side = lambda s: F.sum(F.when(F.col("side") == s, F.greatest(F.col("cost"), F.lit(0.0))).otherwise(0.0))
    now = held.groupBy("trader", "symbol").agg(side("LONG").alias("long"), side("SHORT").alias("short"))
    gross = F.col("long") + F.col("short")
    share = F.coalesce(gross / F.nullif(F.sum(gross).over(of), F.lit(0.0)), F.lit(0.0))
    now = now.withColumn("holding", F.signum(F.col("long") - F.col("short")) * F.sqrt(share))
    way = F.when((F.col("side") == "LONG") == F.col("opens"), 1.0).otherwise(-1.0)
    value = F.abs(F.col("qty") * F.col("price"))
    recent = orders.where((F.col("time") >= since) & (F.col("time") <= until)).groupBy("trader", "symbol").agg(F.sum(way * value).alias("signed"), F.sum(value).alias("turnover"), F.count("*").alias("orders"))
    part = F.coalesce(F.col("turnover") / F.nullif(F.sum("turnover").over(of), F.lit(0.0)), F.lit(0.0))
    recent = recent.withColumn("flow", F.coalesce(F.col("signed") / F.nullif(F.col("turnover"), F.lit(0.0)), F.lit(0.0)) * F.sqrt(part))
    return now.join(recent.drop("signed"), ["trader", "symbol"], "full")
