"""What position cycles and orders say about a trader: metrics, screens for inflated trading, gates and scores.

Cycles have ``id, symbol, side, opened, closed`` (ms), ``hold`` (seconds), ``pnl`` (null if unknown), ``notional`` at opening, ``turnover``, ``fees``; orders
``id, symbol, side, action, qty, price, at``. Quantiles are taken by ranks, so a trader with many cycles is sorted with spilling, not held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, clamp, clamp_or_zero, ratio, round_half_up
from .aggregates import quantiles
from .rules import anomaly_flags, anomaly_score, gate

col = F.col
#: How soon, in ms, an opening counts as a reaction to a closing, and orders as comparable. Fixed values.
SOON, COMPARABLE, SAME_QTY = 60_000, 300_000, 0.001


def share(part: Column, of: Column) -> Column:
    """part / of; null without any."""
    return ratio(part.cast("double"), of)


def relations(cycles: DataFrame, *tie: str) -> DataFrame:
    """``id, reopened, reversed, overlapping``: cycles that follow the last one of their symbol and side, or of the other side, within a minute, and
    those that open while the last one of the other side is still held. Cycles are taken as they open."""
    by = Window.partitionBy("id", "symbol").orderBy("opened", *tie)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda side: F.last(F.when(col("side") == side, col("closed")), ignorenulls=True).over(before)
    x = cycles.withColumns({"_long": last("LONG"), "_short": last("SHORT")})
    long = col("side") == "LONG"
    same, other = F.when(long, col("_long")).otherwise(col("_short")), F.when(long, col("_short")).otherwise(col("_long"))
    soon = lambda c: (col("opened") >= c) & (col("opened") - c <= SOON)
    return x.groupBy("id").agg(F.count_if(soon(same)).alias("reopened"), F.count_if(soon(other)).alias("reversed"), F.count_if(col("opened") < other).alias("overlapping"))


def adjacent_reversals(cycles: DataFrame, *tie: str) -> DataFrame:
    """``id, adjacent, turned``: neighbours by closing time, and those of one symbol that changed side within a minute of the close."""
    w = Window.partitionBy("id").orderBy("closed", *tie)
    x = cycles.select("id", "symbol", "side", "opened", *(F.lag(c).over(w).alias(f"_{c}") for c in ("symbol", "side", "closed")))
    turned = (col("_symbol") == col("symbol")) & (col("_side") != col("side")) & (col("opened") - col("_closed") <= SOON)
    return x.groupBy("id").agg(F.count("_closed").alias("adjacent"), F.count_if(turned).alias("turned"))


def repeats(orders: DataFrame, *tie: str) -> DataFrame:
    """``id, comparable, repeated``: orders within five minutes of the one before of their symbol, side and action, and those of its quantity."""
    w = Window.partitionBy("id", "symbol", "side", "action").orderBy("at", *tie)
    x = orders.select("id", "at", "qty", F.lag("at").over(w).alias("_at"), F.lag("qty").over(w).alias("_qty"))
    soon = (col("at") - col("_at") <= COMPARABLE) & (col("_qty") > 0)
    return x.groupBy("id").agg(F.count_if(soon).alias("comparable"), F.count_if(soon & (F.abs(col("qty") - col("_qty")) / col("_qty") <= SAME_QTY)).alias("repeated"))


def integrity(orders: DataFrame) -> DataFrame:
    """``id, orders, first_at, last_at, duplicates, same_time``: repeated signatures, and orders of one position that open and close at one time."""
    signature = F.xxhash64("symbol", "side", "action", "qty", "price", "at")
    both = orders.groupBy("id", "symbol", "side", "at").agg(F.countDistinct("action").alias("n")).groupBy("id").agg(F.count_if(col("n") > 1).alias("same_time"))
    x = orders.groupBy("id").agg(F.count("*").alias("orders"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), (F.count("*") - F.countDistinct(signature)).alias("duplicates"))
    return x.join(both, "id")


def metrics(cycles: DataFrame, orders: DataFrame, *tie: str) -> DataFrame:
    """One row for each ``id`` with cycles: counts, shares (0 to 1), holding quantiles (seconds), profits, relations, repeats and integrity.

    Profit figures are null if any cycle's is unknown; the profit factor also without a loss.
    """
    pnl, rate = col("pnl"), F.abs(col("pnl") / col("notional"))
    known = F.count("pnl") == F.count("*")
    gain, loss = F.sum(F.greatest(pnl, F.lit(0.0))), -F.sum(F.least(pnl, F.lit(0.0)))
    x = cycles.groupBy("id").agg(
        F.count("*").alias("n"), F.count_if(col("hold") < 60).alias("under60"), F.count_if(col("hold") <= 60).alias("to60"), F.count_if(col("hold") < 300).alias("under300"), F.count_if(col("hold") <= 300).alias("to300"),
        F.count_if(rate <= 0.0002).alias("near_zero"), F.count_if(pnl > 0).alias("wins"), F.count_if(pnl < 0).alias("losses"), known.alias("known"), F.sum("pnl").alias("pnl"),
        F.coalesce(gain, F.lit(0.0)).alias("gain"), F.coalesce(loss, F.lit(0.0)).alias("loss"), F.max(F.when(pnl > 0, pnl)).alias("top"), F.sum(F.abs("turnover")).alias("turnover"), F.sum(F.abs("fees")).alias("fees"),
    )
    held = quantiles(cycles, "id", "hold", hold_q1=0.25, hold_median=0.5, hold_q3=0.75)
    for more in (held, relations(cycles, *tie), adjacent_reversals(cycles, *tie), repeats(orders, *tie), integrity(orders)):
        x = x.join(more, "id", "left")
    followers = F.greatest(F.lit(0), col("n") - 1)
    return x.select(
        "*", F.when(col("known"), share(col("wins"), col("n"))).alias("win_rate"), F.when(col("known") & (col("loss") > 0), col("gain") / col("loss")).alias("profit_factor"),
        ratio(col("top"), col("gain")).alias("top_share"), share(col("reopened"), followers).alias("reopen_share"), share(col("reversed"), followers).alias("reverse_share"),
        share(col("repeated"), col("comparable")).alias("repeat_share"), share(col("near_zero"), col("n")).alias("near_zero_share"), ((col("last_at") - col("first_at")) / DAY_MS).alias("days"),
    )


def flags(m: DataFrame) -> DataFrame:
    """``m`` with ``flags``, the codes of the anomalies from ten cycles on, and ``anomaly``, their points (null under ten)."""
    pct = lambda c: F.coalesce(c * 100, F.lit(0.0))
    shares = {"under60": pct(share(col("under60"), col("n"))), "under300": pct(share(col("under300"), col("n"))), "reopen": pct(col("reopen_share")), "reverse": pct(col("reverse_share"))}
    x = m.withColumn("flags", anomaly_flags(col("n"), shares, pct(col("repeat_share")), pct(col("near_zero_share"))))
    return x.withColumn("anomaly", F.when(col("n") >= 10, anomaly_score(col("flags"))))


def trader_gates(x: DataFrame) -> tuple[Column, Column, Column]:
    """The eleven checks of the quality pool over metrics with ``flags``, joined to a profile: (eligible, score of 100, failed)."""
    pct = lambda c: share(c, col("n")) * 100
    every = lambda *names: sum(((col(c) > 0).cast("int") for c in names), F.lit(0)) == len(names)
    return gate({
        "fresh": col("fresh"), "public": (col("status") == "ACTIVE") & (col("futures") == "UM") & col("shown") & col("complete"), "tenure": col("tenure") >= 90,
        "pnl": every("roi30", "roi90", "pnl30", "pnl90", "copier30"), "drawdown": col("mdd30").between(0, 25) & col("mdd90").between(0, 35), "sharpe": col("sharpe30") >= 0.5,
        "sample": (col("n") >= 30) & (col("days") >= 14) & (col("losses") >= 3),
        "integrity": (col("invalid") == 0) & (col("ambiguous") == 0) & (col("duplicates") == 0) & (col("same_time") == 0) & col("supported") & (col("unmatched") / F.greatest(F.lit(1), col("unmatched") + col("n")) <= 0.05),
        "holding": (col("hold_median") >= 300) & (pct(col("under300")) <= 30), "profit_quality": (col("profit_factor") >= 1.2) & (col("top_share") <= 0.35), "anomaly": (col("anomaly") < 25) & (col("reopen_share") <= 0.25),
    })


#: Weights and thresholds of the screen by cycles alone, and of that by the whole snapshot. Fixed values.
HOLDING_RISK = {"under60": (0.22, 0.30), "under300": (0.18, 0.45), "reversal": (0.16, 0.20), "turnover": (0.16, 20), "fees": (0.14, 0.35), "short_median": (0.14, 0.5)}
SNAPSHOT_RISK = {"ultra_short": (0.20, 0.35), "short": (0.15, 0.60), "reopen": (0.15, 0.35), "reverse": (0.15, 0.25), "turnover": (0.15, 20), "repeat": (0.10, 0.60), "near_zero": (0.10, 0.50)}


def _weighted(parts: dict[str, Column], weights: dict[str, tuple[float, float]]) -> dict[str, Column]:
    return {k: weights[k][0] * clamp_or_zero(c / weights[k][1]) for k, c in parts.items()}


def holding_risk(equity: Column, window_days: Column) -> tuple[Column, Column]:
    """(risk of 100, confidence) of metrics: how much trading looks inflated, by six weighted shares of thresholds."""
    n = col("n")
    fee = F.when(col("gain") > 0, col("fees") / col("gain")).when(col("fees") > 0, 1.0).otherwise(0.0)
    turnover = F.when((equity > 0) & (window_days > 0), col("turnover") / equity / window_days).otherwise(0.0)
    median = F.floor(col("hold_median") + 0.5)
    parts = {
        "under60": share(col("to60"), n), "under300": share(col("to300"), n), "reversal": F.coalesce(share(col("turned"), col("adjacent")), F.lit(0.0)), "turnover": turnover, "fees": fee,
        "short_median": F.greatest(F.lit(0.0), 0.5 - median / 3600),
    }
    risk = 100 * sum(_weighted(parts, HOLDING_RISK).values(), F.lit(0.0))
    return round_half_up(risk, 1), round_half_up(clamp(n / 100) * clamp(window_days / 30), 2)


def snapshot_risk(margin: Column) -> tuple[dict[str, Column], Column, Column]:
    """(components of 100, risk of 100, confidence) of metrics: seven weighted shares of thresholds; what is unknown adds nothing."""
    days = F.greatest(col("days"), F.lit(1 / 24))
    parts = {
        "ultra_short": share(col("to60"), col("n")), "short": share(col("to300"), col("n")), "reopen": col("reopen_share"), "reverse": col("reverse_share"),
        "turnover": F.when((margin > 0) & (days > 0), col("turnover") / margin / days), "repeat": col("repeat_share"), "near_zero": col("near_zero_share"),
    }
    each = {k: 100 * clamp_or_zero(c / SNAPSHOT_RISK[k][1]) for k, c in parts.items()}
    return each, 100 * sum(_weighted(parts, SNAPSHOT_RISK).values(), F.lit(0.0)), clamp(F.least(F.lit(1.0), col("n") / 50) * 0.65 + F.least(F.lit(1.0), days / 30) * 0.35)


def composite(roi: Column, mdd: Column, sharpe: Column, copier: Column, win: Column, tenure: Column, risk: Column) -> Column:
    """A trader's score of 100 from seven parts; at most 49 where the risk is high."""
    log = lambda c, top: clamp_or_zero(F.log1p(F.greatest(F.lit(0.0), c)) / F.log(F.lit(float(top))))
    raw = 100 * (
        log(roi, 301) * 0.20 + (1 - clamp_or_zero(mdd / 50)) * 0.20 + clamp_or_zero((sharpe + 0.5) / 3.5) * 0.15 + log(copier, 10_001) * 0.15
        + clamp_or_zero(win / 100) * 0.10 + clamp_or_zero(tenure / 180) * 0.10 + (1 - risk / 100) * 0.10
    )
    return round_half_up(F.when(risk >= 50, F.least(raw, F.lit(49.0))).otherwise(raw), 1)
