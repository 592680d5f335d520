"""Rule ladders: scores, gates and verdicts as expressions. Thresholds are the fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import clamp, clamp_or_zero, round_half_up

DIRECTION = {"price": 1.0, "flow": 8.0, "oi": 3.0, "volume": 1.5, "rsi_high": 75.0, "rsi_low": 25.0, "funding": 0.1, "cap_warn": 20.0, "cap_stop": 50.0, "atr_stop": 5.0, "fresh_hours": 6}


def present(*flags: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order; unknown ones don't."""
    return F.filter(F.array(*(F.when(c, name) for c, name in flags)), lambda x: x.isNotNull())


def sign_at(c: Column, threshold: float) -> Column:
    return F.when(c >= threshold, 1).when(c <= -threshold, -1).otherwise(0)


def trend(close: Column, fast: Column, slow: Column) -> Column:
    return F.when(close.isNull() | fast.isNull() | slow.isNull(), "unknown").when((close > fast) & (fast > slow), "up").when((close < fast) & (fast < slow), "down").otherwise("ranging")


def tags(oi4: Column, p4: Column, net: Column, volume: Column, cap: Column, funding: Column) -> Column:
    return present(
        ((oi4 >= 3) & (p4 >= 1), "rising with positions"), ((oi4 >= 3) & (F.abs(p4) < 1), "flat with positions"), ((oi4 >= 3) & (p4 <= -1), "falling with positions"), ((oi4 <= -3) & (F.abs(p4) >= 1), "unwinding"),
        (net >= 8, "net inflow"), (net <= -8, "net outflow"), (volume >= 1.5, "heavy volume"), (F.coalesce(cap >= 20, F.lit(False)) | F.coalesce(F.abs(funding) >= 0.1, F.lit(False)), "crowded"),
    )


def warnings(c: dict[str, Column]) -> Column:
    """What to be careful about, in order; thresholds are fixed values."""
    ratio = F.when((c["market_cap"] > 0) & (c["available"] == c["contracts"]), c["oi_value"] / c["market_cap"] * 100)
    return present(
        (c["own_conflict"], "own market caps differ"), (c["outside_conflict"], "market caps of two sources differ"), (c["market_cap"].isNull(), "market cap missing"), (c["available"] != c["contracts"], "hourly positions incomplete"), (c["current"] != c["contracts"], "current positions incomplete"),
        (c["oi24"].isNull(), "positions: history short of a day"), (c["flow24"].isNull(), "flows: history short of a day"), ((c["candles"] < 60) | ~c["contiguous"], "candles of the main contract incomplete"), (ratio >= 20, "positions large for the market cap"), (F.abs(c["funding"]) >= 0.1, "funding high"),
        (c["spread"] > 25, "spread wide"), ((c["rsi"] >= 75) | (c["rsi"] <= 25), "RSI extreme"), (c["listed_days"] < 7, "listed for less than a week"),
    )


def strength(oi4: Column, net: Column, volume: Column, p4: Column) -> Column:
    """How far things have moved already, of 100."""
    cap = lambda top, c: F.least(F.lit(float(top)), c)
    return cap(100, cap(35, F.abs(oi4) * 4) + cap(25, F.abs(F.coalesce(net, F.lit(0.0))) * 2) + cap(20, F.greatest(F.lit(0.0), F.coalesce(volume, F.lit(1.0)) - 1) * 15) + cap(20, F.abs(p4) * 3))


def market_cap(own: Column, least_own: Column, greatest_own: Column, other: Column, other_matches: Column) -> Column:
    """The first own estimate, unless own ones differ by over a quarter or a matching outside one does; the outside one where there is no own."""
    conflict = (F.abs(least_own / own - 1) > 0.25) | (F.abs(greatest_own / own - 1) > 0.25)
    mine = F.when(~conflict, own)
    matched = F.coalesce(other_matches, F.lit(False))
    return F.when(matched & mine.isNotNull(), F.when(F.abs(other / mine - 1) <= 0.25, mine)).when(matched & own.isNull(), other).otherwise(mine)


def early_score(divergence: Column, squeeze: Column, streak: Column, trade_size: Column, funding: Column) -> Column:
    """Sum of the known ones of four capped terms, if at least two are known; less where funding has moved already."""
    cap = lambda top, c: F.least(F.lit(float(top)), c)
    terms = F.array(
        F.when(divergence.isNotNull(), cap(30, clamp((divergence + 0.02) / 0.08 * 100, 0, 100))), F.when(squeeze.isNotNull(), cap(25, (100 - squeeze) * 0.25)),
        F.when(streak.isNotNull(), cap(25, clamp(F.greatest(F.lit(0.0), streak.cast("double")) / 12 * 100, 0, 100))), F.when(trade_size.isNotNull(), cap(20, clamp((trade_size - 50) * 2, 0, 100))),
    )
    known = F.filter(terms, lambda x: x.isNotNull())
    raw = F.when(F.size(known) >= 2, round_half_up(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), 1))
    return F.when(F.coalesce(F.abs(funding) >= 0.08, F.lit(False)), round_half_up(raw * 0.85, 1)).otherwise(raw)


def direction_state(c: dict[str, Column], stale: Column, missing: Column, liquid: Column) -> tuple[Column, Column]:
    """(bias, state) of price, net flow and trend: stale before missing before illiquid before undecided before stopped."""
    d = DIRECTION
    price, flow = sign_at(c["price"], d["price"]), sign_at(c["flow"], d["flow"])
    way = F.when(c["trend"] == "up", 1).when(c["trend"] == "down", -1).otherwise(0)
    bias = F.when((price != 0) & (price == flow) & (price == way), price).otherwise(0)
    stops = (
        F.coalesce(c["oi"] <= -d["oi"], F.lit(False)) | ((bias == 1) & (c["rsi"] >= d["rsi_high"])) | ((bias == -1) & (c["rsi"] <= d["rsi_low"])) | F.coalesce(c["atr"] >= d["atr_stop"], F.lit(False))
        | ((bias != 0) & F.coalesce(bias * c["funding"] >= d["funding"], F.lit(False))) | F.coalesce(c["cap"] >= d["cap_stop"], F.lit(False))
        | ((bias != 0) & ~F.coalesce(c["oi"] >= d["oi"], F.lit(False)) & ~F.coalesce(c["volume"] >= d["volume"], F.lit(False)))
    )
    state = F.when(stale, "stale").when(missing, "missing").when(~liquid | (bias == 0) | stops, "wait").when(bias > 0, "long").otherwise("short")
    return bias, state


#: code, column, threshold and points of the checks on trading that looks inflated; they apply from ten cycles on.
ANOMALIES = (("ultra", "under60", 30, 25), ("short", "under300", 60, 15), ("reopen", "reopen", 25, 20), ("reverse", "reverse", 20, 15))


def anomaly_flags(n: Column, c: dict[str, Column], repeat: Column, near_zero: Column) -> Column:
    every = [(c[name] >= limit, code) for code, name, limit, _ in ANOMALIES]
    return F.when(n >= 10, present(*every, ((repeat >= 60) & (near_zero >= 40), "repeat"))).otherwise(F.array().cast("array<string>"))


def anomaly_score(flags: Column) -> Column:
    points = F.create_map(*(F.lit(x) for code, _, _, p in ANOMALIES for x in (code, p)), F.lit("repeat"), F.lit(25))
    return F.least(F.lit(100), F.aggregate(flags, F.lit(0), lambda a, f: a + points[f]))


def gate(checks: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(all passed, share passed of 100, names of the failed) of named checks; an unknown check fails."""
    ok = {k: F.coalesce(c, F.lit(False)) for k, c in checks.items()}
    n = sum((c.cast("int") for c in ok.values()), F.lit(0))
    failed = present(*((~c, k) for k, c in ok.items()))
    return n == len(ok), F.floor(n * 100 / len(ok) + 0.5).cast("int"), failed


def effective_pool(quality: Column, now: Column, observed: Column, history: Column, error: Column, fresh_ms: int = 48 * 3_600_000) -> Column:
    """"quality" only while both evidence times are fresh and no update failed; "ordinary" otherwise, and for anything unknown."""
    return F.when(quality & (now - observed <= fresh_ms) & (now - history <= fresh_ms) & ~F.coalesce(error, F.lit(False)), "quality").otherwise("ordinary")


def capped_composite(public: Column, risk: Column) -> tuple[Column, Column]:
    safe = (100 - risk) * 3 / 10  # 0.3 is not a binary number: a product with it can fall short of a half that is to be rounded up
    score = F.when(risk.isNull(), F.least(public, F.lit(89.0))).when(risk >= 60, F.least(public, F.lit(49.0))).otherwise(round_half_up(public * 0.7 + safe, 1))
    return score, F.when(risk.isNull(), "pending").when(risk >= 60, "flagged").otherwise("verified")


def coin_heat(rank_share: Column, searches: Column, volume: Column, change: Column) -> Column:
    log = lambda c, top: clamp_or_zero(F.log1p(c) / F.log(F.lit(float(top))))
    return 100 * (rank_share * 0.35 + log(searches, 5000) * 0.25 + log(volume, 5e9) * 0.25 + clamp_or_zero(F.abs(change) / 20) * 0.15)


def coin_sentiment(top_pct: Column, holder_pct: Column, taker: Column, change: Column) -> Column:
    buys = F.when(taker.isNull(), 0.5).otherwise(clamp((F.log(F.greatest(F.lit(0.01), taker)) + 1.5) / 3))
    return 100 * (top_pct / 100 * 0.30 + holder_pct / 100 * 0.20 + buys * 0.25 + clamp_or_zero((change + 15) / 30) * 0.25)


def coin_flags(change: Column, top: Column, taker: Column, accounts: Column, rate: Column) -> Column:
    """What is odd: traders, accounts and takers against the price and each other; unknown ones say nothing."""
    return present(
        ((change >= 3) & (top < 45), "price up, top traders sell"), ((change <= -3) & (top > 55), "price down, top traders buy"), ((accounts > 1.2) & (taker < 0.85), "accounts long, takers sell"), ((accounts < 0.8) & (taker > 1.15), "accounts short, takers buy"),
        ((rate < 0) & (change > 3) & (F.coalesce(taker, F.lit(0.0)) > 1), "squeeze against negative funding"), (rate > 0.0005, "funding makes longs dear"),
    )


def fresh(at: Column, now: Column, hours: int = 6, ahead_ms: int = 60_000) -> Column:
    return (now - at <= hours * 3_600_000) & (at <= now + ahead_ms)


def anchor(cutoff: Column, now: Column, *times: Column) -> Column:
    """The hour that sources are compared at; null times don't count."""
    return F.coalesce(cutoff, (F.floor(F.least(now, *times) / 3_600_000) * 3_600_000).cast("long"))


def square_available(at: Column, anchored: Column, now: Column, authors: Column, directional: Column) -> Column:
    return fresh(at, now) & (at >= anchored) & (authors >= 3) & (directional >= 2)


def fusion(heat: Column, sentiment: Column, smart: Column, market: Column, confidence: Column) -> tuple[Column, Column]:
    score = heat * 0.25 + sentiment * 0.20 + smart * 0.40 + market * 0.15
    return score, score * (0.55 + 0.45 * confidence / 100)


def fusion_conclusion(heat: Column, square: Column, smart: Column, score: Column, conf: Column) -> Column:
    """The first of nine conclusions that applies."""
    return (
        F.when((conf < 20) & (heat >= 55), "hot without smart money").when((heat >= 55) & (square >= 55) & (smart >= 60) & (conf >= 30), "resonance")
        .when((heat >= 55) & (smart <= 40) & (conf >= 30), "hot but smart money short").when((heat >= 55) & (square >= 60) & (smart < 55) & (conf >= 25), "unconfirmed")
        .when((heat >= 50) & (square <= 40) & (smart >= 60) & (conf >= 30), "contrarian").when((smart >= 60) & (conf >= 30) & (heat < 55), "early")
        .when((score >= 60) & (smart >= 55) & (conf >= 25), "confirmed").when((smart <= 45) & (conf >= 30), "smart money short").otherwise("no conclusion")
    )


def verdict(available: Column, directions: Column) -> Column:
    """Of the chosen modules' signals: too few, incomplete, in conflict, undecided, or aligned."""
    up, down = F.exists(directions, lambda d: d == 1), F.exists(directions, lambda d: d == -1)
    return (
        F.when(F.size(directions) < 2, "too few modules").when(~F.forall(available, lambda a: a), "insufficient").when(up & down, "conflict")
        .when(F.exists(directions, lambda d: d == 0), "no consensus").when(up, "aligned up").otherwise("aligned down")
    )


def leak_status(real: Column, shuffled: Column, p95: Column) -> Column:
    unknown = real.isNull() | shuffled.isNull() | p95.isNull()
    return F.when(unknown | (real <= p95), "inconclusive").when(shuffled > p95, "leak_suspected").otherwise("clean")


def range_plan(same_source: Column, old_start: Column, old_end: Column, start: Column, end: Column) -> Column:
    return F.when(same_source & (old_start == start), F.when(old_end >= end, "skip").otherwise("extend")).otherwise("fetch-all")


#: Ordered rejections of position evidence: the first that applies decides.
EVIDENCE_STATES = ("unknown", "unverified", "stale", "closed", "conflict", "late", "aligned")


#: What a verified history must span. Fixed values.
MIN_HISTORY_DAYS, MIN_HISTORY_CYCLES = 30, 20


def evidence_state(p: dict[str, Column], now: Column, fresh_ms: int = 6 * 3_600_000) -> Column:
    """How a post's position evidence is judged. Times in ms, sides -1 or 1; null where unknown."""
    posted, opened, observed, before = p["posted"], p["opened"], p["observed"], p["before"]
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(posted.isNull() | yes(posted > now), "unknown").when(p["evidence_id"].isNull(), "unknown").when(~yes(p["same_author"]), "unknown")
        .when((p["grade"] != "verified") | ~yes(p["identity"]) | ~yes(p["sourced"]), "unverified").when(observed.isNull() | yes(observed > now) | yes(observed < posted) | yes(observed < opened), "unknown")
        .when(now - observed > fresh_ms, "stale").when(p["state"] == "closed", "closed").when((p["direction"] != 0) & (p["side"] != p["direction"]), "conflict")
        .when((p["direction"] == 0) | ~yes(p["is_call"]), "unknown").when(opened.isNull(), "unknown").when(yes(opened > posted) | before.isNull() | yes(before > posted), "late")
        .when(yes(before < opened) | yes(posted - before > fresh_ms), "unknown").when(~yes(p["before_open"]) | ~yes(p["before_side"] == p["direction"]), "conflict").otherwise("aligned")
    )


def evidence_weight(state: Column, margin: Column, share_pct: Column, hold_hours: Column, proven: Column) -> Column:
    """1, and for aligned evidence bonuses up to 1.75 in all."""
    r2 = lambda c: round_half_up(c, 2)
    bonus = (
        0.35 + F.when(margin > 0, r2(F.least(F.lit(0.1), F.log10(1 + margin) / 50))).otherwise(0.0) + F.when((share_pct >= 0) & (share_pct <= 100), r2(F.least(F.lit(0.1), share_pct / 200))).otherwise(0.0)
        + r2(F.least(F.lit(0.1), hold_hours / 240)) + F.when(proven, 0.1).otherwise(0.0)
    )
    return F.when(state == "aligned", r2(F.least(F.lit(1.75), 1 + bonus))).otherwise(1.0)
