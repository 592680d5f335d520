"""Queries of traders: relations of cycles, screens, gates and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, HOUR_MS, round_half_up
from ..operators import rules as u
from ..operators import traders as tr
from .registry import query, r

col = F.col
r6 = round_half_up
BASE = 1_704_067_200_000

#: Orders as closed positions of traders of five customers each: two symbols, both sides, in four bursts over three weeks.
TRADES_SQL = f"""trades AS (SELECT o_custkey // 5 AS id, o_orderkey, 'S' || (o_orderkey % 2) AS symbol, CASE WHEN o_orderkey % 5 < 3 THEN 'LONG' ELSE 'SHORT' END AS side,
  {BASE} + o_orderkey % 4 * {6 * DAY_MS} + o_orderkey * 7919 % 9000 * 1000 AS opened, {BASE} + o_orderkey % 4 * {6 * DAY_MS} + o_orderkey * 7919 % 9000 * 1000 + o_orderkey % 900 * 1000 AS closed, CAST(o_orderkey % 900 AS DOUBLE) AS hold,
  CASE WHEN o_orderkey % 487 <> 0 THEN o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN -0.6::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN o_orderkey % 11 < 5 THEN 0.0001::DOUBLE ELSE 0.01::DOUBLE * (1 + o_orderkey % 5) END END AS pnl,
  o_totalprice AS notional, 2 * o_totalprice AS turnover, o_totalprice * 0.001 AS fees, CAST(o_orderkey % 3 + 1 AS DOUBLE) AS qty FROM orders)"""
#: What the relations of cycles and orders are, one row for each trader.
METRICS_SQL = f"""{TRADES_SQL}, rel0 AS (SELECT *, last_value(CASE WHEN side = 'LONG' THEN closed END IGNORE NULLS) OVER w AS ll, last_value(CASE WHEN side = 'SHORT' THEN closed END IGNORE NULLS) OVER w AS ls FROM trades WINDOW w AS (PARTITION BY id, symbol ORDER BY opened, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rel1 AS (SELECT id, opened, CASE side WHEN 'LONG' THEN ll ELSE ls END AS same, CASE side WHEN 'LONG' THEN ls ELSE ll END AS other FROM rel0),
rel AS (SELECT id, count(*) FILTER (opened >= same AND opened - same <= 60000) AS reopened, count(*) FILTER (opened >= other AND opened - other <= 60000) AS reversed, count(*) FILTER (opened < other) AS overlapping FROM rel1 GROUP BY 1),
adj0 AS (SELECT id, symbol, side, opened, lag(symbol) OVER w AS ps, lag(side) OVER w AS pside, lag(closed) OVER w AS pc FROM trades WINDOW w AS (PARTITION BY id ORDER BY closed, o_orderkey)),
adj AS (SELECT id, count(pc) AS adjacent, count(*) FILTER (ps = symbol AND pside <> side AND opened - pc <= 60000) AS turned FROM adj0 GROUP BY 1),
log AS (SELECT id, o_orderkey, symbol, side, 'open' AS action, qty, notional AS price, opened AS "at" FROM trades UNION ALL SELECT id, o_orderkey, symbol, side, 'close', qty, notional, closed FROM trades),
rep0 AS (SELECT id, "at", qty, lag("at") OVER w AS pa, lag(qty) OVER w AS pq FROM log WINDOW w AS (PARTITION BY id, symbol, side, action ORDER BY "at", o_orderkey)),
rep AS (SELECT id, count(*) FILTER ("at" - pa <= 300000 AND pq > 0) AS comparable, count(*) FILTER ("at" - pa <= 300000 AND pq > 0 AND abs(qty - pq) / pq <= 0.001) AS repeated FROM rep0 GROUP BY 1),
inte AS (SELECT id, count(*) AS orders, min("at") AS first_at, max("at") AS last_at, count(*) - count(DISTINCT (symbol, side, action, qty, price, "at")) AS duplicates FROM log GROUP BY 1),
st AS (SELECT id, count(*) FILTER (n > 1) AS same_time FROM (SELECT id, symbol, side, "at", count(DISTINCT action) AS n FROM log GROUP BY 1, 2, 3, 4) GROUP BY 1),
base AS (SELECT id, count(*) AS n, count(*) FILTER (hold < 60) AS under60, count(*) FILTER (hold <= 60) AS to60, count(*) FILTER (hold < 300) AS under300, count(*) FILTER (hold <= 300) AS to300, count(*) FILTER (abs(pnl / notional) <= 0.0002) AS near_zero, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses,
  count(pnl) = count(*) AS known, sum(pnl) AS pnl, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gain, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS loss, max(pnl) FILTER (pnl > 0) AS top, sum(turnover) AS turnover, sum(fees) AS fees,
  quantile_cont(hold, 0.25) AS hold_q1, quantile_cont(hold, 0.5) AS hold_median, quantile_cont(hold, 0.75) AS hold_q3 FROM trades GROUP BY 1),
m AS (SELECT base.*, reopened, reversed, overlapping, adjacent, turned, comparable, repeated, orders, duplicates, same_time, (last_at - first_at) / {DAY_MS}.0::DOUBLE AS days, CASE WHEN known THEN wins::DOUBLE / n END AS win_rate, CASE WHEN known AND loss > 0 THEN gain / loss END AS profit_factor,
  top / nullif(gain, 0) AS top_share, reopened::DOUBLE / nullif(n - 1, 0) AS reopen_share, reversed::DOUBLE / nullif(n - 1, 0) AS reverse_share, repeated::DOUBLE / nullif(comparable, 0) AS repeat_share, near_zero::DOUBLE / n AS near_zero_share
  FROM base JOIN rel USING (id) JOIN adj USING (id) JOIN rep USING (id) JOIN inte USING (id) JOIN st USING (id))"""
FLAGS_SQL = f"""{METRICS_SQL}, fl AS (SELECT *, CASE WHEN n >= 10 THEN list_filter([CASE WHEN 100.0 * under60 / n >= 30 THEN 'ultra' END, CASE WHEN 100.0 * under300 / n >= 60 THEN 'short' END, CASE WHEN reopen_share * 100 >= 25 THEN 'reopen' END, CASE WHEN reverse_share * 100 >= 20 THEN 'reverse' END,
  CASE WHEN repeat_share * 100 >= 60 AND near_zero_share * 100 >= 40 THEN 'repeat' END], lambda x: x IS NOT NULL) ELSE [] END AS flags FROM m),
f AS (SELECT *, CASE WHEN n >= 10 THEN least(100, list_contains(flags, 'ultra')::INT * 25 + list_contains(flags, 'short')::INT * 15 + list_contains(flags, 'reopen')::INT * 20 + list_contains(flags, 'reverse')::INT * 15 + list_contains(flags, 'repeat')::INT * 25) END AS anomaly FROM fl)"""
#: What a platform says of a trader, made of the id; some of it missing.
PROFILE_SQL = """prof AS (SELECT DISTINCT id, CASE WHEN id % 7 <> 3 THEN 'ACTIVE' ELSE 'CLOSED' END AS status, CASE WHEN id % 11 <> 5 THEN 'UM' ELSE 'CM' END AS futures, id % 13 <> 6 AS shown, id % 6 <> 1 AS complete, id % 9 <> 2 AS fresh, CASE WHEN id % 10 <> 4 THEN id * 13 % 300 END AS tenure,
  id * 37 % 100 - 8.0::DOUBLE AS roi30, id * 41 % 100 - 8.0::DOUBLE AS roi90, id * 43 % 100 - 8.0::DOUBLE AS pnl30, id * 47 % 100 - 8.0::DOUBLE AS pnl90, CASE WHEN id % 8 <> 0 THEN id * 53 % 5000 - 100.0::DOUBLE END AS copier30, id * 5 % 60::DOUBLE AS mdd30, id * 7 % 70::DOUBLE AS mdd90,
  CASE WHEN id % 12 <> 0 THEN id * 3 % 40 / 10.0::DOUBLE - 0.5 END AS sharpe30, (id % 19 = 0)::INT AS invalid, (id % 23 = 0)::INT AS ambiguous, id % 17 <> 0 AS supported, id % 5 AS unmatched, CASE WHEN id % 4 <> 1 THEN 50000.0::DOUBLE * (1 + id % 3) END AS margin FROM trades)"""


def trades(t):
    k = col("o_orderkey")
    opened = BASE + k % 4 * (6 * DAY_MS) + k * 7919 % 9000 * 1000
    rate = F.when(k % 3 == 0, -0.6).otherwise(1.0) * F.when(k % 11 < 5, 0.0001).otherwise(0.01 * (1 + k % 5))
    price = col("o_totalprice")
    return t.orders.select(
        F.floor(col("o_custkey") / 5).alias("id"), "o_orderkey", F.concat(F.lit("S"), (k % 2).cast("string")).alias("symbol"), F.when(k % 5 < 3, "LONG").otherwise("SHORT").alias("side"), opened.alias("opened"),
        (opened + k % 900 * 1000).alias("closed"), (k % 900).cast("double").alias("hold"), F.when(k % 487 != 0, price * rate).alias("pnl"), price.alias("notional"), (2 * price).alias("turnover"), (price * 0.001).alias("fees"), (k % 3 + 1).cast("double").alias("qty"),
    )


def order_log(x):
    """The orders of closed positions: one that opened and one that closed each."""
    sides = F.array(F.struct(F.lit("open").alias("action"), col("opened").alias("at")), F.struct(F.lit("close").alias("action"), col("closed").alias("at")))
    return x.select("id", "o_orderkey", "symbol", "side", "qty", col("notional").alias("price"), F.inline(sides))


def profile(t):
    i = col("id")
    d = lambda c: c.cast("double")
    return trades(t).select("id").distinct().select(
        "id", F.when(i % 7 != 3, "ACTIVE").otherwise("CLOSED").alias("status"), F.when(i % 11 != 5, "UM").otherwise("CM").alias("futures"), (i % 13 != 6).alias("shown"), (i % 6 != 1).alias("complete"), (i % 9 != 2).alias("fresh"), F.when(i % 10 != 4, i * 13 % 300).alias("tenure"),
        *(d(i * k % 100 - 8).alias(n) for n, k in (("roi30", 37), ("roi90", 41), ("pnl30", 43), ("pnl90", 47))), F.when(i % 8 != 0, d(i * 53 % 5000 - 100)).alias("copier30"), d(i * 5 % 60).alias("mdd30"), d(i * 7 % 70).alias("mdd90"), F.when(i % 12 != 0, i * 3 % 40 / 10.0 - 0.5).alias("sharpe30"),
        (i % 19 == 0).cast("int").alias("invalid"), (i % 23 == 0).cast("int").alias("ambiguous"), (i % 17 != 0).alias("supported"), (i % 5).alias("unmatched"), F.when(i % 4 != 1, 50_000.0 * (1 + i % 3)).alias("margin"),
    )


def metrics(t):
    x = trades(t)
    return tr.metrics(x, order_log(x), "o_orderkey")


@query("agg_25_cycle_metrics", f"""WITH {METRICS_SQL} SELECT id, n, {r('win_rate')} AS win_rate, {r('profit_factor', 4)} AS profit_factor, {r('top_share')} AS top_share, losses, {r('under60::DOUBLE / n')} AS under60, {r('under300::DOUBLE / n')} AS under300, {r('near_zero_share')} AS near_zero, {r('hold_median')} AS median_hold, CASE WHEN known THEN {r('pnl', 2)} END AS pnl FROM m""")
def agg_25(t):
    share = lambda c: r6(tr.share(col(c), col("n")))
    return metrics(t).select(
        "id", "n", r6(col("win_rate")).alias("win_rate"), r6(col("profit_factor"), 4).alias("profit_factor"), r6(col("top_share")).alias("top_share"), "losses", share("under60").alias("under60"), share("under300").alias("under300"),
        r6(col("near_zero_share")).alias("near_zero"), r6(col("hold_median")).alias("median_hold"), F.when(col("known"), r6(col("pnl"), 2)).alias("pnl"),
    )


@query("agg_26_holding_risk", f"""WITH {METRICS_SQL} SELECT id, {r('''100 * (0.22 * least(1, to60::DOUBLE / n / 0.3) + 0.18 * least(1, to300::DOUBLE / n / 0.45) + 0.16 * least(1, coalesce(turned::DOUBLE / nullif(adjacent, 0), 0) / 0.2) + 0.16 * least(1, turnover / 500000 / 24 / 20)
 + 0.14 * least(1, CASE WHEN gain > 0 THEN fees / gain WHEN fees > 0 THEN 1 ELSE 0 END / 0.35) + 0.14 * least(1, greatest(0, 0.5 - floor(hold_median + 0.5) / 3600) / 0.5))''', 1)} AS risk, {r('least(1, n / 100.0::DOUBLE) * 0.8', 2)} AS confidence FROM m""")
def agg_26(t):
    risk, confidence = tr.holding_risk(F.lit(500_000.0), F.lit(24))
    return metrics(t).select("id", risk.alias("risk"), confidence.alias("confidence"))


PARTS = {
    "ultra_short": "to60::DOUBLE / n / 0.35", "short": "to300::DOUBLE / n / 0.60", "reopen": "coalesce(reopen_share, 0) / 0.35", "reverse": "coalesce(reverse_share, 0) / 0.25",
    "turnover": "coalesce(turnover / margin / greatest(days, 1 / 24.0::DOUBLE), 0) / 20", "repeat": "coalesce(repeat_share, 0) / 0.60", "near_zero": "near_zero_share / 0.50",
}
RISK_SQL = f"""{METRICS_SQL}, {PROFILE_SQL}, c AS (SELECT m.*, margin, {", ".join(f"least(1, {e}) AS c_{k}" for k, e in PARTS.items())} FROM m JOIN prof USING (id)),
k AS (SELECT *, 100 * ({" + ".join(f"{tr.SNAPSHOT_RISK[k][0]} * c_{k}" for k in PARTS)}) AS risk, least(1, n / 50.0::DOUBLE) * 0.65 + least(1, greatest(days, 1 / 24.0::DOUBLE) / 30) * 0.35 AS conf FROM c)"""


@query("agg_27_trader_metrics", f"""WITH {RISK_SQL} SELECT id, n, orders, {r('days', 3)} AS days, {r('hold_q1', 1)} AS hold_q1, {r('hold_median', 1)} AS hold_median, {r('hold_q3', 1)} AS hold_q3, {r('turnover / margin / greatest(days, 1 / 24.0::DOUBLE)', 3)} AS daily_turnover, {r('top_share')} AS concentration,
{", ".join(f"{r(f'100 * c_{k}', 1)} AS {k}" for k in PARTS)}, {r('risk', 1)} AS risk, CASE WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS level, {r('conf', 3)} AS confidence FROM k""")
def agg_27(t):
    each, risk, confidence = tr.snapshot_risk(col("margin"))
    x = metrics(t).join(profile(t).select("id", "margin"), "id").withColumn("risk", risk)
    return x.select(
        "id", "n", "orders", r6(col("days"), 3).alias("days"), *(r6(col(c), 1).alias(c) for c in ("hold_q1", "hold_median", "hold_q3")), r6(col("turnover") / col("margin") / F.greatest("days", F.lit(1 / 24)), 3).alias("daily_turnover"), r6(col("top_share")).alias("concentration"),
        *(r6(c, 1).alias(k) for k, c in each.items()), r6(col("risk"), 1).alias("risk"), F.when(col("risk") >= 50, "high").when(col("risk") >= 25, "medium").otherwise("low").alias("level"), r6(confidence, 3).alias("confidence"),
    )


@query("win_46_order_relations", f"WITH {METRICS_SQL} SELECT id, reopened, reversed, overlapping, comparable, repeated FROM m")
def win_46(t):
    """Cycles that follow another within a minute, on the same or the other side, those that overlap the other side, and orders that repeat a quantity."""
    x = trades(t)
    return tr.relations(x, "o_orderkey").join(tr.repeats(order_log(x), "o_orderkey"), "id")


@query("win_47_reversals", f"WITH {METRICS_SQL} SELECT id, adjacent, turned, {r('turned::DOUBLE / nullif(adjacent, 0)')} AS share FROM m")
def win_47(t):
    x = tr.adjacent_reversals(trades(t), "o_orderkey")
    return x.withColumn("share", r6(tr.share(col("turned"), col("adjacent"))))


CHECKS = {
    "fresh": "fresh", "public": "status = 'ACTIVE' AND futures = 'UM' AND shown AND complete", "tenure": "tenure >= 90", "pnl": "roi30 > 0 AND roi90 > 0 AND pnl30 > 0 AND pnl90 > 0 AND copier30 > 0", "drawdown": "mdd30 BETWEEN 0 AND 25 AND mdd90 BETWEEN 0 AND 35", "sharpe": "sharpe30 >= 0.5",
    "sample": "n >= 30 AND days >= 14 AND losses >= 3", "integrity": "invalid = 0 AND ambiguous = 0 AND duplicates = 0 AND same_time = 0 AND supported AND unmatched::DOUBLE / greatest(1, unmatched + n) <= 0.05", "holding": "hold_median >= 300 AND 100.0 * under300 / n <= 30",
    "profit_quality": "profit_factor >= 1.2 AND top_share <= 0.35", "anomaly": "anomaly < 25 AND reopen_share <= 0.25",
}


@query("rul_7_trader_gates", f"""WITH {FLAGS_SQL}, {PROFILE_SQL}, g AS (SELECT id, {", ".join(f"coalesce({c}, false) AS k_{k}" for k, c in CHECKS.items())} FROM f JOIN prof USING (id))
SELECT id, {" AND ".join(f"k_{k}" for k in CHECKS)} AS eligible, CAST(floor(({" + ".join(f"k_{k}::INT" for k in CHECKS)}) * 100 / {len(CHECKS)}.0::DOUBLE + 0.5) AS INT) AS score, concat_ws(',', {", ".join(f"CASE WHEN NOT k_{k} THEN '{k}' END" for k in CHECKS)}) AS failed FROM g""")
def rul_7(t):
    x = tr.flags(metrics(t)).join(profile(t), "id")
    ok, score, failed = tr.trader_gates(x)
    return x.select("id", ok.alias("eligible"), score.alias("score"), F.array_join(failed, ",").alias("failed"))


@query("rul_8_anomaly_flags", f"WITH {FLAGS_SQL} SELECT id, array_to_string(flags, ',') AS flags, CAST(anomaly AS INT) AS points FROM f")
def rul_8(t):
    return tr.flags(metrics(t)).select("id", F.array_join("flags", ",").alias("flags"), col("anomaly").cast("int").alias("points"))


SCORE_SQL = """100 * (greatest(0, least(1, ln(1 + greatest(0, roi30)) / ln(301))) * 0.2 + (1 - greatest(0, least(1, mdd30 / 50))) * 0.2 + greatest(0, least(1, (coalesce(sharpe30, -1) + 0.5) / 3.5)) * 0.15 + greatest(0, least(1, ln(1 + greatest(0, coalesce(copier30, 0))) / ln(10001))) * 0.15
 + greatest(0, least(1, roi90 / 100)) * 0.1 + greatest(0, least(1, coalesce(tenure, 0) / 180.0)) * 0.1 + (1 - risk / 100) * 0.1)"""


@query("rul_15_trader_score", f"""WITH {RISK_SQL.replace("m.*, margin", "m.*, margin, roi30, roi90, mdd30, sharpe30, copier30, tenure, shown")}, z AS (SELECT *, {r('risk', 1)} AS rr, {SCORE_SQL.replace('risk', f"({r('risk', 1)})")} AS raw FROM k)
SELECT id, {r('CASE WHEN rr >= 50 THEN least(raw, 49) ELSE raw END', 1)} AS score, shown AND n >= 30 AND days >= 7 AND {r('conf', 3)} >= 0.25 AND coalesce(copier30, 0) > 0 AND mdd30 <= 50 AND rr < 50 AND coalesce({r('hold_median', 1)} >= 60, true) AS eligible FROM z""")
def rul_15(t):
    """Seven parts, of which the absence of inflated trading is one, and who may be listed."""
    x = metrics(t).join(profile(t), "id")
    _, risk, confidence = tr.snapshot_risk(col("margin"))
    x = x.withColumns({"risk": r6(risk, 1), "confidence": r6(confidence, 3)})
    copier = F.coalesce("copier30", F.lit(0.0))
    score = tr.composite(col("roi30"), col("mdd30"), F.coalesce("sharpe30", F.lit(-1.0)), copier, col("roi90"), F.coalesce("tenure", F.lit(0)), col("risk"))
    eligible = col("shown") & (col("n") >= 30) & (col("days") >= 7) & (col("confidence") >= 0.25) & (copier > 0) & (col("mdd30") <= 50) & (col("risk") < 50) & F.coalesce(r6(col("hold_median"), 1) >= 60, F.lit(True))
    return x.select("id", score.alias("score"), eligible.alias("eligible"))


@query("flt_14_trader_quality", f"WITH {TRADES_SQL}, {PROFILE_SQL} SELECT id FROM prof WHERE tenure >= 7 AND pnl30 > 0 AND copier30 > 0 AND margin >= 1000 AND mdd30 <= 50")
def flt_14(t):
    """Who is worth a closer look: a week of age, profits of its own and for followers, a thousand under management, half of it never lost."""
    return profile(t).where("tenure >= 7 and pnl30 > 0 and copier30 > 0 and margin >= 1000 and mdd30 <= 50").select("id")


# --- on-chain entities: customers as traders, suppliers as vaults

NOW = 1_706_400_000_000
ENTITY_SQL = f"""ent AS (SELECT 'trader' AS kind, c_custkey AS address, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal * 8 END AS value, CASE WHEN c_custkey % 10 <> 1 THEN c_acctbal - 500 END AS pnl, c_custkey % 5 AS week, c_custkey % 4 AS positions, c_custkey % 14 <> 2 AS answered, {NOW} - c_custkey % 60 * {HOUR_MS} AS observed, NULL::BOOLEAN AS closed, NULL::BOOLEAN AS deposits, NULL::BIGINT AS age_days, false AS child, NULL::DOUBLE AS tvl FROM customer
UNION ALL SELECT 'vault', s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal * 8 END, CASE WHEN s_suppkey % 10 <> 1 THEN s_acctbal - 500 END, s_suppkey % 5, s_suppkey % 4, s_suppkey % 14 <> 2, {NOW} - s_suppkey % 60 * {HOUR_MS}, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 5 = 0 END, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 <> 0 END, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey * 3 % 90 END, s_suppkey % 8 = 0, s_acctbal - 1000 FROM supplier)"""


def entities(t):
    """``kind, address`` and what was seen of it; unknown is null."""

    def of(x, kind, key, balance, vault):
        k = col(key)
        unknown = F.lit(None)
        more = {
            "closed": F.when(k % 3 != 0, k % 5 == 0), "deposits": F.when(k % 4 != 0, k % 7 != 0), "age_days": F.when(k % 6 != 0, k * 3 % 90), "child": k % 8 == 0, "tvl": col(balance) - 1000,
        } if vault else {"closed": unknown.cast("boolean"), "deposits": unknown.cast("boolean"), "age_days": unknown.cast("long"), "child": F.lit(False), "tvl": unknown.cast("double")}
        return x.select(
            F.lit(kind).alias("kind"), k.alias("address"), F.when(k % 9 != 0, col(balance) * 8).alias("value"), F.when(k % 10 != 1, col(balance) - 500).alias("pnl"), (k % 5).alias("week"), (k % 4).alias("positions"), (k % 14 != 2).alias("answered"),
            (NOW - k % 60 * HOUR_MS).alias("observed"), *(c.alias(n) for n, c in more.items()),
        )

    return of(t.customer, "trader", "c_custkey", "c_acctbal", False).unionByName(of(t.supplier, "vault", "s_suppkey", "s_acctbal", True))


ENTITY_CHECKS = {"data": "answered", "fresh": f"{NOW} - observed <= {48 * HOUR_MS} AND observed <= {NOW} + 300000", "scale": "value >= 20000", "pnl": "pnl > 0", "active": "week > 0 OR positions > 0", "open": "kind = 'trader' OR closed IS NOT TRUE AND deposits IS NOT FALSE", "tenure": "kind = 'trader' OR age_days >= 30"}


@query("rul_9_entity_gates", f"""WITH {ENTITY_SQL}, g AS (SELECT kind, address, {", ".join(f"coalesce({c}, false) AS k_{k}" for k, c in ENTITY_CHECKS.items())} FROM ent)
SELECT kind, address, {" AND ".join(f"k_{k}" for k in ENTITY_CHECKS)} AS eligible, concat_ws(',', {", ".join(f"CASE WHEN NOT k_{k} THEN '{k}' END" for k in ENTITY_CHECKS)}) AS failed FROM g""")
def rul_9(t):
    """Five checks of an account and two more of a vault; that a vault is closed, or takes no deposits, must be known to count."""
    trader = col("kind") == "trader"
    no, yes = F.coalesce("closed", F.lit(False)), F.coalesce("deposits", F.lit(True))
    ok, _, failed = u.gate({
        "data": col("answered"), "fresh": (NOW - col("observed") <= 48 * HOUR_MS) & (col("observed") <= NOW + 300_000), "scale": col("value") >= 20_000, "pnl": col("pnl") > 0, "active": (col("week") > 0) | (col("positions") > 0),
        "open": trader | (~no & yes), "tenure": trader | (col("age_days") >= 30),
    })
    return entities(t).select("kind", "address", ok.alias("eligible"), F.array_join(failed, ",").alias("failed"))


@query("flt_12_candidates", f"WITH {ENTITY_SQL} SELECT kind, address FROM ent WHERE kind = 'trader' AND value >= 20000 AND pnl IS NOT NULL AND address NOT IN (SELECT address FROM ent WHERE kind = 'vault') OR kind = 'vault' AND closed IS NOT TRUE AND NOT child AND tvl > 0")
def flt_12(t):
    """Accounts of some size with a whole history that are no vaults, and open vaults that hold something and belong to none."""
    x = entities(t)
    vaults = x.where("kind = 'vault'").select("address")
    traders = x.where("kind = 'trader' and value >= 20000 and pnl is not null").join(vaults, "address", "left_anti")
    open_ones = x.where((col("kind") == "vault") & ~F.coalesce("closed", F.lit(False)) & ~col("child") & (col("tvl") > 0))
    return traders.select("kind", "address").unionByName(open_ones.select("kind", "address"))


@query("rul_10_effective_pool", f"""WITH {ENTITY_SQL}, p AS (SELECT kind, address, value > 30000 AS quality, observed, {NOW} - address % 55 * {HOUR_MS} AS history, address % 31 = 0 AS error FROM ent)
SELECT kind, address, CASE WHEN quality AND {NOW} - observed <= {48 * HOUR_MS} AND {NOW} - history <= {48 * HOUR_MS} AND NOT error THEN 'quality' ELSE 'ordinary' END AS pool FROM p""")
def rul_10(t):
    """The quality pool is left, for the time being, when either evidence is over two days old or the last update failed."""
    x = entities(t).withColumns({"history": NOW - col("address") % 55 * HOUR_MS, "error": col("address") % 31 == 0})
    return x.select("kind", "address", u.effective_pool(col("value") > 30_000, F.lit(NOW), col("observed"), col("history"), col("error")).alias("pool"))
