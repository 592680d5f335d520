"""Queries of rule ladders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import HOUR_MS, change, round_half_up
from ..functions.windows import by_time, ema
from ..operators import gate
from ..operators import rules as u
from ..operators.aggregates import exact_mean
from . import windows as wq
from .registry import K, query, r

col = F.col
r6 = round_half_up

#: Metrics of a coin from a line item.
COIN_SQL = "coin AS (SELECT l_orderkey, l_linenumber, l_quantity / 5 - 5 AS oi4, (l_discount - 0.05) * 100 AS p4, l_tax * 400 - 16 AS net, CASE WHEN l_linenumber < 6 THEN l_quantity / 20 END AS volume, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / 2000 END AS cap, (l_tax - 0.04) * 4 AS funding, 20 + l_quantity * 1.2 AS rsi, l_quantity / 8 AS atr FROM lineitem)"
KEY = ["l_orderkey", "l_linenumber"]


def coin(t, **more):
    return t.lineitem.select(
        *KEY, *(c.alias(k) for k, c in more.items()), (col("l_quantity") / 5 - 5).alias("oi4"), ((col("l_discount") - 0.05) * 100).alias("p4"), (col("l_tax") * 400 - 16).alias("net"), F.when(col("l_linenumber") < 6, col("l_quantity") / 20).alias("volume"),
        F.when(col("l_linenumber") != 3, col("l_extendedprice") / 2000).alias("cap"), ((col("l_tax") - 0.04) * 4).alias("funding"), (20 + col("l_quantity") * 1.2).alias("rsi"), (col("l_quantity") / 8).alias("atr"),
    )


@query("rul_1_trend", f"""WITH {wq.BARS4}, e AS (SELECT symbol, t, x[len(x)] AS c, CASE WHEN len(x) = 40 THEN list_reduce(list_concat([list_avg(x[1:10])], x[11:40]), lambda e, v: e + 2.0::DOUBLE / 11 * (v - e)) END AS a,
CASE WHEN len(x) = 40 THEN list_reduce(list_concat([list_avg(x[1:20])], x[21:40]), lambda e, v: e + 2.0::DOUBLE / 21 * (v - e)) END AS b FROM {wq.fold_sql(40)})
SELECT symbol, t, CASE WHEN a IS NULL THEN 'unknown' WHEN c > a AND a > b THEN 'up' WHEN c < a AND a < b THEN 'down' ELSE 'ranging' END AS trend FROM e""")
def rul_1(t):
    return wq.h4(t).select("symbol", "t", u.trend(col("c"), ema("c", 10, 40), ema("c", 20, 40)).alias("trend"))


TAGS_SQL = """concat_ws(',', CASE WHEN oi4 >= 3 AND p4 >= 1 THEN 'rising with positions' END, CASE WHEN oi4 >= 3 AND abs(p4) < 1 THEN 'flat with positions' END, CASE WHEN oi4 >= 3 AND p4 <= -1 THEN 'falling with positions' END, CASE WHEN oi4 <= -3 AND abs(p4) >= 1 THEN 'unwinding' END,
CASE WHEN net >= 8 THEN 'net inflow' END, CASE WHEN net <= -8 THEN 'net outflow' END, CASE WHEN volume >= 1.5 THEN 'heavy volume' END, CASE WHEN coalesce(cap >= 20, false) OR abs(funding) >= 0.1 THEN 'crowded' END)"""


#: A coin with what the warnings look at besides.
WIDE_SQL = f"""wide AS ({COIN_SQL[len("coin AS ("):-len(" FROM lineitem)")]}, l_partkey % 4 AS contracts, CASE WHEN l_partkey % 9 = 0 THEN l_partkey % 4 - 1 ELSE l_partkey % 4 END AS available, CASE WHEN l_partkey % 10 = 0 THEN l_partkey % 4 - 1 ELSE l_partkey % 4 END AS current, CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice / 1000 - 20 END AS oi24,
  CASE WHEN l_suppkey % 6 <> 0 THEN l_extendedprice * 300 END AS flow24, l_suppkey % 8 <> 0 AS contiguous, 40 + l_partkey % 60 AS candles, CASE WHEN l_suppkey % 11 <> 0 THEN l_quantity / 1.6 END AS spread, l_partkey % 30 AS listed_days, l_suppkey % 12 = 0 AS own_conflict, l_suppkey % 13 = 0 AS outside_conflict, l_extendedprice * 50 AS oi_value,
  CASE WHEN l_linenumber <> 3 AND l_suppkey % 12 <> 0 AND l_suppkey % 13 <> 0 THEN l_extendedprice * 20 END AS market_cap FROM lineitem)"""


def wide(t):
    p, q, e = col("l_partkey"), col("l_suppkey"), col("l_extendedprice")
    n = p % 4
    more = {
        "contracts": n, "available": F.when(p % 9 == 0, n - 1).otherwise(n), "current": F.when(p % 10 == 0, n - 1).otherwise(n), "oi24": F.when(q % 7 != 0, e / 1000 - 20), "flow24": F.when(q % 6 != 0, e * 300), "contiguous": q % 8 != 0, "candles": 40 + p % 60,
        "spread": F.when(q % 11 != 0, col("l_quantity") / 1.6), "listed_days": p % 30, "own_conflict": q % 12 == 0, "outside_conflict": q % 13 == 0, "oi_value": e * 50, "market_cap": F.when((col("l_linenumber") != 3) & (q % 12 != 0) & (q % 13 != 0), e * 20),
    }
    return coin(t, **more)


WARNINGS_SQL = """concat_ws(',', CASE WHEN own_conflict THEN 'own market caps differ' END, CASE WHEN outside_conflict THEN 'market caps of two sources differ' END, CASE WHEN market_cap IS NULL THEN 'market cap missing' END, CASE WHEN available <> contracts THEN 'hourly positions incomplete' END, CASE WHEN current <> contracts THEN 'current positions incomplete' END,
CASE WHEN oi24 IS NULL THEN 'positions: history short of a day' END, CASE WHEN flow24 IS NULL THEN 'flows: history short of a day' END, CASE WHEN candles < 60 OR NOT contiguous THEN 'candles of the main contract incomplete' END, CASE WHEN market_cap > 0 AND available = contracts AND oi_value / market_cap * 100 >= 20 THEN 'positions large for the market cap' END,
CASE WHEN abs(funding) >= 0.1 THEN 'funding high' END, CASE WHEN spread > 25 THEN 'spread wide' END, CASE WHEN rsi >= 75 OR rsi <= 25 THEN 'RSI extreme' END, CASE WHEN listed_days < 7 THEN 'listed for less than a week' END)"""


@query("rul_2_tags", f"WITH {WIDE_SQL} SELECT l_orderkey, l_linenumber, {TAGS_SQL} AS tags, {WARNINGS_SQL} AS warnings FROM wide")
def rul_2(t):
    x = wide(t)
    tags = u.tags(*(col(k) for k in ("oi4", "p4", "net", "volume", "cap", "funding")))
    return x.select(*KEY, F.array_join(tags, ",").alias("tags"), F.array_join(u.warnings({c: col(c) for c in x.columns}), ",").alias("warnings"))


@query("flt_7_quality_liquid_candidate", f"""WITH {WIDE_SQL}, q AS (SELECT *, available = contracts AND oi4 IS NOT NULL AND p4 IS NOT NULL AND flow24 IS NOT NULL AND volume IS NOT NULL AND contiguous AND candles >= 60 AS quality, coalesce(flow24 >= 5e6 AND oi_value >= 1e6 AND spread <= 25, false) AS liquid, len(string_split({TAGS_SQL}, ',')) AS n FROM wide)
SELECT l_orderkey, l_linenumber, quality, liquid, quality AND liquid AND n >= 2 AS candidate FROM q""")
def flt_7(t):
    """Whole data; enough trade, positions and a narrow spread; both, with two signals at least. The flow of four hours is there when the volume is."""
    x = wide(t)
    quality = (col("available") == col("contracts")) & col("oi4").isNotNull() & col("p4").isNotNull() & col("flow24").isNotNull() & col("volume").isNotNull() & col("contiguous") & (col("candles") >= 60)
    liquid = F.coalesce((col("flow24") >= 5e6) & (col("oi_value") >= 1e6) & (col("spread") <= 25), F.lit(False))
    n = F.size(u.tags(*(col(k) for k in ("oi4", "p4", "net", "volume", "cap", "funding"))))
    return x.select(*KEY, quality.alias("quality"), liquid.alias("liquid"), (quality & liquid & (n >= 2)).alias("candidate"))


@query("rul_3_strength", f"WITH {COIN_SQL} SELECT l_orderkey, l_linenumber, {r('least(100, least(35, abs(oi4) * 4) + least(25, abs(net) * 2) + least(20, greatest(0, coalesce(volume, 1) - 1) * 15) + least(20, abs(p4) * 3))', 4)} AS strength FROM coin")
def rul_3(t):
    return coin(t).select(*KEY, r6(u.strength(*(col(k) for k in ("oi4", "net", "volume", "p4"))), 4).alias("strength"))


@query("rul_4_market_cap", """WITH x AS (SELECT l_orderkey, first(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS own, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY 1),
y AS (SELECT l_orderkey, CASE WHEN n = 1 AND o_orderstatus = 'P' THEN NULL ELSE own END AS own, lo, hi, o_totalprice / 5 AS other, o_orderstatus <> 'F' AS m FROM x JOIN orders ON o_orderkey = l_orderkey),
z AS (SELECT *, CASE WHEN abs(lo / own - 1) <= 0.25 AND abs(hi / own - 1) <= 0.25 THEN own END AS mine FROM y)
SELECT l_orderkey, round(CASE WHEN m AND mine IS NOT NULL THEN CASE WHEN abs(other / mine - 1) <= 0.25 THEN mine END WHEN m AND own IS NULL THEN other ELSE mine END, 2) AS cap FROM z""")
def rul_4(t):
    x = t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_extendedprice", F.struct("l_linenumber", "l_extendedprice")).alias("own"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.count("*").alias("n"))
    x = x.join(t.orders, col("l_orderkey") == col("o_orderkey")).withColumn("own", F.when(~((col("n") == 1) & (col("o_orderstatus") == "P")), col("own")))
    cap = u.market_cap(col("own"), col("lo"), col("hi"), col("o_totalprice") / 5, col("o_orderstatus") != "F")
    return x.select("l_orderkey", F.round(cap, 2).alias("cap"))


@query("rul_5_early_score", f"""WITH {COIN_SQL}, e AS (SELECT l_orderkey, l_linenumber, funding, CASE WHEN l_linenumber <> 2 THEN least(30, greatest(0, least(100, (p4 / 100 + 0.02) / 0.08 * 100))) END AS a, CASE WHEN volume IS NOT NULL THEN least(25, (100 - volume * 40) * 0.25) END AS b,
CASE WHEN l_linenumber <> 4 THEN least(25, greatest(0, least(100, greatest(0, oi4) / 12 * 100))) END AS c, CASE WHEN cap IS NOT NULL THEN least(20, greatest(0, least(100, (cap - 50) * 2))) END AS d FROM coin),
s AS (SELECT *, CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT >= 2 THEN {r('coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0)', 1)} END AS raw FROM e)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(funding) >= 0.08 THEN {r('raw * 0.85', 1)} ELSE raw END AS score FROM s""")
def rul_5(t):
    x = coin(t)
    n = col("l_linenumber")
    score = u.early_score(F.when(n != 2, col("p4") / 100), col("volume") * 40, F.when(n != 4, col("oi4")), col("cap"), col("funding"))
    return x.select(*KEY, score.alias("score"))


@query("rul_6_direction", f"""WITH {COIN_SQL}, b AS (SELECT *, CASE WHEN p4 >= 1 THEN 1 WHEN p4 <= -1 THEN -1 ELSE 0 END AS ps, CASE WHEN net >= 8 THEN 1 WHEN net <= -8 THEN -1 ELSE 0 END AS fs, CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN p4 > 0 THEN 1 ELSE -1 END AS way FROM coin),
d AS (SELECT *, CASE WHEN ps <> 0 AND ps = fs AND ps = way THEN ps ELSE 0 END AS bias FROM b)
SELECT l_orderkey, l_linenumber, CAST(bias AS INT) AS bias, CASE WHEN l_orderkey % 50 = 0 THEN 'stale' WHEN volume IS NULL THEN 'missing' WHEN NOT (l_orderkey % 4 > 0) OR bias = 0 OR (oi4 <= -3 OR bias = 1 AND rsi >= 75 OR bias = -1 AND rsi <= 25 OR atr >= 5 OR bias <> 0 AND bias * funding >= 0.1 OR coalesce(cap >= 50, false)
  OR bias <> 0 AND NOT oi4 >= 3 AND NOT coalesce(volume >= 1.5, false)) THEN 'wait' WHEN bias > 0 THEN 'long' ELSE 'short' END AS state FROM d""")
def rul_6(t):
    x = coin(t).withColumn("trend", F.when(col("l_linenumber") % 3 == 0, "ranging").when(col("p4") > 0, "up").otherwise("down"))
    names = {"price": "p4", "flow": "net", "oi": "oi4", "rsi": "rsi", "atr": "atr", "funding": "funding", "cap": "cap", "volume": "volume", "trend": "trend"}
    bias, state = u.direction_state({k: col(v) for k, v in names.items()}, col("l_orderkey") % 50 == 0, col("volume").isNull(), col("l_orderkey") % 4 > 0)
    return x.select(*KEY, bias.alias("bias"), state.alias("state"))


NOW = 1_706_400_000_000
EVIDENCE_SQL = f"""p AS (SELECT l_orderkey AS k, l_linenumber AS n, {NOW} - l_orderkey % 20 * {HOUR_MS} AS posted, CASE WHEN l_partkey % 9 <> 0 THEN {NOW} - l_orderkey % 20 * {HOUR_MS} - CAST(l_quantity - 10 AS BIGINT) * {HOUR_MS} END AS opened, CASE WHEN l_partkey % 13 <> 0 THEN {NOW} - l_suppkey % 9 * {HOUR_MS} END AS observed,
CASE WHEN l_suppkey % 7 <> 0 THEN {NOW} - l_orderkey % 20 * {HOUR_MS} - l_linenumber * {HOUR_MS} END AS before, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey END AS evidence_id, l_suppkey % 10 <> 0 AS same_author, CASE WHEN l_linestatus = 'O' THEN 'verified' ELSE CASE WHEN l_linenumber = 1 THEN 'screenshot' ELSE 'verified' END END AS grade,
CASE WHEN l_returnflag = 'A' THEN 'closed' ELSE 'open' END AS state, CAST(l_partkey % 3 AS INT) - 1 AS direction, CASE WHEN l_linenumber < 5 THEN CAST(l_partkey % 3 AS INT) - 1 ELSE 1 END AS side, CASE WHEN l_linenumber < 4 THEN CAST(l_partkey % 3 AS INT) - 1 ELSE -1 END AS before_side, l_suppkey % 14 <> 3 AS before_open, l_suppkey % 15 <> 4 AS is_call, l_suppkey % 16 <> 5 AS sourced,
  CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice END AS margin, CASE WHEN l_partkey % 4 <> 0 THEN l_extendedprice * (0.8 + l_suppkey % 9) END AS equity, l_suppkey % 2 = 0 AS history_verified, l_suppkey % 60 AS days, l_partkey % 40 AS closed, l_extendedprice - 20000 AS profit, CAST(l_suppkey % 30 AS DOUBLE) AS drawdown FROM lineitem),
s AS (SELECT *, CASE WHEN evidence_id IS NULL OR NOT same_author THEN 'unknown' WHEN grade <> 'verified' OR NOT sourced THEN 'unverified' WHEN observed IS NULL OR observed > {NOW} OR observed < posted OR coalesce(observed < opened, false) THEN 'unknown' WHEN {NOW} - observed > 6 * {HOUR_MS} THEN 'stale' WHEN state = 'closed' THEN 'closed'
WHEN direction <> 0 AND side <> direction THEN 'conflict' WHEN direction = 0 OR NOT is_call OR opened IS NULL THEN 'unknown' WHEN opened > posted OR before IS NULL OR before > posted THEN 'late' WHEN before < opened OR posted - before > 6 * {HOUR_MS} THEN 'unknown' WHEN NOT before_open OR before_side <> direction THEN 'conflict' ELSE 'aligned' END AS verdict FROM p)"""


def evidence(t):
    h, i = lambda c: c.cast("long") * HOUR_MS, (col("l_partkey") % 3).cast("int") - 1
    posted = NOW - h(col("l_orderkey") % 20)
    return t.lineitem.select(
        col("l_orderkey").alias("k"), col("l_linenumber").alias("n"), posted.alias("posted"), F.when(col("l_partkey") % 9 != 0, posted - h(col("l_quantity") - 10)).alias("opened"), F.when(col("l_partkey") % 13 != 0, NOW - h(col("l_suppkey") % 9)).alias("observed"),
        F.when(col("l_suppkey") % 7 != 0, posted - h(col("l_linenumber"))).alias("before"), F.when(col("l_partkey") % 11 != 0, col("l_partkey")).alias("evidence_id"), (col("l_suppkey") % 10 != 0).alias("same_author"), F.lit(True).alias("identity"),
        F.when((col("l_linestatus") != "O") & (col("l_linenumber") == 1), "screenshot").otherwise("verified").alias("grade"), F.when(col("l_returnflag") == "A", "closed").otherwise("open").alias("state"), i.alias("direction"),
        F.when(col("l_linenumber") < 5, i).otherwise(1).alias("side"), F.when(col("l_linenumber") < 4, i).otherwise(-1).alias("before_side"),
        *(((col("l_suppkey") % m) != k).alias(c) for c, m, k in (("before_open", 14, 3), ("is_call", 15, 4), ("sourced", 16, 5))), F.when(col("l_partkey") % 5 != 0, col("l_extendedprice")).alias("margin"), F.when(col("l_partkey") % 4 != 0, col("l_extendedprice") * (0.8 + col("l_suppkey") % 9)).alias("equity"),
        (col("l_suppkey") % 2 == 0).alias("history_verified"), (col("l_suppkey") % 60).alias("days"), (col("l_partkey") % 40).alias("closed"), (col("l_extendedprice") - 20_000).alias("profit"), (col("l_suppkey") % 30).cast("double").alias("drawdown"),
    )


SHARE_SQL = f"CASE WHEN margin > 0 AND equity > 0 THEN {r('margin / equity * 100', 2)} END"


@query("rul_12_evidence", f"""WITH {EVIDENCE_SQL}, w AS (SELECT *, {SHARE_SQL} AS share FROM s) SELECT k, n, verdict, share, CASE WHEN verdict = 'aligned' THEN {r(f'''least(1.75, 1 + 0.35 + CASE WHEN margin > 0 THEN {r("least(0.1, log10(1 + margin) / 50)", 2)} ELSE 0 END + CASE WHEN share <= 100 THEN {r("least(0.1, share / 200)", 2)} ELSE 0 END
 + {r(f"least(0.1, (posted - opened) / {HOUR_MS} / 240.0::DOUBLE)", 2)} + CASE WHEN history_verified AND days >= 30 AND closed >= 20 AND profit > 0 AND drawdown <= 20 THEN 0.1 ELSE 0 END)''', 2)} ELSE 1 END AS weight FROM w""")
def rul_12(t):
    """What a position says for an opinion: fifteen reasons against it in order, and for what is left a weight by capital, its share, time held and history."""
    x = evidence(t)
    x = x.withColumn("verdict", u.evidence_state({c: col(c) for c in x.columns}, F.lit(NOW)))
    share = F.when((col("margin") > 0) & (col("equity") > 0), r6(col("margin") / col("equity") * 100, 2))
    proven = col("history_verified") & (col("days") >= u.MIN_HISTORY_DAYS) & (col("closed") >= u.MIN_HISTORY_CYCLES) & (col("profit") > 0) & col("drawdown").between(0, 20)
    weight = u.evidence_weight(col("verdict"), col("margin"), share, (col("posted") - col("opened")) / HOUR_MS, proven)
    return x.select("k", "n", "verdict", share.alias("share"), weight.alias("weight"))


@query("rul_13_composite_cap", f"SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN least(abs(c_acctbal) / 100, 89) WHEN c_nationkey * 4 >= 60 THEN least(abs(c_acctbal) / 100, 49) ELSE {r('abs(c_acctbal) / 100 * 0.7 + (100 - c_nationkey * 4) * 0.3', 1)} END AS score, CASE WHEN c_nationkey % 5 = 0 THEN 'pending' WHEN c_nationkey * 4 >= 60 THEN 'flagged' ELSE 'verified' END AS status FROM customer")
def rul_13(t):
    score, status = u.capped_composite(F.abs("c_acctbal") / 100, F.when(col("c_nationkey") % 5 != 0, col("c_nationkey") * 4))
    return t.customer.select("c_custkey", score.alias("score"), status.alias("status"))


#: What a coin's market, traders and accounts do, for the flags.
MOVES_SQL = f"{COIN_SQL}, mv AS (SELECT *, p4 * 2 AS change, rsi AS top, 50 + net AS holders, CASE WHEN volume IS NOT NULL THEN volume * 0.8 END AS taker, CASE WHEN l_linenumber <> 2 THEN 0.6 + atr / 6 END AS accounts, CASE WHEN l_linenumber <> 5 THEN funding / 100 END AS rate FROM coin WHERE cap IS NOT NULL)"


@query("rul_14_coin_heat", f"""WITH {MOVES_SQL}, x AS (SELECT *, 100 * (l_linenumber / 10.0::DOUBLE * 0.35 + least(1, ln(1 + cap * 10) / ln(5000)) * 0.25 + least(1, ln(1 + rsi * 1e6) / ln(5e9)) * 0.25 + least(1, abs(change) / 20) * 0.15) AS heat,
  100 * (top / 100 * 0.30 + holders / 100 * 0.20 + CASE WHEN taker IS NULL THEN 0.5 ELSE greatest(0, least(1, (ln(greatest(0.01, taker)) + 1.5) / 3)) END * 0.25 + greatest(0, least(1, (change + 15) / 30)) * 0.25) AS feel FROM mv)
SELECT l_orderkey, l_linenumber, {r('heat', 4)} AS heat, {r('feel', 4)} AS sentiment, CASE WHEN {r('feel', 4)} >= 65 THEN 'up' WHEN {r('feel', 4)} <= 35 THEN 'down' ELSE 'neutral' END AS label, concat_ws(',', CASE WHEN change >= 3 AND top < 45 THEN 'price up, top traders sell' END, CASE WHEN change <= -3 AND top > 55 THEN 'price down, top traders buy' END, CASE WHEN accounts > 1.2 AND taker < 0.85 THEN 'accounts long, takers sell' END, CASE WHEN accounts < 0.8 AND taker > 1.15 THEN 'accounts short, takers buy' END, CASE WHEN rate < 0 AND change > 3 AND coalesce(taker, 0) > 1 THEN 'squeeze against negative funding' END, CASE WHEN rate > 0.0005 THEN 'funding makes longs dear' END) AS flags FROM x""")
def rul_14(t):
    """How much a coin is looked at, how it is felt about, and what is odd about it."""
    volume = col("volume")
    x = coin(t).where("cap is not null").withColumns({"change": col("p4") * 2, "top": col("rsi"), "holders": 50 + col("net"), "taker": volume * 0.8, "accounts": F.when(col("l_linenumber") != 2, 0.6 + col("atr") / 6), "rate": F.when(col("l_linenumber") != 5, col("funding") / 100)})
    heat = r6(u.coin_heat(col("l_linenumber") / 10, col("cap") * 10, col("rsi") * 1e6, col("change")), 4)
    feel = r6(u.coin_sentiment(col("top"), col("holders"), col("taker"), col("change")), 4)
    flags = u.coin_flags(*(col(c) for c in ("change", "top", "taker", "accounts", "rate")))
    return x.select(*KEY, heat.alias("heat"), feel.alias("sentiment"), F.when(feel >= 65, "up").when(feel <= 35, "down").otherwise("neutral").alias("label"), F.array_join(flags, ",").alias("flags"))


@query("rul_16_fusion", f"""WITH {COIN_SQL}, x AS (SELECT l_orderkey, l_linenumber, rsi AS heat, 50 + net AS sq, l_orderkey % 101 AS smart, l_orderkey % 61 AS conf, (rsi * 0.25 + (50 + net) * 0.20 + CAST(l_orderkey % 101 AS DOUBLE) * 0.40 + 7.5) AS score FROM coin)
SELECT l_orderkey, l_linenumber, {r('score * (0.55::DOUBLE + 0.45::DOUBLE * conf / 100)', 4)} AS decision, CASE WHEN conf < 20 AND heat >= 55 THEN 'hot without smart money' WHEN heat >= 55 AND sq >= 55 AND smart >= 60 AND conf >= 30 THEN 'resonance' WHEN heat >= 55 AND smart <= 40 AND conf >= 30 THEN 'hot but smart money short' WHEN heat >= 55 AND sq >= 60 AND smart < 55 AND conf >= 25 THEN 'unconfirmed'
WHEN heat >= 50 AND sq <= 40 AND smart >= 60 AND conf >= 30 THEN 'contrarian' WHEN smart >= 60 AND conf >= 30 AND heat < 55 THEN 'early' WHEN {r('score')} >= 60 AND smart >= 55 AND conf >= 25 THEN 'confirmed' WHEN smart <= 45 AND conf >= 30 THEN 'smart money short' ELSE 'no conclusion' END AS conclusion FROM x""")
def rul_16(t):
    x = coin(t).select(*KEY, col("rsi").alias("heat"), (50 + col("net")).alias("sq"), (col("l_orderkey") % 101).alias("smart"), (col("l_orderkey") % 61).alias("conf"))
    score, decision = u.fusion(col("heat"), col("sq"), col("smart"), F.lit(50), col("conf"))
    return x.select(*KEY, r6(decision, 4).alias("decision"), u.fusion_conclusion(col("heat"), col("sq"), col("smart"), r6(score), col("conf")).alias("conclusion"))


@query("rul_17_verdict", """SELECT event_id, CASE WHEN user_id % 6 = 0 THEN 'too few modules' WHEN event_type = 'error' THEN 'insufficient' WHEN greatest(a, b, c) = 1 AND least(a, b, c) = -1 THEN 'conflict' WHEN a = 0 OR b = 0 OR c = 0 THEN 'no consensus' WHEN a = 1 THEN 'aligned up' ELSE 'aligned down' END AS verdict
FROM (SELECT *, CAST(event_id % 3 AS INT) - 1 AS a, CAST(event_id // 3 % 3 AS INT) - 1 AS b, CAST(event_id // 9 % 3 AS INT) - 1 AS c FROM events)""")
def rul_17(t):
    d = [F.floor(col("event_id") / k).cast("int") % 3 - 1 for k in (1, 3, 9)]
    directions = F.when(col("user_id") % 6 == 0, F.array(d[0])).otherwise(F.array(*d))
    available = F.array((col("event_type") != "error"))
    return t.events.select("event_id", u.verdict(available, directions).alias("verdict"))


ANCHOR = NOW - 3 * HOUR_MS


@query("rul_18_module_availability", f"""WITH x AS (SELECT user_id AS coin, event_id, event_type, value, {K} AS k FROM events),
sq AS (SELECT coin, {NOW} - coin % 8 * {HOUR_MS} AS at_ms, count(DISTINCT event_id % 7) AS authors, count(DISTINCT event_id % 7) FILTER (k < 30 OR k >= 60) AS directional, (count(*) FILTER (k >= 60) - count(*) FILTER (k < 30)) * 100.0::DOUBLE / count(*) AS net FROM x WHERE event_type = 'view' GROUP BY 1),
cp AS (SELECT coin, count(*) AS addresses, count(*) FILTER (k >= 50) AS long, count(*) FILTER (k < 50) AS short FROM x WHERE event_type = 'purchase' GROUP BY 1),
ind AS (SELECT coin, {NOW} - coin % 9 * {HOUR_MS} AS at_ms, count(*) >= 10 AS quality, CASE WHEN avg(value) >= 55 THEN 1 WHEN avg(value) <= 45 THEN -1 ELSE 0 END AS direction FROM x WHERE event_type = 'click' GROUP BY 1),
c AS (SELECT DISTINCT coin FROM x)
SELECT coin, coalesce(sq.at_ms >= {ANCHOR} AND {NOW} - sq.at_ms <= {6 * HOUR_MS} AND authors >= 3 AND directional >= 2, false) AS square, CASE WHEN net >= 15 THEN 1 WHEN net <= -15 THEN -1 ELSE 0 END AS square_direction,
coalesce(quality AND {NOW} - ind.at_ms <= {6 * HOUR_MS}, false) AS indicators, coalesce(direction, 0) AS indicators_direction, coalesce(addresses >= 2, false) AS copy, CASE WHEN (long - short)::DOUBLE / addresses >= 0.34 THEN 1 WHEN (long - short)::DOUBLE / addresses <= -0.34 THEN -1 ELSE 0 END AS copy_direction
FROM c LEFT JOIN sq USING (coin) LEFT JOIN cp USING (coin) LEFT JOIN ind USING (coin)""")
def rul_18(t):
    """Which of the three sources says something of a coin, and what: posts by three authors of whom two are clear, fresh indicators of quality, two addresses."""
    k = F.get_json_object("props", "$.k").cast("int")
    x = t.events.select(col("user_id").alias("coin"), "event_id", "event_type", "value", k.alias("k"))
    of = lambda kind: x.where(col("event_type") == kind).groupBy("coin")
    author, up, down = col("event_id") % 7, col("k") >= 60, col("k") < 30
    posts = of("view").agg(F.countDistinct(author).alias("authors"), F.countDistinct(F.when(up | down, author)).alias("directional"), ((F.count_if(up) - F.count_if(down)) * 100.0 / F.count("*")).alias("net"))
    copy = of("purchase").agg(F.count("*").alias("addresses"), ((F.count_if(col("k") >= 50) - F.count_if(col("k") < 50)) / F.count("*")).alias("share"))
    ind = of("click").agg((F.count("*") >= 10).alias("quality"), exact_mean(col("value")).alias("level"))
    y = x.select("coin").distinct().join(posts, "coin", "left").join(copy, "coin", "left").join(ind, "coin", "left")
    now, no = F.lit(NOW), lambda c: F.coalesce(c, F.lit(False))
    square = u.square_available(NOW - col("coin") % 8 * HOUR_MS, F.lit(ANCHOR), now, col("authors"), col("directional"))
    usable = col("quality") & u.fresh(NOW - col("coin") % 9 * HOUR_MS, now)
    return y.select(
        "coin", no(square).alias("square"), u.sign_at(col("net"), 15).alias("square_direction"), no(usable).alias("indicators"), F.when(col("level") >= 55, 1).when(col("level") <= 45, -1).otherwise(0).alias("indicators_direction"),
        no(col("addresses") >= 2).alias("copy"), u.sign_at(col("share"), 0.34).alias("copy_direction"),
    )


@query("rul_19_pool_changes", "SELECT a.o_custkey AS id, b.pool AS before, a.pool AS after FROM (SELECT o_custkey, CASE WHEN avg(o_totalprice) > 250000 THEN 'quality' ELSE 'ordinary' END AS pool FROM orders GROUP BY 1) a LEFT JOIN (SELECT o_custkey, CASE WHEN avg(o_totalprice) > 250000 THEN 'quality' ELSE 'ordinary' END AS pool FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1) b USING (o_custkey) WHERE b.pool IS DISTINCT FROM a.pool")
def rul_19(t):
    pool = lambda x: x.groupBy(col("o_custkey").alias("id")).agg(F.when(F.avg("o_totalprice") > 250_000, "quality").otherwise("ordinary").alias("pool"))
    old = pool(t.orders.where("o_orderdate < TIMESTAMP_NTZ '1997-01-01'")).withColumnRenamed("pool", "before")
    x = pool(t.orders).join(old, "id", "left")
    return x.where(~col("pool").eqNullSafe(col("before"))).select("id", "before", col("pool").alias("after"))


#: What an evaluation reports of each head, made of a supplier's line items; some of it missing.
REPORT_SQL = """rep AS (SELECT l_suppkey AS head, (floor((avg(l_discount) - 0.03) * 1e6 + 0.5) / 1e6) AS bss, CASE WHEN l_suppkey % 17 <> 0 THEN 0.01 + l_suppkey % 5 / 200.0 END AS random_p95, CASE WHEN l_suppkey % 13 <> 0 THEN (floor((avg(l_tax) - 0.035) * 1e6 + 0.5) / 1e6) END AS residual_bss, CASE WHEN l_suppkey % 19 <> 0 THEN (floor((stddev_samp(l_tax) - 0.007) * 1e6 + 0.5) / 1e6) END AS ece, count(*) FILTER (l_returnflag = 'A') AS class_a, count(*) FILTER (l_returnflag = 'N') AS class_b, count(*) FILTER (l_returnflag = 'R') AS class_c,
 CASE WHEN l_suppkey % 11 = 0 THEN 2 ELSE 3 END AS folds, CASE WHEN l_suppkey % 23 <> 0 THEN (floor((avg(l_discount) FILTER (l_linenumber = 1) - 0.045) * 1e6 + 0.5) / 1e6) END AS worst_fold, sum(l_quantity) / 12 AS effective_n, sum(l_quantity) / 40 AS effective_test_n, count(DISTINCT l_shipdate) / 4 AS test_span_days, l_suppkey % 7 <> 3 AS same_cutpoints, CASE WHEN l_suppkey % 29 = 0 THEN 2 ELSE 1 END AS sampling_days,
 count(*) FILTER (l_linenumber = 1) / 3 AS trend_low, count(*) FILTER (l_linenumber = 2) / 3 AS trend_high, count(*) FILTER (l_linenumber = 3) / 3 AS vol_low, CASE WHEN l_suppkey % 31 <> 0 THEN count(*) FILTER (l_linenumber = 4) / 2 END AS vol_high, CASE WHEN l_suppkey % 37 <> 0 THEN 100 END AS identified, 88 + l_suppkey % 14 AS obtained, 12 - l_suppkey % 14 + (l_suppkey % 41 = 0)::INT AS listed, (l_suppkey % 43 = 0)::INT AS unexplained,
 CASE WHEN l_suppkey % 8 = 5 THEN 'leak_suspected' WHEN l_suppkey % 8 = 6 THEN 'inconclusive' ELSE 'clean' END AS leak FROM lineitem GROUP BY l_suppkey)"""
REASONS = {
    "baseline missing": "random_p95 IS NULL", "skill missing": "bss IS NULL", "skill below baseline": "bss IS NOT NULL AND random_p95 IS NOT NULL AND NOT bss > greatest(0, random_p95)", "residual skill missing": "residual_bss IS NULL", "residual skill not positive": "NOT residual_bss > 0",
    "calibration missing": "ece IS NULL", "calibration error high": "NOT ece < 0.02", "class without samples": "least(class_a, class_b, class_c) < 1", "class too small": "least(class_a, class_b, class_c) >= 1 AND least(class_a, class_b, class_c) < 120", "too few folds": "folds < 3", "fold skill missing": "worst_fold IS NULL", "fold skill not positive": "NOT worst_fold > 0",
    "training sample missing": "effective_n IS NULL", "training sample small": "effective_n < 880", "test sample missing": "effective_test_n IS NULL", "test sample small": "effective_test_n < 250", "test span missing": "test_span_days IS NULL", "test span short": "test_span_days < 60", "regimes of other cutpoints": "NOT same_cutpoints", "test days not daily": "sampling_days <> 1",
    **{f"regime {b.replace('_', ' ')} missing": f"{b} IS NULL" for b in ("trend_low", "trend_high", "vol_low", "vol_high")}, **{f"regime {b.replace('_', ' ')} thin": f"{b} < 30" for b in ("trend_low", "trend_high", "vol_low", "vol_high")},
    "universe not stated": "identified IS NULL OR obtained > identified", "delisted too few": "obtained <= identified AND obtained::DOUBLE / identified < 0.9", "unobtained not listed": "obtained <= identified AND listed <> identified - obtained", "unobtained unexplained": "obtained <= identified AND listed = identified - obtained AND unexplained > 0", "control not clean": "leak <> 'clean'",
}


@query("rul_20_gate", f"""WITH {REPORT_SQL}, g AS (SELECT head, concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in REASONS.items())}) AS reasons FROM rep) SELECT head, reasons = '' AS pass, reasons FROM g""")
def rul_20(t):
    """The gate over a report of each head, with all reasons against it; ``operators.gate`` is the same over a report as a document."""
    k, n, d = col("l_suppkey"), F.count("*"), col("l_discount")
    line = lambda i: F.count_if(col("l_linenumber") == i)
    flag = lambda f: F.count_if(col("l_returnflag") == f)
    g = t.lineitem.groupBy("l_suppkey").agg(
        r6(F.avg(d) - 0.03).alias("bss"), F.avg("l_tax").alias("tax"), F.stddev_samp("l_tax").alias("sd"), flag("A").alias("class_a"), flag("N").alias("class_b"), flag("R").alias("class_c"), r6(F.avg(F.when(col("l_linenumber") == 1, d)) - 0.045).alias("fold"),
        (F.sum("l_quantity") / 12).alias("effective_n"), (F.sum("l_quantity") / 40).alias("effective_test_n"), (F.countDistinct("l_shipdate") / 4).alias("test_span_days"), (line(1) / 3).alias("trend_low"), (line(2) / 3).alias("trend_high"), (line(3) / 3).alias("vol_low"), (line(4) / 2).alias("vol_4"), n.alias("n"),
    )
    report = g.select(
        k.alias("head"), "bss", F.when(k % 17 != 0, 0.01 + k % 5 / 200).alias("random_p95"), F.when(k % 13 != 0, r6(col("tax") - 0.035)).alias("residual_bss"), F.when(k % 19 != 0, r6(col("sd") - 0.007)).alias("ece"), F.array("class_a", "class_b", "class_c").alias("class_counts"),
        F.when(k % 11 == 0, F.array(F.when(k % 23 != 0, col("fold")), F.lit(1.0))).otherwise(F.array(F.when(k % 23 != 0, col("fold")), F.lit(1.0), F.lit(1.0))).alias("folds"), "effective_n", "effective_test_n", "test_span_days", (k % 7 != 3).alias("same_cutpoints"), F.when(k % 29 == 0, 2).otherwise(1).alias("sampling_days"),
        "trend_low", "trend_high", "vol_low", F.when(k % 31 != 0, col("vol_4")).alias("vol_high"), F.when(k % 37 != 0, 100).alias("identified"), (88 + k % 14).alias("obtained"), (12 - k % 14 + (k % 41 == 0).cast("int")).alias("listed"), (k % 43 == 0).cast("int").alias("unexplained"),
        F.when(k % 8 == 5, "leak_suspected").when(k % 8 == 6, "inconclusive").otherwise("clean").alias("leak"),
    )
    reasons = gate.reasons({"ece_max": 0.02, "min_class_samples": 120})
    return report.select("head", (F.size(reasons) == 0).alias("pass"), F.array_join(reasons, ",").alias("reasons"))


@query("rul_21_leak_check", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 OR p_size / 50.0 <= 0.3 THEN 'inconclusive' WHEN p_partkey % 10 / 10.0 > 0.3 THEN 'leak_suspected' ELSE 'clean' END AS status FROM part")
def rul_21(t):
    real = F.when(col("p_size") % 7 != 0, col("p_size") / 50)
    return t.part.select("p_partkey", u.leak_status(real, col("p_partkey") % 10 / 10, F.lit(0.3)).alias("status"))


@query("rul_22_range_plan", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_custkey % 3 = 0 THEN CASE WHEN o_totalprice >= 200000 THEN 'skip' ELSE 'extend' END ELSE 'fetch-all' END AS plan FROM orders")
def rul_22(t):
    return t.orders.select("o_orderkey", u.range_plan(col("o_orderstatus") != "P", col("o_custkey") % 3, col("o_totalprice"), F.lit(0), F.lit(200_000)).alias("plan"))


@query("rul_23_anchor", f"""WITH x AS (SELECT user_id, max((epoch_us(ts) // 1000)) FILTER (event_type = 'view' AND epoch_us(ts) // 1000 <= {NOW}) AS sq, max((epoch_us(ts) // 1000)) FILTER (event_type = 'click' AND epoch_us(ts) // 1000 <= {NOW}) AS cp, max((epoch_us(ts) // 1000)) FILTER (event_type = 'error') AS cutoff, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY 1)
SELECT user_id, CASE WHEN user_id % 3 = 0 AND cutoff IS NOT NULL THEN cutoff ELSE least({NOW}, sq, cp) // {HOUR_MS} * {HOUR_MS} END AS anchor, coalesce({NOW} - last <= {6 * HOUR_MS} AND last <= {NOW} + 60000, false) AS fresh FROM x""")
def rul_23(t):
    """What sources are compared at: the indicators' cutoff where they take part, else the hour of the earliest of now and the others' times, those in the future left out; and whether the last of a source is fresh."""
    at = F.unix_millis(col("ts").cast("timestamp"))
    last = lambda kind: F.max(F.when((col("event_type") == kind) & (at <= NOW), at))
    x = t.events.groupBy("user_id").agg(last("view").alias("sq"), last("click").alias("cp"), F.max(F.when(col("event_type") == "error", at)).alias("cutoff"), F.max(at).alias("last"))
    return x.select("user_id", u.anchor(F.when(col("user_id") % 3 == 0, col("cutoff")), F.lit(NOW), col("sq"), col("cp")).alias("anchor"), F.coalesce(u.fresh(col("last"), F.lit(NOW)), F.lit(False)).alias("fresh"))


@query("rul_24_early_candidate", f"WITH {COIN_SQL} SELECT l_orderkey, l_linenumber FROM coin WHERE oi4 >= 3 AND abs(p4) < 1 AND net >= 5 AND cap < 30")
def rul_24(t):
    return coin(t).where((col("oi4") >= 3) & (F.abs("p4") < 1) & (col("net") >= 5) & (col("cap") < 30)).select(*KEY)


@query("rul_25_momentum_label", f"WITH {wq.BARS4} SELECT symbol, t, CASE WHEN p IS NULL THEN NULL WHEN p >= 1 THEN 1 WHEN p <= -1 THEN -1 ELSE 0 END AS side FROM (SELECT symbol, t, (c / lag(c) OVER (PARTITION BY symbol ORDER BY t) - 1) * 100 AS p FROM bars)")
def rul_25(t):
    p = change(col("c"), F.lag("c").over(by_time()))
    x = wq.h4(t).withColumn("p", p)
    return x.select("symbol", "t", F.when(col("p").isNotNull(), u.sign_at(col("p"), 1)).alias("side"))
