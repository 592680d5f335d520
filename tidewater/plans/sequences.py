"""Queries of funding, labels, structure and position cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, HOUR_MS, round_half_up
from ..functions.windows import full, slope
from ..operators import bars as b
from ..operators import cycles as cy
from ..operators import funding as fu
from ..operators import labels as la
from ..operators import structure as st
from . import windows as wq
from .registry import bars_sql, query, r

H4 = 4 * HOUR_MS
col = F.col
r6 = round_half_up

# --- funding: closes of four-hour bars, some of them removed, as settlements with changing intervals

FUNDING_SQL = f"{bars_sql(H4)}, funding AS (SELECT symbol, t AS time, (c - 50) / 100000 AS rate FROM bars WHERE t // {H4} % 7 <> 3)"
NORMAL_SQL = f"""{FUNDING_SQL}, g AS (SELECT *, time - lag(time) OVER w AS gap, lead(time) OVER w AS next_time, lead(time) OVER w - time AS next_gap FROM funding WINDOW w AS (PARTITION BY symbol ORDER BY time)),
normal AS (SELECT symbol, time, rate, CASE WHEN gap = {H4} THEN 4 WHEN gap = 2 * {H4} THEN 8 END AS hours, next_time, CASE WHEN next_gap = {H4} THEN 4 WHEN next_gap = 2 * {H4} THEN 8 END AS next_hours,
  rate * 100 * 24 / CASE WHEN gap = {H4} THEN 4 WHEN gap = 2 * {H4} THEN 8 END AS daily FROM g WHERE gap IN ({H4}, 2 * {H4}))"""


def settlements(t):
    x = b.from_events(t.events, H4)
    return x.where(col("t") / H4 % 7 != 3).select("symbol", col("t").alias("time"), ((col("c") - 50) / 100_000).alias("rate"))


@query("win_21_funding_interval", f"WITH {NORMAL_SQL} SELECT symbol, time, hours, {r('daily')} AS daily FROM normal WHERE next_time IS NULL OR next_hours IS NOT DISTINCT FROM hours")
def win_21(t):
    return fu.kept(fu.normalised(settlements(t))).select("symbol", "time", "hours", r6(col("daily")).alias("daily"))


@query("win_22_funding_by_gap", f"""WITH {FUNDING_SQL}, g AS (SELECT *, time - lag(time) OVER (PARTITION BY symbol ORDER BY time) AS gap FROM funding), m AS (SELECT symbol, median(gap) AS m FROM g GROUP BY 1)
SELECT symbol, time, {r(f'rate * 100 * {DAY_MS} / gap')} AS daily FROM g JOIN m USING (symbol) WHERE gap BETWEEN 0.5 * m AND 2 * m""")
def win_22(t):
    return fu.by_actual_gap(settlements(t)).select("symbol", "time", r6(col("daily")).alias("daily"))


TRUTH = f"CASE WHEN (time // {H4} + 6) % 7 = 3 THEN 8 ELSE 4 END"


@query("win_23_interval_truth", f"""WITH {FUNDING_SQL}, f AS (SELECT symbol, time + CASE WHEN time // {H4} % 11 = 5 THEN {int(1.5 * HOUR_MS)} ELSE 0 END AS time, {TRUTH} AS truth FROM funding),
g AS (SELECT *, (time - lag(time) OVER w) / {HOUR_MS}.0 AS gap, (lead(time) OVER w - time) / {HOUR_MS}.0 AS next_gap FROM f WINDOW w AS (PARTITION BY symbol ORDER BY time)),
s AS (SELECT *, CASE WHEN abs(gap - 1) <= 0.1 THEN 1 WHEN abs(gap - 2) <= 0.2 THEN 2 WHEN abs(gap - 4) <= 0.4 THEN 4 WHEN abs(gap - 8) <= 0.8 THEN 8 END AS hours, CASE WHEN abs(next_gap - 1) <= 0.1 THEN 1 WHEN abs(next_gap - 2) <= 0.2 THEN 2 WHEN abs(next_gap - 4) <= 0.4 THEN 4 WHEN abs(next_gap - 8) <= 0.8 THEN 8 END AS next_hours FROM g),
k AS (SELECT *, gap IS NOT NULL AND hours IS NOT NULL AND (next_gap IS NULL OR next_hours IS NOT DISTINCT FROM hours) AS kept FROM s), l AS (SELECT *, lag(hours) OVER (PARTITION BY symbol ORDER BY time) AS before FROM k WHERE kept)
SELECT symbol, (SELECT count(*) FROM l WHERE l.symbol = k.symbol) AS compared, (SELECT count(*) FROM l WHERE l.symbol = k.symbol AND hours = truth) AS matched, (SELECT count(*) FROM l WHERE l.symbol = k.symbol AND hours <> truth AND truth = before) AS lagging,
count(*) FILTER (gap IS NOT NULL AND NOT kept) AS refused, count(*) FILTER (gap IS NOT NULL AND hours IS NULL AND next_hours = truth) AS refused_by_next, count(*) FILTER (hours IS NOT NULL AND next_hours > hours) AS longer, count(*) FILTER (hours IS NOT NULL AND next_hours < hours) AS shorter, count(*) FILTER (hours IS NOT NULL AND next_gap IS NOT NULL AND next_hours IS NULL) AS broken FROM k GROUP BY 1""")
def win_23(t):
    """Intervals inferred from gaps against the true ones: what agrees, what lags one row behind, what is refused and what its next gap says, and the changes by their pattern. Some settlements are late, so that gaps fit no interval."""
    late = F.when(F.floor(col("time") / H4) % 11 == 5, int(1.5 * HOUR_MS)).otherwise(0)
    x = settlements(t).withColumns({"truth": F.when((col("time") / H4 + 6) % 7 == 3, 8).otherwise(4), "time": col("time") + late})
    return fu.interval_check(x)


@query("win_20_funding_z", f"""WITH {NORMAL_SQL}, d AS (SELECT symbol, unnest(range({1704067200000 + 10 * DAY_MS}, {1704067200000 + 30 * DAY_MS}, {DAY_MS})) AS "at" FROM (SELECT DISTINCT symbol FROM bars)),
z AS (SELECT d.symbol, d."at", count(daily) AS n, median(daily) AS m, quantile_cont(daily, 0.75) - quantile_cont(daily, 0.25) AS iqr, arg_max(daily, time) AS now, max(time) AS last, min(time) AS first
  FROM d LEFT JOIN normal f ON f.symbol = d.symbol AND f.time > d."at" - {15 * DAY_MS} AND f.time <= d."at" AND (f.next_time IS NULL OR f.next_time > d."at" OR f.next_hours IS NOT DISTINCT FROM f.hours) GROUP BY 1, 2)
SELECT symbol, "at", CASE WHEN n >= 20 AND last - first >= {8 * DAY_MS} AND "at" - last <= 9 * {HOUR_MS} THEN {r('greatest(-5, least(5, (now - m) / greatest(iqr, 0.01)))')} END AS z FROM z""")
def win_20(t):
    days = F.sequence(F.lit(1_704_067_200_000 + 10 * DAY_MS), F.lit(1_704_067_200_000 + 29 * DAY_MS), F.lit(DAY_MS))
    decisions = b.from_events(t.events, H4).select("symbol").distinct().select("symbol", F.explode(days).alias("at"))
    z = fu.z_scores(decisions, fu.normalised(settlements(t)), floor=0.01, days=15, least=20, span_days=8)
    return z.select("symbol", "at", r6(col("z")).alias("z"))


# --- labels

LABEL_SQL = f"""{wq.ATR_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn, count(*) OVER (PARTITION BY symbol) AS total, 1.0 * atr / c + 0.001 AS width FROM p),
j AS (SELECT x.symbol, x.t, x.width, x.rn, x.total, y.t AS yt, y.rn - x.rn AS i, y.h >= x.c * (1 + x.width) AS hi, y.l <= x.c * (1 - x.width) AS lo, y.t - lag(y.t) OVER (PARTITION BY x.symbol, x.t ORDER BY y.t) AS gap FROM x JOIN x y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn AND x.rn + 6),
e AS (SELECT symbol, t, any_value(width) AS width, any_value(total) - any_value(rn) AS ahead, min(struct_pack(i := i, yt := yt, k := CASE WHEN gap <> {H4} THEN 'gap' WHEN hi AND lo THEN 'both' WHEN hi THEN 'up' ELSE 'down' END)) FILTER (i > 0 AND (gap <> {H4} OR hi OR lo)) AS f FROM j GROUP BY 1, 2),
z AS (SELECT symbol, t, CASE WHEN ahead >= 6 AND width IS NOT NULL AND coalesce(f.k, '') <> 'gap' THEN CASE f.k WHEN 'both' THEN 'down' WHEN 'up' THEN 'up' WHEN 'down' THEN 'down' ELSE 'flat' END END AS label, f.yt AS yt, f.k AS k FROM e)"""


def labelled(t):
    return la.triple_barrier(wq.with_atr(wq.h4(t)), horizon=6, step_ms=H4, k=1.0, cost=0.001)


@query("win_41_triple_barrier", f"WITH {LABEL_SQL} SELECT symbol, t, label, CASE WHEN label <> 'flat' THEN yt END AS touch, coalesce(label IS NOT NULL AND k = 'both', false) AS ambiguous FROM z")
def win_41(t):
    return labelled(t)


SETTLED_AT = 1_705_752_000_000
SETTLE_SQL = f"""{LABEL_SQL.replace("FROM p),", f"FROM p WHERE NOT (symbol IN ('click', 'view') AND t >= {SETTLED_AT})),", 1).replace("ahead >= 6 AND", "(ahead >= 6 OR symbol IN ('click', 'view')) AND")}, k AS (SELECT z.*, symbol IN ('click', 'view') AND t + {7 * H4} > {SETTLED_AT} AS settled FROM z)"""


@query("win_43_labels_by_day_kind", f"""WITH {SETTLE_SQL} SELECT settled, count(*) AS n, count(*) FILTER (label IS NULL) AS missing, {", ".join(f"count(*) FILTER (label = '{c}') AS {c}, {r(f"count(*) FILTER (label = '{c}')::DOUBLE / nullif(count(label), 0)")} AS {c}_share" for c in la.CLASSES)} FROM k GROUP BY 1""")
def win_43(t):
    """How outcomes are spread where the window was cut by a settlement, beside the others: two contracts end early, and what their last bars touched counts."""
    ends = col("symbol").isin("click", "view")
    x = wq.with_atr(wq.h4(t)).where(~(ends & (col("t") >= SETTLED_AT)))
    y = la.triple_barrier(x, horizon=6, step_ms=H4, k=1.0, cost=0.001, settled=ends)
    y = y.withColumn("settled", ends & (col("t") + 7 * H4 > SETTLED_AT))
    n = F.count("label")
    shares = [e for c in la.CLASSES for e in (F.count_if(col("label") == c).alias(c), r6(F.count_if(col("label") == c) / F.nullif(n, F.lit(0))).alias(f"{c}_share"))]
    return y.groupBy("settled").agg(F.count("*").alias("n"), F.count_if(col("label").isNull()).alias("missing"), *shares)


@query("win_42_residual_barrier", f"""WITH {wq.RETS}, be AS (SELECT *, CASE WHEN count(ret) OVER q = 42 THEN regr_slope(ret, mret) OVER q END AS beta, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn, atr / c + 0.001 AS width
  FROM rr JOIN (SELECT t AS mt, c AS mc FROM market) m ON m.mt = rr.t WINDOW q AS (PARTITION BY symbol ORDER BY t ROWS 41 PRECEDING)),
j AS (SELECT x.symbol, x.t, x.beta, x.width, y.rn - x.rn AS i, (y.c / x.c - 1) - x.beta * (y.mc / x.mc - 1) AS path FROM be x JOIN be y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn AND x.rn + 6),
e AS (SELECT symbol, t, any_value(beta) AS beta, any_value(width) AS width, max(i) AS ahead, min(struct_pack(i := i, p := path)) FILTER (i > 0 AND abs(path) >= width) AS f FROM j GROUP BY 1, 2)
SELECT symbol, t, CASE WHEN ahead = 6 AND beta IS NOT NULL AND width IS NOT NULL THEN CASE WHEN f IS NULL THEN 'flat' WHEN f.p > 0 THEN 'up' ELSE 'down' END END AS label FROM e""")
def win_42(t):
    x = wq.with_market(t).withColumn("beta", F.when(full(col("ret"), 42), slope("ret", "mret", 42)))
    return la.residual_barrier(x, 6, col("beta"), col("atr") / col("c") + 0.001)


# --- structure (state along the bars: no SQL, see the tests)


@query("win_34_zigzag")
def win_34(t):
    return st.swings(wq.h4(t), mult=2.0)


@query("win_34_zigzag_percent")
def win_34_percent(t):
    """Turns by a part of the extreme's price instead of mean ranges."""
    return st.swings(wq.h4(t), mult=40.0, pct=True)


@query("win_37_range_detection")
def win_37(t):
    return st.features(wq.h4(t), 84, 24, H4).select("symbol", "t", "state", "reason", r6(col("top")).alias("top"), r6(col("bottom")).alias("bottom"))


@query("win_38_structure_snapshot")
def win_38(t):
    """The structure as of each symbol's last bar, with the swings that are known then."""
    x = st.snapshots(wq.h4(t), 84)
    return x.withColumns({c: r6(col(c)) for c in ("top", "bottom", "height_atr", "containment", "coverage")})


@query("win_39_structure_features")
def win_39(t):
    """On hourly bars with a week of look-back and on four-hour bars with two."""
    both = st.features(wq.h4(t), 84, 24, H4).withColumn("hours", F.lit(4)).unionByName(st.features(wq.h1(t), 168, 48, HOUR_MS).withColumn("hours", F.lit(1)))
    return both.select("hours", "symbol", "t", "state", "reason", r6(col("f1")).alias("f1"), "f1_occurred", "f2_up", "f2_down", r6(col("f3")).alias("f3"))


@query("prj_17_structure_dummies")
def prj_17(t):
    return st.features(wq.h4(t), 84, 24, H4).select("symbol", "t", "f2_up", "f2_down")


# --- orders and cycles


def orders(t):
    """Purchases open and errors close a long position of a user in one of five symbols."""
    x = t.events.where("event_type in ('purchase', 'error')")
    return x.select(
        col("user_id").alias("trader"), F.concat(F.lit("S"), (col("user_id") % 5).cast("string")).alias("symbol"), F.lit("LONG").alias("side"), (col("event_type") == "purchase").alias("opens"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"), col("value").alias("price"), F.when(col("event_type") == "error", col("value") - 50).alias("pnl"), F.unix_millis(col("ts").cast("timestamp")).alias("time"), col("event_id").alias("ordinal"),
    )


@query("win_44_position_cycles")
def win_44(t):
    return cy.cycles(orders(t), strict=True)


@query("win_45_clipped_cycles")
def win_45(t):
    return cy.cycles(orders(t), strict=False)


@query("win_48_open_cost")
def win_48(t):
    """What traders hold at cost and have traded lately, as votes for each symbol: the side by the root of its share of the trader's book."""
    x = orders(t)
    votes = cy.votes(cy.open_cost(x), x, 1_706_659_200_000 - 7 * DAY_MS, 1_706_659_200_000)
    return votes.select("trader", "symbol", *(r6(col(c)).alias(c) for c in ("long", "short", "holding", "flow", "turnover")), "orders")
