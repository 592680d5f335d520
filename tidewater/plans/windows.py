"""Queries of window functions over bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.scalars import DAY_MS, HOUR_MS, change, ratio, round_half_up, utc_hour
from ..operators import bars as b
from ..operators import features as fe
from ..operators import sliding as sl
from .registry import bars_sql, query, r

H4 = 4 * HOUR_MS
col = F.col
r6 = round_half_up
#: Bars of the trailing windows: two weeks of hours, with the bars that the mean range before them needs, and what four-hour rankings use.
TRAIL, NEED, RANK = w.TRAIL, w.NEED, 48


def h4(t):
    return b.from_events(t.events, H4)


def h1(t):
    """Hourly bars of each type of event and, as the symbol ALL, of the market."""
    return b.from_events(t.events, HOUR_MS, F.explode(F.array("event_type", F.lit("ALL"))))


BARS4, BARS1 = bars_sql(H4), bars_sql(HOUR_MS, market=True)
TR = "greatest(h - l, coalesce(abs(h - lag(c) OVER w), h - l), coalesce(abs(l - lag(c) OVER w), h - l))"


def atr_sql(bars: str, step: int | None = None) -> str:
    """Bars with their mean true range; with a step, none where the 14 bars have a gap."""
    gap = f" AND t - lag(t, 13) OVER w1 = {13 * step}" if step else ""
    return f"""{bars}, tr AS (SELECT *, {TR} AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
a AS (SELECT *, CASE WHEN count(*) OVER w14 = 14{gap} THEN avg(tr) OVER w14 END AS atr FROM tr WINDOW w14 AS (PARTITION BY symbol ORDER BY t ROWS 13 PRECEDING), w1 AS (PARTITION BY symbol ORDER BY t)),
p AS (SELECT *, atr / c * 100 AS atr_pct FROM a)"""


ATR_SQL, ATR1_SQL = atr_sql(BARS4), atr_sql(BARS1, HOUR_MS)
#: Hourly bars with whether the 349 of the longest window have no gap.
WHOLE_SQL = f"{ATR1_SQL}, q AS (SELECT *, coalesce(t - lag(t, {NEED - 1}) OVER (PARTITION BY symbol ORDER BY t) = {(NEED - 1) * HOUR_MS}, false) AS whole FROM p)"


def with_atr(bars, n=14, step=None):
    x = bars.withColumn("tr", w.true_range()).withColumn("atr", w.mean_of("tr", n, step_ms=step))
    return x.withColumn("atr_pct", col("atr") / col("c") * 100)


def hourly(t):
    return with_atr(h1(t), step=HOUR_MS).withColumn("whole", w.contiguous(col("t"), NEED, HOUR_MS))


def midrank_sql(c: str, n: int, source: str, step: int | None = None, by: str = "symbol") -> str:
    """A mid-rank by joining each row to the rows of its frame."""
    gap = f" AND max(y.t) - min(y.t) = {step * (n - 1)}" if step else ""
    keys = by.split(", ")
    return f"""(SELECT x.symbol, x.t, CASE WHEN count(y.{c}) = {n} AND count(y.rn) = {n}{gap} THEN 100.0::DOUBLE * (count(*) FILTER (y.{c} < x.{c}) + 0.5 * count(*) FILTER (y.{c} = x.{c})) / {n} END AS mr
      FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY t) AS rn FROM {source}) x JOIN (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY t) AS rn FROM {source}) y
        ON {" AND ".join(f"x.{k} = y.{k}" for k in keys)} AND y.rn BETWEEN x.rn - {n - 1} AND x.rn GROUP BY 1, 2)"""


def at_both(sql) -> str:
    """The SQL for hourly and for four-hour bars, one after the other."""
    return " UNION ALL ".join(f"SELECT * FROM ({sql(step)})" for step in (HOUR_MS, H4))


def both(f):
    return f(HOUR_MS).unionByName(f(H4))


@query("flt_1_bars", f"WITH {BARS4} SELECT symbol, t, o, h, l, c, {r('v')} AS v, {r('tb')} AS tb, trades FROM bars")
def flt_1(t):
    return h4(t).select("symbol", "t", "o", "h", "l", "c", r6(col("v")).alias("v"), r6(col("tb")).alias("tb"), "trades")


@query("flt_3_contiguous_tail", f"""WITH {bars_sql(HOUR_MS)} SELECT symbol, t, coalesce(t - lag(t, 5) OVER (PARTITION BY symbol ORDER BY t) = 5 * {HOUR_MS}, false) AS whole FROM bars""")
def flt_3(t):
    return b.from_events(t.events, HOUR_MS).select("symbol", "t", w.contiguous(col("t"), 6, HOUR_MS).alias("whole"))


@query("win_1_true_range", f"WITH {ATR_SQL} SELECT symbol, t, {r('tr')} AS tr FROM p")
def win_1(t):
    return with_atr(h4(t)).select("symbol", "t", r6(col("tr")).alias("tr"))


@query("win_2_atr", f"WITH {ATR_SQL} SELECT symbol, t, {r('atr')} AS atr FROM p")
def win_2(t):
    return with_atr(h4(t)).select("symbol", "t", r6(col("atr")).alias("atr"))


@query("win_3_midrank", f"WITH {BARS1} SELECT symbol, t, {r('mr')} AS midrank FROM {midrank_sql('c', TRAIL, 'bars', HOUR_MS)}")
def win_3(t):
    return sl.sliding(h1(t).select("symbol", "t", "c"), {"mr": sl.mid_rank("c", TRAIL)}, HOUR_MS).select("symbol", "t", r6(col("mr")).alias("midrank"))


@query("win_4_share_at_most", f"""WITH {BARS4}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM bars)
SELECT x.symbol, x.t, CASE WHEN count(y.c) >= 8 THEN {r('100.0::DOUBLE * count(*) FILTER (y.c <= x.c) / count(y.c)', 1)} END AS pct
FROM x LEFT JOIN x y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn - {RANK} AND x.rn - 1 GROUP BY 1, 2""")
def win_4(t):
    return sl.sliding_rows(h4(t).select("symbol", "t", "c"), {"share": sl.share_at_most("c", RANK)}, "symbol", [col("t")]).select("symbol", "t", r6(col("share"), 1).alias("pct"))


def fold_sql(n: int, source: str = "bars", c: str = "c") -> str:
    return f"(SELECT symbol, t, list({c}) OVER (PARTITION BY symbol ORDER BY t ROWS {n - 1} PRECEDING) AS x, min(t) OVER (PARTITION BY symbol ORDER BY t ROWS {n - 1} PRECEDING) AS first FROM {source})"


@query("win_5_ema", f"""WITH {BARS1} SELECT symbol, t, CASE WHEN len(x) = 360 AND t - first = {359 * HOUR_MS} THEN {r('list_reduce(list_concat([list_avg(x[1:60])], x[61:360]), lambda e, v: e + 2.0::DOUBLE / 61 * (v - e))')} END AS ema FROM {fold_sql(360)}""")
def win_5(t):
    return h1(t).select("symbol", "t", r6(w.ema("c", 60, 360, step_ms=HOUR_MS)).alias("ema"))


@query("win_6_rsi", f"""WITH RECURSIVE {BARS4}, d AS (SELECT symbol, t, row_number() OVER w AS rn, lag(t, 29) OVER w AS t30, c - lag(c) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
k AS (SELECT x.symbol, x.t, y.rn - x.rn + 29 AS i, greatest(y.d, 0) AS g, greatest(-y.d, 0) AS l FROM d x JOIN d y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn - 28 AND x.rn WHERE x.rn >= 30 AND x.t - x.t30 = {29 * H4}),
s AS (SELECT symbol, t, 14 AS i, sum(g) / 14 AS g, sum(l) / 14 AS l FROM k WHERE i <= 14 GROUP BY 1, 2
      UNION ALL SELECT s.symbol, s.t, s.i + 1, (s.g * 13 + k.g) / 14, (s.l * 13 + k.l) / 14 FROM s JOIN k ON s.symbol = k.symbol AND s.t = k.t AND k.i = s.i + 1)
SELECT b.symbol, b.t, {r('CASE WHEN s.l = 0 THEN CASE WHEN s.g = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + s.g / s.l) END', 5)} AS rsi FROM bars b LEFT JOIN s ON b.symbol = s.symbol AND b.t = s.t AND s.i = 29""")
def win_6(t):
    return h4(t).select("symbol", "t", r6(w.rsi("c", 14, 30, step_ms=H4), 5).alias("rsi"))


@query("win_7_exact_return", f"WITH {BARS1} SELECT symbol, t, CASE WHEN t - lag(t, 24) OVER w = 24 * {HOUR_MS} AND lag(c, 24) OVER w > 0 THEN {r('(c / lag(c, 24) OVER w - 1) * 100')} END AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)")
def win_7(t):
    return h1(t).select("symbol", "t", r6(w.exact_change(24, HOUR_MS)).alias("ret"))


#: The end of the series that price changes are of: all its bars must be there.
CUTOFF = 1_706_659_200_000


@query("win_8_price_changes", f"""WITH {BARS1}, x AS (SELECT *, lag(t) OVER w AS before FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
y AS (SELECT *, bool_and(before IS NULL OR t - before = {HOUR_MS}) OVER (PARTITION BY symbol) AND max(t) OVER (PARTITION BY symbol) = {CUTOFF - HOUR_MS} AS ok FROM x)
SELECT symbol, t, {", ".join(f"CASE WHEN ok THEN {r(f'(c / lag(c, {k}) OVER w - 1) * 100')} END AS h{k}" for k in (1, 4, 24))} FROM y WINDOW w AS (PARTITION BY symbol ORDER BY t)""")
def win_8(t):
    """Changes over an hour, four and a day, of series without a gap up to the cutoff."""
    series = Window.partitionBy("symbol")
    x = h1(t).withColumn("step", col("t") - F.lag("t").over(w.by_time()))
    x = x.withColumn("ok", F.bool_and(F.coalesce(col("step") == HOUR_MS, F.lit(True))).over(series) & (F.max("t").over(series) == CUTOFF - HOUR_MS))
    return x.select("symbol", "t", *(F.when(col("ok"), r6(w.exact_change(k, HOUR_MS))).alias(f"h{k}") for k in (1, 4, 24)))


@query("win_9_volume_ratio", f"""WITH {BARS1}, x AS (SELECT symbol, t, sum(v) OVER (PARTITION BY symbol ORDER BY t ROWS 3 PRECEDING) AS a, sum(v) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 27 PRECEDING AND 4 PRECEDING) / 6 AS b,
count(v) OVER (PARTITION BY symbol ORDER BY t ROWS 27 PRECEDING) AS n, t - lag(t, 27) OVER (PARTITION BY symbol ORDER BY t) = {27 * HOUR_MS} AS whole FROM bars) SELECT symbol, t, CASE WHEN n = 28 AND whole AND b > 0 THEN {r('a / b')} END AS ratio FROM x""")
def win_9(t):
    return h1(t).select("symbol", "t", r6(w.volume_ratio(4, 24, step_ms=HOUR_MS)).alias("ratio"))


@query("win_10_effort_result", f"""WITH {WHOLE_SQL}, e AS (SELECT symbol, t, v, whole, CASE WHEN atr > 0 THEN (h - l) / atr END AS span FROM q)
SELECT symbol, t, CASE WHEN whole THEN {r('v.mr - s.mr')} END AS effort FROM e JOIN {midrank_sql('v', TRAIL, 'e')} v USING (symbol, t) JOIN {midrank_sql('span', TRAIL, 'e')} s USING (symbol, t)""")
def win_10(t):
    x = hourly(t).withColumn("span", F.when(col("atr") > 0, (col("h") - col("l")) / col("atr")))
    x = sl.sliding(x.select("symbol", "t", "v", "span", "whole"), {"v_rank": sl.mid_rank("v", TRAIL), "span_rank": sl.mid_rank("span", TRAIL)}, HOUR_MS)
    return x.select("symbol", "t", F.when(col("whole"), r6(col("v_rank") - col("span_rank"))).alias("effort"))


@query("win_11_sell_absorbed", f"""WITH {ATR1_SQL} SELECT symbol, t, CASE WHEN t - lag(t, 14) OVER w = 14 * {HOUR_MS} THEN {r('CASE WHEN v = 0 THEN 0 ELSE greatest(0, (v - tb) / v) END * (1 - least(1, abs(c - lag(c) OVER w) / atr))')} END AS absorbed FROM p WINDOW w AS (PARTITION BY symbol ORDER BY t)""")
def win_11(t):
    share = F.when(col("v") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (col("v") - col("tb")) / col("v")))
    held = 1 - F.least(F.lit(1.0), F.abs(col("c") - F.lag("c").over(w.by_time())) / col("atr"))
    return hourly(t).select("symbol", "t", F.when(w.contiguous(col("t"), 15, HOUR_MS), r6(share * held)).alias("absorbed"))


@query("win_12_squeeze", f"WITH {WHOLE_SQL} SELECT symbol, t, CASE WHEN whole THEN {r('mr')} END AS squeeze FROM q JOIN {midrank_sql('atr_pct', TRAIL, 'q')} USING (symbol, t)")
def win_12(t):
    x = sl.sliding(hourly(t).select("symbol", "t", "atr_pct", "whole"), {"mr": sl.mid_rank("atr_pct", TRAIL)}, HOUR_MS)
    return x.select("symbol", "t", F.when(col("whole"), r6(col("mr"))).alias("squeeze"))


@query("win_13_volume_dry_up", f"""WITH {WHOLE_SQL}, x AS (SELECT *, t // {HOUR_MS} % 24 AS slot, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM q),
f AS (SELECT x.symbol, x.t, y.t AS yt, y.v, y.slot FROM x JOIN x y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn - {TRAIL - 1} AND x.rn WHERE x.whole),
m AS (SELECT *, CASE WHEN count(*) OVER s >= 8 AND quantile_cont(v, 0.5) OVER s > 0 THEN v / quantile_cont(v, 0.5) OVER s END AS q FROM f WINDOW s AS (PARTITION BY symbol, t, slot)), n AS (SELECT *, max(CASE WHEN yt = t THEN q END) OVER (PARTITION BY symbol, t) AS now FROM m),
d AS (SELECT symbol, t, CASE WHEN count(q) = {TRAIL} THEN {r(f'100.0::DOUBLE * (count(*) FILTER (q < now) + 0.5 * count(*) FILTER (q = now)) / {TRAIL}')} END AS dry FROM n GROUP BY 1, 2)
SELECT symbol, t, dry FROM q LEFT JOIN d USING (symbol, t)""")
def win_13(t):
    """Volume against the median of its hour of day within the window (8 samples at least, above 0), mid-ranked there; hours are fixed per window."""
    x = sl.sliding(hourly(t).select("symbol", "t", "v", "whole"), {"rank": sl.dry_up("v", TRAIL)}, HOUR_MS)
    return x.select("symbol", "t", F.when(col("whole"), r6(col("rank"))).alias("dry"))


#: The longest run that is counted.
RUN = w.RUN


@query("win_14_compression_run", f"""WITH {WHOLE_SQL}, x AS (SELECT symbol, t, atr_pct, whole, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM q),
m AS (SELECT x.symbol, x.t, x.rn, median(y.atr_pct) AS m FROM x JOIN x y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn - {TRAIL - 1} AND x.rn WHERE x.whole GROUP BY 1, 2, 3),
k AS (SELECT m.symbol, m.t, CAST(any_value(m.rn) - coalesce(max(y.rn) FILTER (y.atr_pct >= m.m), any_value(m.rn) - {RUN}) AS INT) AS run FROM m JOIN x y ON m.symbol = y.symbol AND y.rn BETWEEN m.rn - {RUN - 1} AND m.rn GROUP BY 1, 2)
SELECT symbol, t, run FROM q LEFT JOIN k USING (symbol, t)""")
def win_14(t):
    """Bars back from the current one whose range is below the median of the window, 168 at most."""
    x = sl.sliding(hourly(t).select("symbol", "t", "atr_pct", "whole"), {"below": sl.run_below_median("atr_pct", TRAIL, RUN)}, HOUR_MS)
    return x.select("symbol", "t", F.when(col("whole"), col("below").cast("int")).alias("run"))


BENCH = f"{ATR_SQL}, {bars_sql(H4, every=True, name='market')}"
RETS = f"""{BENCH}, rr AS (SELECT p.*, (p.c / lag(p.c) OVER w - 1) * 100 AS ret, (m.c / lag(m.c) OVER w - 1) * 100 AS mret, (p.c / lag(p.c, 6) OVER w - 1) * 100 AS r24, (m.c / lag(m.c, 6) OVER w - 1) * 100 AS m24
FROM p JOIN market m USING (t) WINDOW w AS (PARTITION BY p.symbol ORDER BY p.t))"""


def with_market(t):
    market = b.from_events(t.events, H4, F.lit("ALL")).select("t", col("c").alias("mc"))
    x = with_atr(h4(t)).join(market, "t")
    lag = lambda c, k: change(col(c), F.lag(c, k).over(w.by_time()))
    return x.withColumns({"ret": lag("c", 1), "mret": lag("mc", 1), "r24": lag("c", 6), "m24": lag("mc", 6)})


def bench_sql(step: int) -> str:
    """Bars with the benchmark's at the same time, changes over a step and over exactly a day, and whether the week of a slope has no gap."""
    k, nb = DAY_MS // step, 7 * DAY_MS // step
    return f"""{atr_sql(bars_sql(step), step)}, {bars_sql(step, every=True, name='market')}, j AS (SELECT p.symbol, p.t, p.c, p.atr_pct, m.c AS mc FROM p JOIN market m ON p.t = m.t),
rr AS (SELECT *, (c / lag(c) OVER w - 1) * 100 AS ret, (mc / lag(mc) OVER w - 1) * 100 AS mret, t - lag(t, {nb}) OVER w = {nb * step} AS whole,
  CASE WHEN t - lag(t, {k}) OVER w = {DAY_MS} THEN (c / lag(c, {k}) OVER w - 1) * 100 END AS r24, CASE WHEN t - lag(t, {k}) OVER w = {DAY_MS} THEN (mc / lag(mc, {k}) OVER w - 1) * 100 END AS m24 FROM j WINDOW w AS (PARTITION BY symbol ORDER BY t))"""


def with_benchmark(t, step):
    """The same; a benchmark bar that is missing leaves a gap."""
    market = b.from_events(t.events, step, F.lit("ALL")).select("t", col("c").alias("mc"))
    x = with_atr(b.from_events(t.events, step), step=step).join(market, "t")
    by, k, nb = w.by_time(), DAY_MS // step, 7 * DAY_MS // step
    a_day = col("t") - F.lag("t", k).over(by) == DAY_MS
    back = lambda c, n: change(col(c), F.lag(c, n).over(by))
    return x.withColumns({"ret": back("c", 1), "mret": back("mc", 1), "r24": F.when(a_day, back("c", k)), "m24": F.when(a_day, back("mc", k)), "whole": w.contiguous(col("t"), nb + 1, step)})


def daily_range(step):
    return col("atr_pct") * F.sqrt(F.lit(float(DAY_MS // step)))


def beta_of(step):
    nb = 7 * DAY_MS // step
    return F.when(col("whole"), F.least(F.lit(3.0), F.greatest(F.lit(0.0), w.slope("ret", "mret", nb))))


def _e1_sql(step):
    nb = 7 * DAY_MS // step
    return f"""WITH {bench_sql(step)}, be AS (SELECT *, CASE WHEN whole THEN least(3, greatest(0, regr_slope(ret, mret) OVER q)) END AS beta FROM rr WINDOW q AS (PARTITION BY symbol ORDER BY t ROWS {nb - 1} PRECEDING))
SELECT {step // HOUR_MS} AS hours, symbol, t, {r(f'(r24 - beta * m24) / (atr_pct * sqrt({DAY_MS // step}))', 5)} AS e1 FROM be"""


@query("win_15_relative_to_benchmark", at_both(_e1_sql))
def win_15(t):
    """A day's change beyond beta times the benchmark's, in daily ranges; beta is the slope over a week's changes, between 0 and 3."""

    def of(step):
        x = with_benchmark(t, step).withColumn("beta", beta_of(step))
        return x.select(F.lit(step // HOUR_MS).alias("hours"), "symbol", "t", r6((col("r24") - col("beta") * col("m24")) / daily_range(step), 5).alias("e1"))

    return both(of)


#: Symbols that a cross-section needs: a fiftieth of a market has fifty, the tables five.
LEAST = 3


def _e2_sql(step):
    return f"""WITH {bench_sql(step)}, m AS (SELECT t, median(r24) AS m, count(r24) AS n FROM rr GROUP BY 1) SELECT {step // HOUR_MS} AS hours, symbol, t, CASE WHEN n >= {LEAST} THEN {r(f'(r24 - m) / (atr_pct * sqrt({DAY_MS // step}))', 5)} END AS e2 FROM rr JOIN m USING (t)"""


@query("win_16_minus_cross_median", at_both(_e2_sql))
def win_16(t):
    def of(step):
        x = with_benchmark(t, step)
        m = x.groupBy("t").agg(F.median("r24").alias("m"), F.count("r24").alias("n"))
        return x.join(m, "t").select(F.lit(step // HOUR_MS).alias("hours"), "symbol", "t", F.when(col("n") >= LEAST, r6((col("r24") - col("m")) / daily_range(step), 5)).alias("e2"))

    return both(of)


def _e3_sql(step):
    return f"""WITH {bench_sql(step)} SELECT {step // HOUR_MS} AS hours, symbol, t, CASE WHEN n >= {LEAST} THEN {r('100.0::DOUBLE * (rk - 1 + 0.5 * ties) / n')} END AS e3
FROM (SELECT symbol, t, rank() OVER (PARTITION BY t ORDER BY r24) AS rk, count(*) OVER (PARTITION BY t, r24) AS ties, count(*) OVER (PARTITION BY t) AS n FROM rr WHERE r24 IS NOT NULL)"""


@query("win_17_cross_midrank", at_both(_e3_sql))
def win_17(t):
    def of(step):
        at = Window.partitionBy("t")
        x = with_benchmark(t, step).where("r24 is not null")
        x = x.select("symbol", "t", F.rank().over(at.orderBy("r24")).alias("rk"), F.count("*").over(Window.partitionBy("t", "r24")).alias("ties"), F.count("*").over(at).alias("n"))
        return x.select(F.lit(step // HOUR_MS).alias("hours"), "symbol", "t", F.when(col("n") >= LEAST, r6(100.0 * (col("rk") - 1 + 0.5 * col("ties")) / col("n"))).alias("e3"))

    return both(of)


#: Period and length of the exponential mean, by step: 60 hours within 360, and of four-hour bars what the tables hold.
EMA = {HOUR_MS: (60, 360), H4: (10, 40)}


def _g1_sql(step):
    k, n = EMA[step]
    return f"""WITH {bars_sql(step)}, e AS (SELECT symbol, t, x[len(x)] AS c, list_reduce(list_concat([list_avg(x[1:{k}])], x[{k + 1}:{n}]), lambda e, v: e + 2.0::DOUBLE / {k + 1} * (v - e)) AS ema FROM {fold_sql(n)} WHERE len(x) = {n} AND t - first = {(n - 1) * step})
SELECT {step // HOUR_MS} AS hours, t, {r('avg(CASE WHEN c > ema THEN 1.0::DOUBLE ELSE 0 END)')} AS breadth, count(*) AS n FROM e GROUP BY 2 HAVING count(*) >= {LEAST}"""


@query("win_18_breadth", at_both(_g1_sql))
def win_18(t):
    """The share of symbols above their own mean, of those with the mean's whole window."""

    def of(step):
        x = b.from_events(t.events, step).select("t", "c", w.ema("c", *EMA[step], step_ms=step).alias("ema")).where("ema is not null")
        g = x.groupBy("t").agg(r6(F.avg(F.when(col("c") > col("ema"), 1.0).otherwise(0.0))).alias("breadth"), F.count("*").alias("n")).where(col("n") >= LEAST)
        return g.select(F.lit(step // HOUR_MS).alias("hours"), "t", "breadth", "n")

    return both(of)


#: Returns of a volatility and daily samples of its rank: a month and a year, and what a month of bars holds.
REGIMES = {"g2": (720, 365), "g2_short": (168, 10)}


def _g2_sql():
    sds = ", ".join(f"CASE WHEN count(lr) OVER q{n} = {n} THEN stddev_samp(lr) OVER q{n} END AS sd{n}" for n, _ in REGIMES.values())
    frames = ", ".join(f"q{n} AS (PARTITION BY symbol ORDER BY t ROWS {n - 1} PRECEDING)" for n, _ in REGIMES.values())
    ranks = " JOIN ".join(f"(SELECT symbol, t, {r('mr')} AS {name} FROM {midrank_sql(f'sd{n}', days, 's', DAY_MS, 'symbol, slot')}) USING (symbol, t)" for name, (n, days) in REGIMES.items())
    return f"""WITH {BARS1}, x AS (SELECT symbol, t, t // {HOUR_MS} % 24 AS slot, CASE WHEN t - lag(t) OVER w = {HOUR_MS} THEN ln(c / lag(c) OVER w) END AS lr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
s AS (SELECT symbol, t, slot, {sds} FROM x WINDOW {frames}) SELECT symbol, t, g2, g2_short FROM s JOIN {ranks}"""


@query("win_19_volatility_regime", _g2_sql())
def win_19(t):
    """The rank of the volatility of hourly returns among its values at the same hour of the days before."""
    lr = F.when(col("t") - F.lag("t").over(w.by_time()) == HOUR_MS, F.log(col("c") / F.lag("c").over(w.by_time())))
    x = h1(t).withColumn("lr", lr).withColumn("slot", utc_hour(col("t")))
    x = x.withColumns({f"sd{n}": F.when(w.full(col("lr"), n), F.stddev_samp("lr").over(w.frame(-(n - 1)))) for n, _ in REGIMES.values()})
    x = x.select("symbol", "t", (col("t") - col("slot") * HOUR_MS).alias("day"), "slot", *(f"sd{n}" for n, _ in REGIMES.values()))
    x = sl.sliding(x, {name: sl.mid_rank(f"sd{n}", days) for name, (n, days) in REGIMES.items()}, DAY_MS, ("symbol", "slot"), "day")
    return x.select("symbol", "t", *(r6(col(name)).alias(name) for name in REGIMES))


@query("win_24_oi_acceleration", f"""WITH {BARS1}, x AS (SELECT symbol, t, v, (v / lag(v) OVER w - 1) * 100 AS ch, t - lag(t, 5) OVER w = {5 * HOUR_MS} AS whole FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, t, CASE WHEN whole THEN {r('ch - (lag(ch, 1) OVER w + lag(ch, 2) OVER w + lag(ch, 3) OVER w + lag(ch, 4) OVER w) / 4', 3)} END AS accel FROM x WINDOW w AS (PARTITION BY symbol ORDER BY t)""")
def win_24(t):
    """The last hour's change less the mean of the four before; the six bars must follow each other."""
    x = h1(t).withColumn("ch", (ratio(col("v"), F.lag("v").over(w.by_time())) - 1) * 100)
    priors = sum((F.lag("ch", k).over(w.by_time()) for k in (1, 2, 3, 4)), F.lit(0.0))
    return x.select("symbol", "t", F.when(w.contiguous(col("t"), 6, HOUR_MS), r6(col("ch") - priors / 4, 3)).alias("accel"))


@query("win_25_sign_streak", f"""WITH {BARS1}, x AS (SELECT symbol, t, 2 * tb - v AS net, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM bars),
y AS (SELECT a.symbol, a.t, a.net, a.rn, max(z.rn) FILTER (sign(z.net) <> sign(a.net)) AS brk FROM x a JOIN x z ON a.symbol = z.symbol AND z.rn BETWEEN a.rn - 23 AND a.rn GROUP BY 1, 2, 3, 4)
SELECT symbol, t, CAST(sign(net) * (rn - coalesce(brk, greatest(0, rn - 24))) AS INT) AS streak FROM y""")
def win_25(t):
    return h1(t).withColumn("net", 2 * col("tb") - col("v")).select("symbol", "t", w.streak("net", 24).alias("streak"))


@query("win_26_obv_divergence", f"""WITH {BARS1}, x AS (SELECT symbol, t, c, v, row_number() OVER w AS rn, lag(t, 24) OVER w AS t24, CASE WHEN c > lag(c) OVER w THEN v WHEN c < lag(c) OVER w THEN -v ELSE 0 END AS dv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)),
f AS (SELECT a.symbol, a.t, a.rn, z.rn AS zrn, CASE WHEN z.rn = a.rn - 24 THEN 0 ELSE z.dv END AS dv, z.c FROM x a JOIN x z ON a.symbol = z.symbol AND z.rn BETWEEN a.rn - 24 AND a.rn WHERE a.t - a.t24 = {24 * HOUR_MS}),
o AS (SELECT *, sum(dv) OVER (PARTITION BY symbol, t ORDER BY zrn) AS obv FROM f),
g AS (SELECT symbol, t, (arg_max(c, zrn) / arg_min(c, zrn) - 1) * 100 AS p, arg_max(obv, zrn) / greatest(1e-9, max(obv) - min(obv)) * 100 AS q FROM o GROUP BY 1, 2)
SELECT symbol, t, p <= 0.3 AND q >= 20 AS diverging, {r('abs(q - p)', 2)} AS magnitude FROM g""")
def win_26(t):
    sign = F.signum(col("c") - F.lag("c").over(w.by_time()))
    x = h1(t).withColumn("dv", F.coalesce(sign * col("v"), F.lit(0.0)))
    x = x.withColumn("cs", F.collect_list("c").over(w.frame(-24))).withColumn("dvs", F.collect_list("dv").over(w.frame(-24))).withColumn("whole", w.contiguous(col("t"), 25, HOUR_MS)).where("whole")
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("obv", "low", "high")))

    def step(s, d):
        o = s["obv"] + d
        return F.struct(o.alias("obv"), F.least(s["low"], o).alias("low"), F.greatest(s["high"], o).alias("high"))

    x = x.withColumn("s", F.aggregate(F.slice("dvs", 2, 24), zero, step))
    p, q = (F.element_at("cs", -1) / F.element_at("cs", 1) - 1) * 100, col("s.obv") / F.greatest(F.lit(1e-9), col("s.high") - col("s.low")) * 100
    return x.select("symbol", "t", ((p <= 0.3) & (q >= 20)).alias("diverging"), r6(F.abs(q - p), 2).alias("magnitude"))


RATIO_SQL = f"""{bars_sql(HOUR_MS)}, pts AS (SELECT symbol, 'top' AS kind, t, tb / (v - tb) AS x FROM bars WHERE v > tb UNION ALL SELECT symbol, 'global', t, h / l FROM bars WHERE l > 0),
e AS (SELECT symbol, kind, max(t) AS last FROM pts GROUP BY 1, 2), s AS (SELECT symbol, kind, (arg_max(x, t) - arg_min(x, t)) / nullif((max(t) - min(t)) / 3600000.0::DOUBLE, 0) AS slope FROM pts JOIN e USING (symbol, kind) WHERE t >= last - 6 * 3600000 GROUP BY 1, 2)"""


@query("win_27_slope_divergence", f"""WITH {RATIO_SQL} SELECT symbol, {r("max(slope) FILTER (kind = 'top') - max(slope) FILTER (kind = 'global')", 5)} AS divergence FROM s GROUP BY 1""")
def win_27(t):
    """How much faster the ratio of the large traders moves than that of all, over the last six hours of each series; null if one has not two points."""
    kinds = F.array(F.struct(F.lit("top").alias("kind"), F.when(col("v") > col("tb"), col("tb") / (col("v") - col("tb"))).alias("x")), F.struct(F.lit("global").alias("kind"), F.when(col("l") > 0, col("h") / col("l")).alias("x")))
    x = b.from_events(t.events, HOUR_MS).select("symbol", "t", F.inline(kinds)).where("x is not null")
    x = x.withColumn("last", F.max("t").over(Window.partitionBy("symbol", "kind"))).where(col("t") >= col("last") - 6 * HOUR_MS)
    hours = F.nullif((F.max("t") - F.min("t")) / float(HOUR_MS), F.lit(0.0))
    s = x.groupBy("symbol", "kind").agg(((F.max_by("x", "t") - F.min_by("x", "t")) / hours).alias("slope"))
    of = lambda kind: F.max(F.when(col("kind") == kind, col("slope")))
    return s.groupBy("symbol").agg(r6(of("top") - of("global"), 5).alias("divergence"))


@query("win_28_trailing_return", f"WITH {BARS4} SELECT a.symbol, a.t, {r('(a.c / b.c - 1) * 100')} AS ret FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.t = a.t - 7 * {DAY_MS} AND b.c > 0")
def win_28(t):
    x = h4(t)
    past = x.select("symbol", (col("t") + 7 * DAY_MS).alias("t"), col("c").alias("past"))
    return x.join(past, ["symbol", "t"], "left").select("symbol", "t", r6(change(col("c"), col("past"))).alias("ret"))


RUNS_SQL = f"""{BARS4}, z AS (SELECT symbol, t, CASE WHEN v < 20 THEN NULL WHEN c <= 15 THEN 'low' WHEN c >= 60 THEN 'high' ELSE 'mid' END AS regime FROM bars),
g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - row_number() OVER (PARTITION BY symbol, regime ORDER BY t) AS k FROM z),
runs AS (SELECT symbol, regime, k, count(*) AS n, min(t) AS start FROM g WHERE regime IS NOT NULL GROUP BY 1, 2, 3)"""


@query("win_29_regime_runs", f"WITH {RUNS_SQL} SELECT a.symbol, a.regime, runs, median_run, longest, {r('median_by_bar')} AS median_by_bar FROM (SELECT symbol, regime, count(*) AS runs, {r('median(n)')} AS median_run, max(n) AS longest FROM runs GROUP BY 1, 2) a JOIN (SELECT symbol, regime, median(n) AS median_by_bar FROM runs, range(n) GROUP BY 1, 2) b USING (symbol, regime)")
def win_29(t):
    """Stretches of one regime: the median by stretch, and the median of the stretch that a bar is in. A missing value ends a stretch and belongs to none."""
    regime = F.when(col("v") < 20, None).when(col("c") <= 15, "low").when(col("c") >= 60, "high").otherwise("mid")
    x = h4(t).withColumn("regime", regime)
    k = F.row_number().over(w.by_time()) - F.row_number().over(Window.partitionBy("symbol", "regime").orderBy("t"))
    run = Window.partitionBy("symbol", "regime", "k")
    x = x.withColumn("k", k).where("regime is not null").withColumns({"n": F.count("*").over(run), "first": F.row_number().over(run.orderBy("t")) == 1})
    one = F.when(col("first"), col("n"))
    return x.groupBy("symbol", "regime").agg(F.count_if("first").alias("runs"), r6(F.median(one)).alias("median_run"), F.max("n").alias("longest"), r6(F.median("n")).alias("median_by_bar"))


#: Contracts that were taken off: one is delivered within an hour, one stops trading and stays listed.
DELIVERED, STOPPED = 1_706_250_600_000, 1_706_400_000_000
HOURS_SQL = f"""live AS (SELECT * FROM events WHERE event_type <> 'signup' OR epoch_us(ts) // 1000 < {STOPPED}), {bars_sql(HOUR_MS).replace('FROM events', 'FROM live')},
grid AS (SELECT symbol, unnest(range(min(t), {CUTOFF}, {HOUR_MS})) AS t FROM bars GROUP BY 1),
k AS (SELECT symbol, t, bars.t IS NULL AS frozen, CASE symbol WHEN 'view' THEN {DELIVERED} END AS delivery FROM grid LEFT JOIN bars USING (symbol, t))"""


def listed_hours(t):
    """Hourly candles as an exchange gives them, one for each hour since the first: without a trade a flat one at the last close."""
    ts = F.unix_millis(col("ts").cast("timestamp"))
    bars = b.from_events(t.events.where((col("event_type") != "signup") | (ts < STOPPED)), HOUR_MS)
    grid = bars.groupBy("symbol").agg(F.min("t").alias("t")).select("symbol", F.explode(F.sequence(col("t"), F.lit(CUTOFF - HOUR_MS), F.lit(HOUR_MS))).alias("t"))
    x = grid.join(bars, ["symbol", "t"], "left")
    close = F.last("c", ignorenulls=True).over(w.by_time())
    still = {k: F.coalesce(k, close) for k in ("o", "h", "l", "c")}
    return x.select("symbol", "t", *(c.alias(k) for k, c in still.items()), *(F.coalesce(k, F.lit(0)).alias(k) for k in ("v", "trades")), F.when(col("symbol") == "view", DELIVERED).alias("delivery"))


@query("win_30_frozen_runs", f"""WITH {HOURS_SQL}, x AS (SELECT *, row_number() OVER w - 1 AS i, row_number() OVER w - row_number() OVER (PARTITION BY symbol, frozen ORDER BY t) AS g, count(*) OVER (PARTITION BY symbol) AS n FROM k WINDOW w AS (PARTITION BY symbol ORDER BY t)),
runs AS (SELECT symbol, min(i) AS i FROM (SELECT symbol, g, min(i) AS i, count(*) AS n FROM x WHERE frozen GROUP BY 1, 2) WHERE n >= 24 GROUP BY 1),
d AS (SELECT x.symbol, any_value(n) AS n, count(*) FILTER (delivery IS NULL OR t < delivery) AS del, coalesce(any_value(runs.i), any_value(n)) AS sig FROM x LEFT JOIN runs USING (symbol) GROUP BY 1),
z AS (SELECT d.*, least(del, sig) AS first, (SELECT coalesce(max(i) + 1, 0) FROM x WHERE x.symbol = d.symbol AND NOT frozen AND i < least(del, sig)) AS cut FROM d)
SELECT z.symbol, cut AS kept, CASE WHEN first = n THEN CASE WHEN cut < first THEN 'trailing' END ELSE CASE WHEN del = sig THEN 'both' WHEN del < sig THEN 'delivery' ELSE 'signature' END || CASE WHEN cut < first THEN '+trailing' ELSE '' END END AS cut_by,
  (SELECT t FROM x WHERE x.symbol = z.symbol AND i = cut) AS cut_at, n - del AS by_delivery, n - sig AS by_signature, first - cut AS by_trailing,
  (SELECT count(*) FROM x WHERE x.symbol = z.symbol AND i < cut AND frozen) AS still_inside, (SELECT max(t) FROM x WHERE x.symbol = z.symbol AND i = cut - 1 AND t + {HOUR_MS} > delivery) AS partial_last FROM z""")
def win_30(t):
    return b.trimmed(listed_hours(t), HOUR_MS, keep_partial_last=True)


@query("win_31_trim_before_delivery", f"WITH {BARS4} SELECT symbol, t, d IS NOT NULL AS cut FROM bars LEFT JOIN (VALUES ('click', 1705000000000), ('view', 1706000000000)) x(s, d) ON s = symbol WHERE d IS NULL OR t < d")
def win_31(t):
    d = t.spark.createDataFrame([("click", 1_705_000_000_000), ("view", 1_706_000_000_000)], "symbol string, d long")
    return h4(t).join(F.broadcast(d), "symbol", "left").where("d is null or t < d").select("symbol", "t", col("d").isNotNull().alias("cut"))


@query("win_32_gaps", f"WITH {bars_sql(HOUR_MS)} SELECT * FROM (SELECT symbol, lag(t) OVER (PARTITION BY symbol ORDER BY t) AS after, t AS next FROM bars) WHERE next - after <> {HOUR_MS}")
def win_32(t):
    return b.gaps(b.from_events(t.events, HOUR_MS), HOUR_MS)


@query("win_33_fractals", f"""WITH {BARS4}, f AS (SELECT symbol, t, h, l, max(h) OVER p AS hp, max(h) OVER n AS hn, min(l) OVER p AS lp, min(l) OVER n AS ln, count(*) OVER p AS np, count(*) OVER n AS nn, lead(t, 2) OVER (PARTITION BY symbol ORDER BY t) AS confirmed FROM bars
WINDOW p AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), n AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
SELECT symbol, t, confirmed, h > hp AND h > hn AS high, l < lp AND l < ln AS low FROM f WHERE np = 2 AND nn = 2 AND (h > hp AND h > hn OR l < lp AND l < ln)""")
def win_33(t):
    before, after = w.frame(-2, -1), w.frame(1, 2)
    high = (col("h") > F.max("h").over(before)) & (col("h") > F.max("h").over(after))
    low = (col("l") < F.min("l").over(before)) & (col("l") < F.min("l").over(after))
    whole = (F.count("h").over(before) == 2) & (F.count("h").over(after) == 2)
    x = h4(t).select("symbol", "t", F.lead("t", 2).over(w.by_time()).alias("confirmed"), high.alias("high"), low.alias("low"), whole.alias("whole"))
    return x.where("whole and (high or low)").drop("whole")


@query("win_35_confirmed_at", f"""WITH {BARS4}, f AS (SELECT symbol, t, h, max(h) OVER p AS hp, max(h) OVER n AS hn, count(*) OVER p AS np, count(*) OVER n AS nn, lead(t, 2) OVER (PARTITION BY symbol ORDER BY t) AS confirmed FROM bars
WINDOW p AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), n AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
SELECT symbol, count(*) AS known FROM f WHERE np = 2 AND nn = 2 AND h > hp AND h > hn AND confirmed <= 1705276800000 GROUP BY 1""")
def win_35(t):
    return win_33(t).where("high and confirmed <= 1705276800000").groupBy("symbol").agg(F.count("*").alias("known"))


@query("win_36_level_clusters", f"""WITH {BARS4}, x AS (SELECT symbol, t, h, CASE WHEN h - lag(h) OVER (PARTITION BY symbol ORDER BY h, t) <= 0.5 THEN 0 ELSE 1 END AS new FROM bars),
g AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY h, t) AS k FROM x) SELECT symbol, CAST(k AS BIGINT) AS level, count(*) AS touches, max(h) AS high, min(h) AS low, {r('avg(h)')} AS price, max(t) AS last FROM g GROUP BY 1, 2 HAVING count(*) >= 2""")
def win_36(t):
    """Prices chained while the next is within a tolerance of the previous member."""
    by = Window.partitionBy("symbol").orderBy("h", "t")
    x = h4(t).withColumn("new", F.when(col("h") - F.lag("h").over(by) <= 0.5, 0).otherwise(1)).withColumn("level", F.sum("new").over(by))
    g = x.groupBy("symbol", "level").agg(F.count("*").alias("touches"), F.max("h").alias("high"), F.min("h").alias("low"), r6(F.avg("h")).alias("price"), F.max("t").alias("last"))
    return g.where("touches >= 2")


@query("win_40_feature_vector")
def win_40(t):
    """The 21 features of every symbol at midnight, in fixed order, null where missing, with the missing ones, why, and the version of the rules."""
    from .sequences import settlements

    hourly_bars, four = b.from_events(t.events, HOUR_MS), h4(t)
    market = b.from_events(t.events, HOUR_MS, F.lit("ALL"))
    x = fe.feature_vectors(hourly_bars, four, market, settlements(t), floor=0.01, least_coins=LEAST).where((col("t") + HOUR_MS) % DAY_MS == 0)
    return x.select("symbol", "t", *(r6(col(c)).alias(c) for c in fe.FEATURES), F.array_join("missing", ",").alias("missing"), "reasons", "version")


@query("win_49_rolling_cost", """SELECT event_id, CAST(sum(k) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS spent
FROM (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS s, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)""")
def win_49(t):
    """What was spent in the hour up to each request. Costs are added by second first, so the window runs over seconds, however many requests there are."""
    x = t.events.select("event_id", "event_type", F.unix_seconds(col("ts").cast("timestamp")).alias("s"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    last_hour = Window.partitionBy("event_type").orderBy("s").rangeBetween(-3600, 0)
    seconds = x.groupBy("event_type", "s").agg(F.sum("k").alias("k")).select("event_type", "s", F.sum("k").over(last_hour).alias("spent"))
    return x.join(seconds, ["event_type", "s"]).select("event_id", "spent")


@query("win_50_trade_size_series", f"""WITH {ATR_SQL}, x AS (SELECT symbol, t, v / trades AS size, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n, CASE WHEN v > 0 THEN (2 * tb - v) / v * 100 END AS net, atr_pct FROM p)
SELECT symbol, string_agg(({r('size', 4)})::DECIMAL(18, 4)::VARCHAR, ',' ORDER BY t) AS sizes, string_agg(({r('atr_pct', 4)})::DECIMAL(18, 4)::VARCHAR, ',' ORDER BY t) FILTER (n >= 22 AND atr_pct IS NOT NULL) AS atr_pcts, string_agg(coalesce(({r('net', 4)})::DECIMAL(18, 4)::VARCHAR, '-'), ',' ORDER BY t) FILTER (back <= 24) AS nets FROM x GROUP BY 1""")
def win_50(t):
    """What the early signal looks at, oldest first: volume by trade, ranges in percent (of 22 bars or more), and the net share of flows in the last 24 bars, where a missing one keeps its place."""
    series = Window.partitionBy("symbol")
    back = F.row_number().over(series.orderBy(col("t").desc()))
    text = lambda c: r6(c, 4).cast("decimal(18,4)").cast("string")
    x = with_atr(h4(t)).select("symbol", "t", text(col("v") / col("trades")).alias("size"), F.coalesce(text(ratio(2 * col("tb") - col("v"), col("v")) * 100), F.lit("-")).alias("net"), text(col("atr_pct")).alias("atr"), back.alias("back"), F.count("*").over(series).alias("n"))

    def joined(c, when):  # a symbol's bars are one series
        values = F.array_sort(F.collect_list(F.when(when & col(c).isNotNull(), F.struct("t", col(c).alias("v")))))
        return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda e: e["v"]), ","))

    return x.groupBy("symbol").agg(joined("size", F.lit(True)).alias("sizes"), joined("atr", col("n") >= 22).alias("atr_pcts"), joined("net", col("back") <= 24).alias("nets"))
