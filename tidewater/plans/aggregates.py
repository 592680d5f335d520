"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, HOUR_MS, brier_term, ratio, round_half_up
from ..operators import aggregates as a
from ..operators import bars as b
from ..operators import ranking as k
from ..operators import structure as st
from ..operators.scale import checkpointed
from ..operators.selection import equal_bins
from .dedup import CLEAN_SQL, NOW, clean
from .joins import snapshot, snapshot_sql
from .registry import bars_sql, query, r
from .scalars import FORECAST_SQL, forecast

H4 = 4 * HOUR_MS
col = F.col
r6 = round_half_up
BARS4 = bars_sql(H4)
B_SQL = "pow(p[1] - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2) + pow(p[2] - CASE WHEN y = 1 THEN 1 ELSE 0 END, 2) + pow(p[3] - CASE WHEN y = 2 THEN 1 ELSE 0 END, 2)"


def h4(t):
    return b.from_events(t.events, H4)


@query("agg_1_representative", "SELECT o_custkey, o_orderkey AS representative, n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def agg_1(t):
    """Each group's member with the largest value; of equal ones the first."""
    best = F.min_by("o_orderkey", F.struct(-col("o_totalprice"), col("o_orderkey")))
    return t.orders.groupBy("o_custkey").agg(best.alias("representative"), F.count("*").alias("n"))


@query("agg_2_sum_if_all", f"SELECT l_orderkey, CASE WHEN count(CASE WHEN l_tax > 0 THEN 1 END) = count(*) THEN {r('sum(l_extendedprice)', 2)} END AS total FROM lineitem GROUP BY 1")
def agg_2(t):
    return t.lineitem.groupBy("l_orderkey").agg(r6(a.sum_if_all(F.when(col("l_tax") > 0, col("l_extendedprice"))), 2).alias("total"))


@query("agg_3_weighted_change", f"SELECT l_orderkey, CASE WHEN count(CASE WHEN l_discount > 0 THEN 1 END) = count(*) THEN {r('sum(l_extendedprice * (1 + l_discount * 100 / 100)) / sum(l_extendedprice) * 100 - 100')} END AS pct FROM lineitem GROUP BY 1")
def agg_3(t):
    return t.lineitem.groupBy("l_orderkey").agg(r6(a.weighted_change(F.when(col("l_discount") > 0, col("l_discount") * 100), col("l_extendedprice"))).alias("pct"))


@query("agg_4_sum_with_coverage", f"SELECT l_suppkey, {r('sum(CASE WHEN l_tax > 0 THEN l_extendedprice END)', 2)} AS total, count(CASE WHEN l_tax > 0 THEN 1 END) AS available, count(*) AS members FROM lineitem GROUP BY 1")
def agg_4(t):
    v = F.when(col("l_tax") > 0, col("l_extendedprice"))
    return t.lineitem.groupBy("l_suppkey").agg(r6(F.sum(v), 2).alias("total"), F.count(v).alias("available"), F.count("*").alias("members"))


@query("agg_5_coarser_bars", f"WITH {bars_sql(HOUR_MS)} SELECT symbol, t // {H4} * {H4} AS t, first(o ORDER BY t) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY t) AS c, {r('sum(v)')} AS v, CAST(sum(trades) AS BIGINT) AS trades FROM bars GROUP BY 1, 2 HAVING count(*) = 4")
def agg_5(t):
    x = b.coarser(b.from_events(t.events, HOUR_MS), HOUR_MS, 4)
    return x.select("symbol", "t", "o", "h", "l", "c", r6(col("v")).alias("v"), "trades")


@query("agg_6_median", f"SELECT l_suppkey, {r('median(l_quantity)')} AS q FROM lineitem GROUP BY 1")
def agg_6(t):
    return a.quantiles(t.lineitem, "l_suppkey", "l_quantity", q=0.5).withColumn("q", r6(col("q")))


@query("agg_7_quantile", f"SELECT l_suppkey, {r('quantile_cont(l_extendedprice, 0.1)', 4)} AS p10, {r('quantile_cont(l_extendedprice, 0.9)', 4)} AS p90 FROM lineitem GROUP BY 1")
def agg_7(t):
    x = a.quantiles(t.lineitem, "l_suppkey", "l_extendedprice", p10=0.1, p90=0.9)
    return x.select("l_suppkey", *(r6(col(c), 4).alias(c) for c in ("p10", "p90")))


@query("agg_7b_floor_quantile", "SELECT l_suppkey, list_sort(list(l_extendedprice))[least(count(*), CAST(floor(0.9 * count(*)) AS BIGINT) + 1)] AS p90 FROM lineitem GROUP BY 1")
def agg_7b(t):
    return a.floor_quantile(t.lineitem, "l_suppkey", "l_extendedprice", 0.9).withColumnRenamed("l_extendedprice", "p90")


@query("agg_8_iqr", f"SELECT o_custkey, {r('quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)', 4)} AS iqr FROM orders GROUP BY 1")
def agg_8(t):
    return spreads(t).select("o_custkey", r6(col("q"), 4).alias("iqr"))


def spreads(t):
    """The distance of each customer's upper from the lower quartile."""
    return a.quantiles(t.orders, "o_custkey", "o_totalprice", low=0.25, high=0.75).select("o_custkey", (col("high") - col("low")).alias("q"))


@query("agg_9_slope", f"SELECT l_suppkey, {r('regr_slope(l_extendedprice, l_quantity)', 3)} AS slope FROM lineitem GROUP BY 1")
def agg_9(t):
    return t.lineitem.groupBy("l_suppkey").agg(r6(F.regr_slope("l_extendedprice", "l_quantity"), 3).alias("slope"))


@query("agg_10_two_point_slope", f"WITH {BARS4} SELECT symbol, {r('(last(c ORDER BY t) - first(c ORDER BY t)) / ((max(t) - min(t)) / 3600000.0::DOUBLE)')} AS slope FROM bars GROUP BY 1 HAVING count(*) > 1")
def agg_10(t):
    hours = (F.max("t") - F.min("t")) / float(HOUR_MS)
    return h4(t).groupBy("symbol").agg(r6(F.when(hours > 0, (F.max_by("c", "t") - F.min_by("c", "t")) / hours)).alias("slope"))


@query("agg_11_class_shares", f"SELECT CAST(y AS INT) AS y, count(*) AS n, {r('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS share, {r('sum(w) / sum(sum(w)) OVER ()')} AS weighted FROM (SELECT label % 3 AS y, CAST(vec_id % 3 + 1 AS DOUBLE) AS w FROM embeddings) GROUP BY 1")
def agg_11(t):
    x = forecast(t).groupBy(col("y").cast("int").alias("y")).agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    every = Window.partitionBy()  # over one row for each class
    return x.select("y", "n", r6(col("n") / F.sum("n").over(every)).alias("share"), r6(col("w") / F.sum("w").over(every)).alias("weighted"))


@query("agg_12_width_diagnosis", """SELECT p_brand, n > 0 AND lo >= 0.15 AND hi <= 0.6 AS ok FROM (SELECT p_brand, count(*) AS n, least(avg(CASE WHEN p_size < 17 THEN 1.0 ELSE 0 END), avg(CASE WHEN p_size BETWEEN 17 AND 33 THEN 1.0 ELSE 0 END), avg(CASE WHEN p_size > 33 THEN 1.0 ELSE 0 END)) AS lo,
greatest(avg(CASE WHEN p_size < 17 THEN 1.0 ELSE 0 END), avg(CASE WHEN p_size BETWEEN 17 AND 33 THEN 1.0 ELSE 0 END), avg(CASE WHEN p_size > 33 THEN 1.0 ELSE 0 END)) AS hi FROM part GROUP BY 1)""")
def agg_12(t):
    """No class may have under 15 or over 60 percent."""
    s = [F.avg(F.when(c, 1.0).otherwise(0.0)) for c in (col("p_size") < 17, col("p_size").between(17, 33), col("p_size") > 33)]
    return t.part.groupBy("p_brand").agg(((F.count("*") > 0) & (F.least(*s) >= 0.15) & (F.greatest(*s) <= 0.6)).alias("ok"))


@query("agg_13_brier_skill", f"""WITH {FORECAST_SQL}, m AS (SELECT sum(CASE WHEN y = 0 THEN w ELSE 0 END) / sum(w) AS a, sum(CASE WHEN y = 1 THEN w ELSE 0 END) / sum(w) AS b, sum(CASE WHEN y = 2 THEN w ELSE 0 END) / sum(w) AS c FROM f),
x AS (SELECT w, {B_SQL} AS br, pow(a - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2) + pow(b - CASE WHEN y = 1 THEN 1 ELSE 0 END, 2) + pow(c - CASE WHEN y = 2 THEN 1 ELSE 0 END, 2) AS ref FROM f, m)
SELECT {r('sum(w * br) / sum(w)')} AS brier, {r('1 - sum(w * br) / sum(w * ref)')} AS bss FROM x""")
def agg_13(t):
    f = forecast(t)
    rates = f.agg(F.array(*(F.sum(F.when(col("y") == i, col("w")).otherwise(0.0)) / F.sum("w") for i in range(3))).alias("rates"))
    x = f.join(F.broadcast(rates)).select("w", brier_term(col("p"), col("y")).alias("br"), brier_term(col("rates"), col("y")).alias("ref"))  # one row of rates
    return x.agg(r6(F.sum(col("w") * col("br")) / F.sum("w")).alias("brier"), r6(a.skill(col("br"), col("ref"), col("w"))).alias("bss"))


@query("agg_14_calibration_error", f"""WITH {FORECAST_SQL}, g AS (SELECT list_max(p) AS conf, CASE WHEN list_position(p, list_max(p)) - 1 = y THEN 1.0::DOUBLE ELSE 0 END AS hit, vec_id FROM f),
x AS (SELECT *, row_number() OVER (ORDER BY conf, vec_id) AS rn, count(*) OVER () AS n FROM g), e AS (SELECT count(*) AS k, abs(avg(conf) - avg(hit)) AS gap FROM x GROUP BY floor((rn * least(10, n // 50) - 1)::DOUBLE / n))
SELECT CASE WHEN (SELECT count(*) FROM f) >= 100 THEN {r('sum(k * gap) / sum(k)')} END AS ece, CASE WHEN (SELECT count(*) FROM f) >= 100 THEN {r('max(gap)')} END AS mce FROM e""")
def agg_14(t):
    """Gaps between confidence and hit rate in bins of equal frequency, of at least 50 rows; null with rows for fewer than two."""
    top = F.array_max("p")
    x = forecast(t).select("vec_id", top.alias("conf"), F.when(F.array_position("p", top) - 1 == col("y"), 1.0).otherwise(0.0).alias("hit"))
    x = checkpointed(x)
    bins = min(10, x.count() // 50)
    if bins < 2:
        return x.agg(F.lit(None).cast("double").alias("ece"), F.lit(None).cast("double").alias("mce"))
    e = equal_bins(x, bins, "conf", "vec_id").groupBy("bin").agg(F.count("*").alias("k"), F.abs(F.avg("conf") - F.avg("hit")).alias("gap"))
    return e.agg(r6(F.sum(col("k") * col("gap")) / F.sum("k")).alias("ece"), r6(F.max("gap")).alias("mce"))


@query("agg_15_valid_forecasts", f"WITH {FORECAST_SQL} SELECT y, bool_and(abs(list_sum(p) - 1) <= 1e-6 AND list_min(p) >= 0 AND y BETWEEN 0 AND 2) AS ok FROM f GROUP BY 1")
def agg_15(t):
    total = F.aggregate("p", F.lit(0.0), lambda x, v: x + v)
    return forecast(t).groupBy("y").agg(F.bool_and((F.abs(total - 1) <= 1e-6) & (F.array_min("p") >= 0) & col("y").between(0, 2)).alias("ok"))


@query("agg_16_day_sums", f"WITH {FORECAST_SQL} SELECT vec_id % 20 AS day, {r(f'sum({B_SQL})')} AS model, {r('count(*) * 2 / 3.0::DOUBLE')} AS base, count(*) AS n FROM f GROUP BY 1")
def agg_16(t):
    return forecast(t).groupBy((col("vec_id") % 20).alias("day")).agg(r6(F.sum(brier_term(col("p"), col("y")))).alias("model"), r6(F.count("*") * 2 / 3.0).alias("base"), F.count("*").alias("n"))


@query("agg_17_pooled_skill", f"""WITH {FORECAST_SQL}, d AS (SELECT vec_id % 4 AS fold, 1 - sum({B_SQL}) / (count(*) * 2 / 3.0::DOUBLE) AS bss, sum(w) AS w FROM f GROUP BY 1) SELECT CASE WHEN count(bss) = count(*) THEN {r('sum(bss * w) / sum(w)')} END AS pooled FROM d""")
def agg_17(t):
    d = forecast(t).groupBy((col("vec_id") % 4).alias("fold")).agg((1 - F.sum(brier_term(col("p"), col("y"))) / (F.count("*") * 2 / 3.0)).alias("bss"), F.sum("w").alias("w"))
    return d.agg(F.when(F.count("bss") == F.count("*"), r6(F.sum(col("bss") * col("w")) / F.sum("w"))).alias("pooled"))


@query("agg_19_coverage", """SELECT count(*) AS total, count(*) FILTER (l_discount > 0 AND l_tax > 0) AS complete, count(*) FILTER (l_discount = 0) AS no_discount, count(*) FILTER (l_tax = 0) AS no_tax, (count(*) FILTER (l_discount = 0))::DOUBLE / count(*) > 0.05 AS review FROM lineitem""")
def agg_19(t):
    no_d, no_t = col("l_discount") == 0, col("l_tax") == 0
    return t.lineitem.agg(F.count("*").alias("total"), F.count_if(~no_d & ~no_t).alias("complete"), F.count_if(no_d).alias("no_discount"), F.count_if(no_t).alias("no_tax"), (F.count_if(no_d) / F.count("*") > 0.05).alias("review"))


@query("agg_20_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_20(t):
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("agg_21_terciles", f"""WITH {BARS4}, q AS (SELECT symbol, CASE WHEN count(*) >= 30 THEN quantile_cont(v, 1.0::DOUBLE / 3) END AS a, CASE WHEN count(*) >= 30 THEN quantile_cont(v, 2.0::DOUBLE / 3) END AS b FROM (SELECT symbol, v FROM bars UNION ALL SELECT symbol || ' flat', 5.0 FROM bars) GROUP BY 1)
SELECT symbol, CASE WHEN a < b THEN {r('a', 5)} END AS lower, CASE WHEN a < b THEN {r('b', 5)} END AS upper FROM q""")
def agg_21(t):
    """The bounds between the thirds of a series; null under thirty values, or if the bounds are the same, as those of a flat series are."""
    x = h4(t).select("symbol", "v")
    x = x.unionByName(x.select(F.concat("symbol", F.lit(" flat")).alias("symbol"), F.lit(5.0).alias("v")))
    q = a.quantiles(x, "symbol", "v", lower=1 / 3, upper=2 / 3).join(x.groupBy("symbol").agg(F.count("*").alias("n")), "symbol")
    ok = (col("n") >= 30) & (col("lower") < col("upper"))
    return q.select("symbol", *(F.when(ok, r6(col(c), 5)).alias(c) for c in ("lower", "upper")))


@query("agg_22_regime_days", f"""WITH {BARS4}, v AS (SELECT CASE WHEN symbol IN ('click', 'view') THEN 'pair' WHEN symbol = 'signup' THEN 'single' ELSE 'rest' END AS universe, symbol, t // {DAY_MS} AS day, avg(c) AS trend, avg(h - l) AS vol FROM bars GROUP BY 1, 2, 3),
d AS (SELECT universe, 'trend' AS axis, day, CASE WHEN trend <= 25 THEN 'low' WHEN trend >= 75 THEN 'high' ELSE 'mid' END AS bin FROM v UNION ALL SELECT universe, 'vol', day, CASE WHEN vol <= 30 THEN 'low' WHEN vol >= 400 THEN 'high' ELSE 'mid' END FROM v WHERE universe <> 'pair' OR symbol = 'view'),
k AS (SELECT universe, axis, day, min(bin) AS bin, min(bin) <> max(bin) AS conflict FROM d GROUP BY 1, 2, 3), bad AS (SELECT universe, bool_or(conflict) AS bad FROM k GROUP BY 1)
SELECT universe, axis, {", ".join(f"CASE WHEN NOT any_value(bad) THEN count(*) FILTER (bin = '{k}') END AS {k}" for k in ("low", "mid", "high"))} FROM k JOIN bad USING (universe) GROUP BY 1, 2""")
def agg_22(t):
    """Distinct days of each regime on both axes; one day with two values on one axis makes the whole result of its universe missing."""
    universe = F.when(col("symbol").isin("click", "view"), "pair").when(col("symbol") == "signup", "single").otherwise("rest")
    v = h4(t).groupBy(universe.alias("universe"), "symbol", F.floor(col("t") / DAY_MS).alias("day")).agg(F.avg("c").alias("trend"), F.avg(col("h") - col("l")).alias("vol"))
    cut = lambda c, low, high: F.when(col(c) <= low, "low").when(col(c) >= high, "high").otherwise("mid")
    d = v.select("universe", F.lit("trend").alias("axis"), "day", cut("trend", 25, 75).alias("bin"))
    d = d.unionByName(v.where("universe <> 'pair' or symbol = 'view'").select("universe", F.lit("vol").alias("axis"), "day", cut("vol", 30, 400).alias("bin")))
    return a.regime_days(d, "universe")


@query("agg_23_modal_gap", f"""WITH {bars_sql(HOUR_MS)}, g AS (SELECT symbol, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS gap FROM bars), n AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) SELECT symbol, gap FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, gap) = 1""")
def agg_23(t):
    return a.modal_gap(b.from_events(t.events, HOUR_MS), "symbol", "t")


@query("agg_24_exposure", f"""WITH {snapshot_sql('p', 20)} SELECT address, {r("sum(CASE WHEN side = 'LONG' THEN notional ELSE 0 END)")} AS long, {r("sum(CASE WHEN side = 'SHORT' THEN notional ELSE 0 END)")} AS short,
{r("(sum(CASE WHEN side = 'LONG' THEN notional ELSE -notional END)) / nullif(sum(notional), 0) * 100", 4)} AS net_pct, {r('sum(notional * (length(coin))) / nullif(sum(notional), 0)', 4)} AS leverage FROM p GROUP BY 1""")
def agg_24(t):
    side = lambda s: F.sum(F.when(col("side") == s, col("notional")).otherwise(0.0))
    total = F.nullif(F.sum("notional"), F.lit(0.0))
    x = snapshot(t, 20).groupBy("address").agg(side("LONG").alias("long"), side("SHORT").alias("short"), total.alias("total"), F.sum(col("notional") * F.length("coin")).alias("lev"))
    return x.select("address", r6(col("long")).alias("long"), r6(col("short")).alias("short"), r6((col("long") - col("short")) / col("total") * 100, 4).alias("net_pct"), r6(col("lev") / col("total"), 4).alias("leverage"))


HEAT_SQL = f"""{CLEAN_SQL}, hp AS (SELECT *, CASE WHEN id % 5 = 0 THEN 0.3 ELSE 1.0 END::DOUBLE AS wt FROM clean)"""


def heat_of(authors, weight, interactions):
    """Authors count most, posts and interactions less; accounts younger than a week at three tenths."""
    return F.log1p(authors) * 35 + F.log1p(weight) * 10 + F.log1p(interactions) * 5


def heat_sql(when: str) -> str:
    return f"(ln(1 + count(DISTINCT author) FILTER ({when})) * 35 + ln(1 + coalesce(sum(wt) FILTER ({when}), 0)) * 10 + ln(1 + coalesce(sum(wt * likes) FILTER ({when}), 0)) * 5)"


def weighted_posts(t):
    return clean(t).withColumn("wt", F.when(col("id") % 5 == 0, 0.3).otherwise(1.0))


@query("agg_28_heat", f"WITH {HEAT_SQL} SELECT symbol, count(*) AS posts, count(DISTINCT author) AS authors, {r('ln(1 + count(DISTINCT author)) * 35 + ln(1 + sum(wt)) * 10 + ln(1 + sum(wt * likes)) * 5', 2)} AS heat FROM hp GROUP BY 1")
def agg_28(t):
    heat = heat_of(F.countDistinct("author"), F.sum("wt"), F.sum(col("wt") * col("likes")))
    return weighted_posts(t).groupBy("symbol").agg(F.count("*").alias("posts"), F.countDistinct("author").alias("authors"), r6(heat, 2).alias("heat"))


@query("agg_29_heat_slope", f"""WITH {HEAT_SQL}, z AS (SELECT symbol, {heat_sql("posted >= " + str(NOW - 21600000))} / 6 AS a, {heat_sql("posted < " + str(NOW - 21600000))} / 18 AS b, {r(heat_sql("true"), 2)} AS heat FROM hp GROUP BY 1),
y AS (SELECT *, CASE WHEN b > 0 THEN {r('a / b', 2)} WHEN a > 0 THEN 5 END AS slope FROM z) SELECT symbol, heat, slope, coalesce(slope >= 1.5, false) AS rising, coalesce(slope >= 1.5, false) AND heat >= 25 AS newly_hot FROM y""")
def agg_29(t):
    return heat_slopes(t)


def heat_slopes(t):
    """The rate of heat in the last six hours against that before, whether it rises, and whether what rises is hot."""
    recent = col("at") >= NOW - 6 * HOUR_MS

    def heat(when):
        s = lambda c: F.coalesce(F.sum(F.when(when, c)), F.lit(0.0))
        return heat_of(F.countDistinct(F.when(when, col("author"))), s(col("wt")), s(col("wt") * col("likes")))

    x = weighted_posts(t).groupBy("symbol").agg((heat(recent) / 6).alias("a"), (heat(~recent) / 18).alias("b"), r6(heat(F.lit(True)), 2).alias("heat"))
    slope = F.when(col("b") > 0, r6(col("a") / col("b"), 2)).when(col("a") > 0, 5.0)
    x = x.select("symbol", "heat", slope.alias("slope")).withColumn("rising", F.coalesce(col("slope") >= 1.5, F.lit(False)))
    return x.withColumn("newly_hot", col("rising") & (col("heat") >= 25))


@query("agg_30_opinions", f"""WITH {CLEAN_SQL}, o AS (SELECT symbol, author, last(id % 3 - 1 ORDER BY posted, ordinal) AS d, last(CASE WHEN id % 7 = 0 THEN 1.35::DOUBLE ELSE 1.0 END ORDER BY posted, ordinal) AS w FROM clean GROUP BY 1, 2)
SELECT symbol, {", ".join(f"{r(f'sum(CASE WHEN d = {k} THEN 100.0::DOUBLE * {w} ELSE 0 END) / sum({w})', 2)} AS {p}{n}" for p, w in (("", "1"), ("weighted_", "w")) for n, k in (("bull", 1), ("neutral", 0), ("bear", -1)))},
{", ".join(f"{r(f'sum(d * {w}) * 100.0::DOUBLE / sum({w})', 2)} AS {p}net" for p, w in (("", "1"), ("weighted_", "w")))} FROM o GROUP BY 1""")
def agg_30(t):
    """How opinions are spread, each author's latest once, and the same with each weighing as much as its evidence."""
    weight = F.when(col("id") % 7 == 0, 1.35).otherwise(1.0)
    o = clean(t).groupBy("symbol", "author").agg(F.max_by(F.struct((col("id") % 3 - 1).alias("d"), weight.alias("w")), F.struct("at", "ordinal")).alias("x")).select("symbol", "x.d", "x.w")
    out = []
    for prefix, w in (("", F.lit(1.0)), ("weighted_", col("w"))):
        share = lambda k, w=w: r6(F.sum(F.when(col("d") == k, 100.0 * w).otherwise(0.0)) / F.sum(w), 2)
        out += [*(share(k).alias(prefix + n) for n, k in (("bull", 1), ("neutral", 0), ("bear", -1))), r6(F.sum(col("d") * w) * 100.0 / F.sum(w), 2).alias(f"{prefix}net")]
    return o.groupBy("symbol").agg(*out)


@query("agg_31_votes", f"""WITH {snapshot_sql('p', 20)} SELECT coin, count(*) AS n, CASE WHEN (count(*) FILTER (side = 'LONG') - count(*) FILTER (side = 'SHORT'))::DOUBLE / count(*) >= 0.1 THEN 1 WHEN (count(*) FILTER (side = 'LONG') - count(*) FILTER (side = 'SHORT'))::DOUBLE / count(*) <= -0.1 THEN -1 ELSE 0 END AS vote FROM p GROUP BY 1""")
def agg_31(t):
    """One vote for each address and coin, that of its larger side; a net share decides."""
    one = snapshot(t, 20).groupBy("coin", "address").agg(F.max_by("side", "notional").alias("side"))
    net = (F.count_if(col("side") == "LONG") - F.count_if(col("side") == "SHORT")) / F.count("*")
    return one.groupBy("coin").agg(F.count("*").alias("n"), F.when(net >= 0.1, 1).when(net <= -0.1, -1).otherwise(0).alias("vote"))


@query("agg_32_weighted_signal", f"SELECT l_suppkey, {r('coalesce(sum(l_tax * (l_discount - 0.05)) / nullif(sum(l_tax), 0), 0)')} AS signal FROM lineitem GROUP BY 1")
def agg_32(t):
    return t.lineitem.groupBy("l_suppkey").agg(r6(a.weighted_mean(col("l_discount") - 0.05, col("l_tax"))).alias("signal"))


@query("agg_33_parameter_grid")
def agg_33(t):
    """How often a range is found, for each threshold of a turn, tolerance, limit of the height, least containment and least touches; the last three are a list of literals, joined to what was found."""
    points = st.range_points(h4(t), 84, 6, [1.5, 2.0, 3.0], [0.5, 1.0])
    grid = F.array(*(F.struct(F.lit(cap).alias("cap"), F.lit(c).alias("containment"), F.lit(n).alias("min_touches")) for cap in (10.0, 15.0, 25.0) for c in (0.6, 0.8) for n in (2, 3)))
    x = points.select("mult", "tol", "height_atr", col("containment").alias("inside"), "touches", F.inline(grid))
    ok = (col("height_atr") <= col("cap")) & (col("inside") >= col("containment")) & (col("touches") >= col("min_touches"))
    return x.groupBy("mult", "tol", "cap", "containment", "min_touches").agg(F.count("*").alias("points"), r6(F.avg(F.when(ok, 1.0).otherwise(0.0))).alias("coverage"))


@query("agg_34_rates_by_bucket", f"""WITH x AS (SELECT *, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS d, o_orderstatus = 'F' AS f FROM orders), k AS (
SELECT 'age' AS kind, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' WHEN d < 60 THEN '<60d' WHEN d < 180 THEN '60-180d' ELSE '>=180d' END AS bucket, f FROM x UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), f FROM x UNION ALL SELECT 'quarter', year(o_orderdate) || 'Q' || quarter(o_orderdate), f FROM x)
SELECT kind, bucket, count(*) AS n, {r("avg(CASE WHEN f THEN 1.0::DOUBLE ELSE 0 END)")} AS complete FROM k GROUP BY 1, 2""")
def agg_34(t):
    """Rows and the share of complete ones by age, month and quarter: each row is in one bucket of each kind."""
    d = F.datediff(col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    age = F.when(col("o_orderkey") % 13 == 0, "unknown").when(d < 60, "<60d").when(d < 180, "60-180d").otherwise(">=180d")
    month, quarter = F.date_format("o_orderdate", "yyyy-MM"), F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    return a.rates_by(t.orders, col("o_orderstatus") == "F", age=age, month=month, quarter=quarter).withColumn("complete", r6(col("complete")))


@query("agg_35_dropped_and_exposed", "SELECT o_orderpriority, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)) AS dropped, count(*) AS n FROM orders GROUP BY 1")
def agg_35(t):
    kept = t.lineitem.where("l_quantity > 45").select(col("l_orderkey").alias("o_orderkey")).distinct().withColumn("kept", F.lit(True))
    return t.orders.join(kept, "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count_if(col("kept").isNull()).alias("dropped"), F.count("*").alias("n"))


@query("agg_36_scale_floor", f"WITH i AS (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS q FROM orders GROUP BY o_custkey) SELECT {r('quantile_cont(q, 0.1)', 4)} AS floor FROM i WHERE q > 0")
def agg_36(t):
    """The tenth percentile of the spreads that are not zero."""
    return a.global_quantile(spreads(t).where("q > 0"), "q", 0.1).select(r6(col("q"), 4).alias("floor"))


@query("agg_37_series_facts", f"""WITH {bars_sql(HOUR_MS)}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS gap FROM bars)
SELECT symbol, count(*) AS bars, count(*) FILTER (gap <> {HOUR_MS}) AS gaps, count(*) FILTER (h < greatest(o, c, l) OR l > least(o, c, h)) AS bad, CAST((1706655600000 - max(t)) // {HOUR_MS} AS BIGINT) AS short_of_end FROM g GROUP BY 1""")
def agg_37(t):
    return b.series_facts(b.from_events(t.events, HOUR_MS), HOUR_MS, 1_706_655_600_000)


@query("agg_38_unanimity", "SELECT user_id, CASE WHEN count(v) = 0 THEN 'untested' WHEN min(v) = max(v) THEN min(v) ELSE 'mixed' END AS verdict, CASE WHEN count(v) >= 10 THEN 'established' WHEN count(v) >= 3 THEN 'suggestive' ELSE 'thin' END AS tier FROM (SELECT user_id, CASE WHEN value > 150 THEN 'up' WHEN value < 3 THEN 'down' END AS v FROM events) GROUP BY 1")
def agg_38(t):
    x = t.events.withColumn("v", F.when(col("value") > 150, "up").when(col("value") < 3, "down"))
    n = F.count("v")
    return x.groupBy("user_id").agg(a.unanimous(col("v")).alias("verdict"), F.when(n >= 10, "established").when(n >= 3, "suggestive").otherwise("thin").alias("tier"))


@query("agg_39_board_hits", """SELECT o_custkey, count(*) AS hits, min(rk) AS best, string_agg(board || ':' || rk, ',' ORDER BY board, rk) AS boards
FROM (SELECT o_custkey, o_orderpriority AS board, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 50 GROUP BY 1""")
def agg_39(t):
    """On how many boards a trader is, the best place, and the list of both; boards have fifty places."""
    x = k.top_per(t.orders, "o_orderpriority", 50, col("o_totalprice").desc(), "o_orderkey", rank="rk")
    boards = F.array_sort(F.collect_list(F.struct("o_orderpriority", "rk")))
    x = x.groupBy("o_custkey").agg(F.count("*").alias("hits"), F.min("rk").cast("long").alias("best"), boards.alias("b"))
    return x.select("o_custkey", "hits", "best", F.array_join(F.transform("b", lambda v: F.concat_ws(":", v["o_orderpriority"], v["rk"].cast("string"))), ",").alias("boards"))


MDL14 = """CASE WHEN vec_id % 10 <> 0 THEN 'none' WHEN vec_id % 20 = 0 THEN 'unknown' WHEN vec_id // 10 % 120 < 7 THEN '<7d' WHEN vec_id // 10 % 120 < 30 THEN '7-30d' WHEN vec_id // 10 % 120 < 90 THEN '30-90d' ELSE '>90d' END"""


@query("mdl_14_subgroup_skill", f"""WITH {FORECAST_SQL}, b AS (SELECT *, {B_SQL} AS brier, (SELECT [sum(w) FILTER (y = 0) / sum(w), sum(w) FILTER (y = 1) / sum(w), sum(w) FILTER (y = 2) / sum(w)] FROM f) AS q FROM f),
c AS (SELECT *, pow(q[1] - (y = 0)::INT, 2) + pow(q[2] - (y = 1)::INT, 2) + pow(q[3] - (y = 2)::INT, 2) AS ref, CASE WHEN vec_id % 10 = 0 THEN 'delisted' ELSE 'survivor' END AS gone, {MDL14} AS days FROM b),
g AS (SELECT 'universe' AS kind, gone AS grp, * FROM c UNION ALL SELECT 'class', gone || ' ' || ['down', 'flat', 'up'][y + 1], * FROM c UNION ALL SELECT 'days to settlement', days, * FROM c WHERE gone = 'delisted')
SELECT kind, grp, count(*) AS n, {r('1 - sum(w * brier) / sum(w * ref)')} AS bss FROM g GROUP BY 1, 2""")
def mdl_14(t):
    """The skill of the same forecasts, against the base rates of all, on delisted and surviving contracts, by true class, and by days to the settlement."""
    f = forecast(t)
    i = col("vec_id")
    gone, left = F.when(i % 10 == 0, "delisted").otherwise("survivor"), F.floor(i / 10) % 120
    days = F.when(i % 20 == 0, "unknown").when(left < 7, "<7d").when(left < 30, "7-30d").when(left < 90, "30-90d").otherwise(">90d")
    name = F.element_at(F.array(*map(F.lit, ("down", "flat", "up"))), (col("y") + 1).cast("int"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), g.alias("grp")) for k, g in (("universe", gone), ("class", F.concat(gone, F.lit(" "), name)), ("days to settlement", F.when(gone == "delisted", days)))))
    rates = f.agg(F.array(*(F.sum(F.when(col("y") == k, col("w")).otherwise(0.0)) / F.sum("w") for k in range(3))).alias("rates"))  # one row
    x = f.join(F.broadcast(rates)).select("w", brier_term(col("p"), col("y")).alias("br"), brier_term(col("rates"), col("y")).alias("ref"), F.inline(kinds)).where("grp is not null")
    return x.groupBy("kind", "grp").agg(F.count("*").alias("n"), r6(a.skill(col("br"), col("ref"), col("w"))).alias("bss"))


@query("flow_ratio_by_symbol", f"WITH {BARS4} SELECT symbol, {r('sum(2 * tb - v) / nullif(sum(v), 0) * 100')} AS net_ratio FROM bars GROUP BY 1")
def flow_ratio(t):
    return h4(t).groupBy("symbol").agg(r6(ratio(F.sum(2 * col("tb") - col("v")), F.sum("v")) * 100).alias("net_ratio"))
