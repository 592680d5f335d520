"""Queries of orders, limits and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import round_half_up
from ..operators import ranking as k
from ..operators.scale import checkpointed
from ..operators.selection import equal_bins
from . import windows as wq
from .registry import query, r
from .scalars import FORECAST_SQL, forecast

col = F.col
r6 = round_half_up


@query("srt_1_multi_key", """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(CASE WHEN c_acctbal > 2000 THEN c_acctbal END, -1) DESC, c_mktsegment = 'BUILDING' DESC, c_custkey) AS place FROM customer""")
def srt_1(t):
    order = [F.coalesce(F.when(col("c_acctbal") > 2000, col("c_acctbal")), F.lit(-1.0)).desc(), (col("c_mktsegment") == "BUILDING").desc(), col("c_custkey")]
    return k.keyed_rank(t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_nationkey", order, "place").select("c_custkey", "place")


@query("srt_2_nulls_last", """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END ASC NULLS LAST, c_custkey) AS up, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS down FROM customer""")
def srt_2(t):
    x = t.customer.select("c_custkey", "c_nationkey", F.when(col("c_acctbal") > 0, col("c_acctbal")).alias("v"))
    x = k.keyed_rank(x, "c_nationkey", [col("v").asc_nulls_last(), col("c_custkey")], "up")
    return k.keyed_rank(x, "c_nationkey", [col("v").desc_nulls_last(), col("c_custkey")], "down").select("c_custkey", "up", "down")


@query("srt_3_cross_rows", "SELECT n_name, coverage FROM (SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS coverage FROM nation) ORDER BY coverage DESC, n_name LIMIT 10")
def srt_3(t):
    n = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    x = t.nation.join(n, col("n_nationkey") == col("s_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("coverage"))
    return x.orderBy(col("coverage").desc(), "n_name").limit(10)


@query("srt_4_pool_then_value", "SELECT s_suppkey, s_acctbal >= 3000 AS quality FROM supplier ORDER BY 2 DESC, s_acctbal DESC, s_suppkey LIMIT 50")
def srt_4(t):
    return t.supplier.select("s_suppkey", (col("s_acctbal") >= 3000).alias("quality"), "s_acctbal").orderBy(col("quality").desc(), col("s_acctbal").desc(), "s_suppkey").limit(50).drop("s_acctbal")


@query("lim_1_limit_then_dedup", "SELECT user_id, event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 60) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def lim_1(t):
    """The newest 60 rows first, and only then the latest of each user."""
    newest = t.events.orderBy(col("ts").desc(), col("event_id").desc()).limit(60)
    return newest.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


LISTS_SQL = f"""h AS (SELECT p_brand, p_type, count(*) AS n, {r('avg(p_retailprice) / 700', 2)} AS slope FROM part GROUP BY 1, 2)"""


@query("lim_2_hottest", f"WITH {LISTS_SQL} (SELECT 'hottest' AS list, p_brand, p_type FROM h ORDER BY n DESC, p_brand, p_type LIMIT 12) UNION ALL (SELECT 'rising', p_brand, p_type FROM h WHERE slope >= 1.5 ORDER BY slope DESC, p_brand, p_type LIMIT 12)")
def lim_2(t):
    """The twelve hottest, and the twelve that rise fastest of those that rise."""
    h = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), r6(F.avg("p_retailprice") / 700, 2).alias("slope"))
    first = lambda x, name, c: x.orderBy(col(c).desc(), "p_brand", "p_type").limit(12).select(F.lit(name).alias("list"), "p_brand", "p_type")
    return first(h, "hottest", "n").unionByName(first(h.where("slope >= 1.5"), "rising", "slope"))


@query("lim_3_top_per_board", """WITH b AS (SELECT o_custkey, o_orderpriority, o_totalprice, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders),
seed AS (SELECT o_custkey, 0 AS tier, min(o_orderpriority || ':' || lpad(rk::VARCHAR, 3, '0')) AS spot FROM b WHERE rk <= 10 GROUP BY 1),
best AS (SELECT o_custkey, 1 AS tier, lpad((row_number() OVER (ORDER BY profit DESC, o_custkey))::VARCHAR, 3, '0') AS spot FROM (SELECT o_custkey, sum(o_totalprice) AS profit FROM orders WHERE o_totalprice >= 100000 GROUP BY 1) ORDER BY profit DESC, o_custkey LIMIT 120)
SELECT o_custkey FROM (SELECT o_custkey, min((tier, spot)) AS place FROM (SELECT * FROM seed UNION ALL SELECT * FROM best) GROUP BY 1) ORDER BY place LIMIT 180""")
def lim_3(t):
    """Who is looked at closely: the first ten of each board, then the best 120 of all that qualify, 180 at most."""
    seed = k.top_per(t.orders, "o_orderpriority", 10, col("o_totalprice").desc(), "o_orderkey", rank="rk")
    place = lambda c: F.lpad(c.cast("string"), 3, "0")
    seed = seed.groupBy("o_custkey").agg(F.min(F.concat("o_orderpriority", F.lit(":"), place(col("rk")))).alias("at")).withColumn("tier", F.lit(0))
    best = t.orders.where("o_totalprice >= 100000").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("profit")).orderBy(col("profit").desc(), "o_custkey").limit(120)
    best = best.select("o_custkey", place(F.row_number().over(Window.orderBy(col("profit").desc(), "o_custkey"))).alias("at"), F.lit(1).alias("tier"))  # of 120 rows
    both = seed.unionByName(best).groupBy("o_custkey").agg(F.min(F.struct("tier", "at")).alias("place"))
    return both.orderBy("place").limit(180).select("o_custkey")


@query("lim_4_last_events", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def lim_4(t):
    return t.events.orderBy(col("ts").desc(), col("event_id").desc()).limit(500).select("event_id")


SQUEEZE_SQL = f"""WITH {wq.ATR_SQL}, m AS (SELECT symbol, t, mr FROM {wq.midrank_sql('atr_pct', wq.RANK, 'p')} WHERE mr IS NOT NULL)
SELECT symbol, t, {r('mr')} AS squeeze, row_number() OVER w AS rank, {r('CASE WHEN count(*) OVER (PARTITION BY t) = 1 THEN 0 ELSE (row_number() OVER w - 1)::DOUBLE / (count(*) OVER (PARTITION BY t) - 1) END')} AS percentile
FROM m WINDOW w AS (PARTITION BY t ORDER BY floor(mr * 1e6 + 0.5), symbol)"""


@query("rnk_1_squeeze_ranking", SQUEEZE_SQL)
def rnk_1(t):
    """Symbols by how tight their range is against their own past, at each time: the tightest is first."""
    x = wq.with_atr(wq.h4(t)).select("symbol", "t", r6(wq.w.midrank("atr_pct", wq.RANK)).alias("squeeze")).where("squeeze is not null")
    x = k.ranked(x, "squeeze", "symbol", by=("t",))
    return x.select("symbol", "t", "squeeze", col("rank").cast("long"), r6(col("percentile")).alias("percentile"))


@query("rnk_2_position", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS position FROM supplier")
def rnk_2(t):
    return k.keyed_rank(t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", [col("s_acctbal").desc(), col("s_suppkey")], "position").select("s_suppkey", "position")


@query("rnk_3_lift_deciles", f"""WITH {FORECAST_SQL}, d AS (SELECT p[3] AS p, y, w, CAST(floor((row_number() OVER (ORDER BY p[3] DESC, vec_id) * 10 - 1) / count(*) OVER ()) AS INT) AS decile FROM f)
SELECT decile, count(*) AS n, {r('sum(w * p) / sum(w)')} AS mean_p, {", ".join(f"{r(f'sum(CASE WHEN y = {i} THEN w ELSE 0 END) / sum(w)')} AS {c}" for i, c in enumerate(("down", "flat", "up")))}, {r('(SELECT sum(CASE WHEN y = 2 THEN w ELSE 0 END) / sum(w) FROM f)')} AS base_rate FROM d GROUP BY 1""")
def rnk_3(t):
    """By tenths of the predicted probability of the last class, the highest first: what is predicted, how often each class comes, and the rate of all."""
    f = forecast(t)
    share = lambda i: F.sum(F.when(col("y") == i, col("w")).otherwise(0.0)) / F.sum("w")
    base = f.agg(r6(share(2)).alias("base_rate"))  # one row
    x = equal_bins(checkpointed(f.select("vec_id", col("p")[2].alias("p"), "y", "w")), 10, "p", "vec_id", descending=True, name="decile")
    x = x.groupBy("decile").agg(F.count("*").alias("n"), r6(F.sum(col("w") * col("p")) / F.sum("w")).alias("mean_p"), *(r6(share(i)).alias(c) for i, c in enumerate(("down", "flat", "up"))))
    return x.join(F.broadcast(base))
