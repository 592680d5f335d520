"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, HOUR_MS, change, round_half_up
from ..operators import bars as b
from ..operators import joins as j
from .registry import bars_sql, query, r

H4 = 4 * HOUR_MS
col = F.col
r6 = round_half_up
BARS4 = bars_sql(H4)


def at_ms():
    return F.unix_millis(col("ts").cast("timestamp"))


MS = "(epoch_us(ts) // 1000)"


@query("jon_1_lookup", "SELECT l_orderkey, l_linenumber, p_brand, s_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def jon_1(t):
    x = t.lineitem.join(t.part, col("l_partkey") == col("p_partkey"), "left").join(t.supplier, col("l_suppkey") == col("s_suppkey"), "left")
    return x.select("l_orderkey", "l_linenumber", "p_brand", "s_name")


@query("jon_2_exact_time", f"""WITH {BARS4}, {bars_sql(H4, every=True, name='market')} SELECT bars.symbol, bars.t, CASE WHEN count(market.c) OVER w = 6 THEN {r('market.c')} END AS bench
FROM bars LEFT JOIN market ON market.t = bars.t AND market.trades >= 20 WINDOW w AS (PARTITION BY bars.symbol ORDER BY bars.t ROWS 5 PRECEDING)""")
def jon_2(t):
    """Bars with the benchmark's close of the same time; any miss within the window makes it missing."""
    bench = b.from_events(t.events, H4, F.lit("ALL")).where("trades >= 20").select("t", col("c").alias("bench"))
    x = b.from_events(t.events, H4).join(bench, "t", "left")
    whole = F.count("bench").over(Window.partitionBy("symbol").orderBy("t").rowsBetween(-5, 0)) == 6
    return x.select("symbol", "t", F.when(whole, r6(col("bench"))).alias("bench"))


@query("jon_3_as_of", """WITH a AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view')
SELECT a.event_id, v.event_id AS view_id, v.value AS view_value FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.ts >= v.ts""")
def jon_3(t):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'view'").select("user_id", "ts", col("event_id").alias("view_id"), col("value").alias("view_value"))
    return j.as_of(left, right, "user_id", "ts", "ts", ["view_id", "view_value"]).select("event_id", "view_id", "view_value")


@query("jon_4_exact_point", f"WITH {BARS4} SELECT x.symbol, x.t, {r('(x.v / y.v - 1) * 100')} AS pct FROM bars x LEFT JOIN bars y ON x.symbol = y.symbol AND y.t = x.t - {DAY_MS}")
def jon_4(t):
    """The value at exactly a day before: never the nearest, never filled."""
    x = b.from_events(t.events, H4)
    return x.join(x.select("symbol", (col("t") + DAY_MS).alias("t"), col("v").alias("old")), ["symbol", "t"], "left").select("symbol", "t", r6(change(col("v"), col("old"))).alias("pct"))


@query("jon_5_cross_section", f"WITH {BARS4} SELECT symbol, bars.t, n, {r('v / total')} AS share FROM bars JOIN (SELECT t, count(*) AS n, sum(v) AS total FROM bars GROUP BY 1) x USING (t)")
def jon_5(t):
    x = b.from_events(t.events, H4)
    at = Window.partitionBy("t")
    return x.select("symbol", "t", F.count("*").over(at).alias("n"), r6(col("v") / F.sum("v").over(at)).alias("share"))


def snapshot(t, until_day: int):
    """Each user's last event of a kind before a day, as a position."""
    x = t.events.where(at_ms() < 1_704_067_200_000 + until_day * DAY_MS).groupBy(col("user_id").alias("address"), col("event_type").alias("coin"))
    x = x.agg(F.max_by("value", F.struct("ts", "event_id")).alias("notional"), F.max_by(F.get_json_object("props", "$.k").cast("int"), F.struct("ts", "event_id")).alias("k"), F.max(at_ms()).alias("seen"))
    return x.where(col("seen") >= 1_704_067_200_000 + (until_day - 5) * DAY_MS).select("address", "coin", F.when(col("k") >= 50, "LONG").otherwise("SHORT").alias("side"), "notional")


def snapshot_sql(name: str, until_day: int) -> str:
    return f"""{name} AS (SELECT user_id AS address, event_type AS coin, CASE WHEN last(CAST(regexp_extract(props, '[0-9]+') AS INT) ORDER BY ts, event_id) >= 50 THEN 'LONG' ELSE 'SHORT' END AS side, last(value ORDER BY ts, event_id) AS notional
      FROM events WHERE {MS} < 1704067200000 + {until_day * DAY_MS} GROUP BY 1, 2 HAVING max({MS}) >= 1704067200000 + {(until_day - 5) * DAY_MS})"""


CHANGES_SQL = f"""WITH {snapshot_sql('a', 12)}, {snapshot_sql('b', 16)}, x AS (
SELECT coalesce(a.address, b.address) AS address, coalesce(a.coin, b.coin) AS coin, a.side AS from_side, b.side AS to_side, a.notional AS from_notional, b.notional AS to_notional
FROM a FULL JOIN (SELECT * FROM b WHERE address IN (SELECT address FROM a)) b ON a.address = b.address AND a.coin = b.coin),
y AS (SELECT *, CASE WHEN from_side IS NULL THEN 'opened' WHEN to_side IS NULL THEN 'closed' WHEN from_side <> to_side THEN 'reversed'
  WHEN from_notional > 0 AND abs(to_notional - from_notional) / from_notional >= 0.3 THEN CASE WHEN to_notional > from_notional THEN 'increased' ELSE 'reduced' END END AS type FROM x)"""


@query("jon_6_position_changes", f"{CHANGES_SQL} SELECT address, coin, from_side, to_side, from_notional, to_notional, type FROM y WHERE type IS NOT NULL")
def jon_6(t):
    return j.position_changes(snapshot(t, 12), snapshot(t, 16)).select("address", "coin", "from_side", "to_side", "from_notional", "to_notional", "type")


@query("rul_11_event_types", f"{CHANGES_SQL} SELECT type, count(*) AS n FROM y WHERE type IS NOT NULL GROUP BY 1")
def rul_11(t):
    return j.position_changes(snapshot(t, 12), snapshot(t, 16)).groupBy("type").agg(F.count("*").alias("n"))


@query("jon_7_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def jon_7(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), col("c_custkey") == col("o_custkey"), "left_anti").select("c_custkey")


@query("jon_8_semi_of_arrays", "SELECT DISTINCT event_id, code FROM (SELECT event_id, unnest([event_type, 'T' || user_id % 7, event_type]) AS code FROM events) WHERE code IN ('click', 'view', 'T3')")
def jon_8(t):
    known = t.spark.createDataFrame([("click",), ("view",), ("T3",)], "code string")
    codes = F.concat(F.array("event_type"), F.array(F.concat(F.lit("T"), (col("user_id") % 7).cast("string"))), F.array("event_type"))
    return t.events.select("event_id", F.explode(F.array_distinct(codes)).alias("code")).join(F.broadcast(known), "code", "left_semi").select("event_id", "code")


@query("jon_9_union_of_keys", """WITH k AS (SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)
SELECT k, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = k) AS suppliers, (SELECT count(*) FROM customer WHERE c_nationkey = k) AS customers FROM k LEFT JOIN nation ON n_nationkey = k""")
def jon_9(t):
    s = t.supplier.groupBy(col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    c = t.customer.groupBy(col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    keys = t.nation.select(col("n_nationkey").alias("k")).union(s.select("k")).union(c.select("k")).distinct()
    x = keys.join(t.nation, col("k") == col("n_nationkey"), "left").join(s, "k", "left").join(c, "k", "left")
    return x.select("k", "n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("jon_10_unique_match", """WITH s AS (SELECT s_nationkey AS k, any_value(s_acctbal) AS price FROM supplier GROUP BY 1 HAVING count(*) = 1)
SELECT c_custkey, CASE WHEN abs(price / c_acctbal - 1) < 0.5 THEN price END AS price FROM customer LEFT JOIN s ON s.k = c_nationkey""")
def jon_10(t):
    left = t.customer.select("c_custkey", "c_acctbal", col("c_nationkey").alias("k"))
    right = t.supplier.select(col("s_nationkey").alias("k"), col("s_acctbal").alias("price"))
    return j.unique_match(left, right, "k", F.abs(col("price") / col("c_acctbal") - 1) < 0.5).select("c_custkey", "price")


@query("jon_11_identity", "SELECT x.event_id, y.event_id AS evidence FROM events x JOIN events y ON y.event_id = x.event_id + 1 AND x.event_type = y.event_type AND x.user_id % 10 = y.user_id % 10")
def jon_11(t):
    """Evidence counts only if author and symbol are those of the post."""
    y = t.events.select((col("event_id") - 1).alias("event_id"), col("event_id").alias("evidence"), col("event_type").alias("y_type"), col("user_id").alias("y_user"))
    return t.events.join(y, "event_id").where((col("event_type") == col("y_type")) & (col("user_id") % 10 == col("y_user") % 10)).select("event_id", "evidence")


@query("jon_12_fallback_mapping", "SELECT x.k, coalesce(a.p_partkey, b.p_partkey) AS part FROM (SELECT DISTINCT l_partkey * 3 AS k FROM lineitem) x LEFT JOIN part a ON a.p_partkey = x.k LEFT JOIN part b ON b.p_partkey = x.k - 3000")
def jon_12(t):
    """By name, else by the name with a prefix."""
    x = t.lineitem.select((col("l_partkey") * 3).alias("k")).distinct()
    p = t.part.select(col("p_partkey").alias("a"))
    q = t.part.select((col("p_partkey") + 3000).alias("k"), col("p_partkey").alias("b"))
    return x.join(p, col("k") == col("a"), "left").join(q, "k", "left").select("k", F.coalesce("a", "b").alias("part"))


@query("jon_13_label_window", f"WITH {BARS4} SELECT symbol, t, max(h) OVER w AS top, min(l) OVER w AS bottom, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)")
def jon_13(t):
    w = Window.partitionBy("symbol").orderBy("t").rowsBetween(1, 6)
    return b.from_events(t.events, H4).select("symbol", "t", F.max("h").over(w).alias("top"), F.min("l").over(w).alias("bottom"), F.count("*").over(w).alias("n"))


SPANS_SQL = f"spans AS (SELECT event_type AS g, {MS} // {HOUR_MS} * {HOUR_MS} AS a, {MS} // {HOUR_MS} * {HOUR_MS} + (user_id % 5 + 1) * {HOUR_MS} AS z FROM events)"


def spans(t):
    at = F.floor(at_ms() / HOUR_MS).cast("long") * HOUR_MS
    return t.events.select("event_id", col("event_type").alias("group"), at.alias("time"), (at + (col("user_id") % 5 + 1) * HOUR_MS).alias("end"))


@query("jon_14_overlap_counts", f'WITH {SPANS_SQL} SELECT g AS "group", slot, count(*) AS n FROM (SELECT g, unnest(range(a, z, {HOUR_MS})) AS slot FROM spans) GROUP BY 1, 2')
def jon_14(t):
    return j.overlap_counts(spans(t), HOUR_MS)


@query("jon_15_preferred_horizon", """WITH h AS (SELECT o_custkey, o_orderpriority AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT c_custkey, round(coalesce(a.v, b.v, c.v), 2) AS value FROM customer LEFT JOIN h a ON a.o_custkey = c_custkey AND a.p = '1-URGENT' LEFT JOIN h b ON b.o_custkey = c_custkey AND b.p = '2-HIGH' LEFT JOIN h c ON c.o_custkey = c_custkey AND c.p = '3-MEDIUM'""")
def jon_15(t):
    """The first horizon of an order of preference that a member has."""
    order = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))
    v = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("v")).withColumn("p", F.array_position(order, col("o_orderpriority"))).where("p > 0")
    best = v.groupBy("o_custkey").agg(F.min_by("v", "p").alias("v"))
    return t.customer.join(best, col("c_custkey") == col("o_custkey"), "left").select("c_custkey", F.round("v", 2).alias("value"))


@query("jon_16_two_rankings", """SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100) UNION SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 80)""")
def jon_16(t):
    a = t.customer.orderBy(col("c_acctbal").desc(), "c_custkey").limit(100)
    z = t.customer.orderBy("c_nationkey", col("c_acctbal").desc(), "c_custkey").limit(80)
    return a.union(z).select("c_custkey").distinct()


@query("jon_17_plan_status", """SELECT p_partkey, CASE WHEN n IS NULL THEN 'no data' WHEN n < 20 THEN 'incomplete' WHEN p_size > 40 THEN 'late' ELSE 'ready' END AS status FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def jon_17(t):
    n = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    status = F.when(col("n").isNull(), "no data").when(col("n") < 20, "incomplete").when(col("p_size") > 40, "late").otherwise("ready")
    return t.part.join(n, col("p_partkey") == col("l_partkey"), "left").select("p_partkey", status.alias("status"))


@query("jon_18_reconcile", f"""WITH {bars_sql(HOUR_MS, every=True, name='one')}, {bars_sql(H4, every=True, name='four')},
made AS (SELECT symbol, t // {H4} * {H4} AS t, first(o ORDER BY t) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY t) AS c FROM one GROUP BY 1, 2 HAVING count(*) = 4)
SELECT CASE WHEN m.t IS NULL THEN 'only right' WHEN f.t IS NULL THEN 'only left' WHEN m.o = f.o AND m.h = f.h AND m.l = f.l AND m.c = f.c THEN 'same' ELSE 'differs' END AS state, count(*) AS n FROM made m FULL JOIN four f ON m.symbol = f.symbol AND m.t = f.t GROUP BY 1""")
def jon_18(t):
    made = b.coarser(b.from_events(t.events, HOUR_MS, F.lit("ALL")), HOUR_MS, 4)
    return j.reconciled(made, b.from_events(t.events, H4, F.lit("ALL")), ["symbol", "t"], ["o", "h", "l", "c"], 1e-9)


@query("jon_19_day_source", f"""WITH d AS (SELECT event_type AS g, {MS} // {DAY_MS} AS day, max(user_id % 3) AS y FROM events GROUP BY 1, 2) SELECT a.g, a.day, coalesce(s.y, -1) AS y FROM d a LEFT JOIN d s ON s.g = a.g AND s.day = 19723 + (a.day - 19723 + 7) % 33""")
def jon_19(t):
    """Each day takes the label of the same group on its source day; -1 where there is none."""
    d = t.events.groupBy(col("event_type").alias("g"), F.floor(at_ms() / DAY_MS).alias("day")).agg(F.max(col("user_id") % 3).alias("y"))
    source = d.select("g", col("day").alias("source"), "y")
    x = d.select("g", "day", (19723 + (col("day") - 19723 + 7) % 33).alias("source")).join(source, ["g", "source"], "left")
    return x.select("g", "day", F.coalesce("y", F.lit(-1)).alias("y"))


@query("jon_20_last_good", """WITH n AS (SELECT o_custkey AS id, count(*) AS v, bool_and(o_orderstatus <> 'P') AS done FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1), o AS (SELECT o_custkey AS id, count(*) AS v, bool_and(o_orderstatus <> 'P') AS done FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT n.id, CASE WHEN NOT n.done AND o.v IS NOT NULL THEN o.v ELSE n.v END AS v, NOT n.done AND o.v IS NOT NULL AS stale FROM n LEFT JOIN (SELECT * FROM o WHERE done) o USING (id)""")
def jon_20(t):
    of = lambda x: x.groupBy(col("o_custkey").alias("id")).agg(F.count("*").alias("v"), F.bool_and(col("o_orderstatus") != "P").alias("done"))
    cut = F.expr("TIMESTAMP_NTZ '1997-01-01'")
    return j.with_fallback(of(t.orders.where(col("o_orderdate") >= cut)), of(t.orders.where(col("o_orderdate") < cut)), "id", "done", "v")


# --- set operations


@query("set_1_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_1(t):
    return t.customer.select(col("c_nationkey").alias("k")).unionByName(t.supplier.select(col("s_nationkey").alias("k"))).distinct()


@query("set_2_union_all", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE value > 50) GROUP BY 1")
def set_2(t):
    e = t.events.select("event_type", "value")
    return e.unionByName(e.where("value > 50")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("set_3_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_3(t):
    return t.part.select(col("p_partkey").alias("k")).subtract(t.lineitem.where("l_quantity > 45").select("l_partkey"))


@query("set_4_intersection", "SELECT o_custkey AS k FROM orders WHERE o_totalprice < 50000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_4(t):
    a, z = t.orders.where("o_totalprice < 50000"), t.orders.where("o_totalprice > 400000")
    return a.select(col("o_custkey").alias("k")).intersect(z.select("o_custkey"))


@query("set_5_key_union", f"WITH {snapshot_sql('a', 12)}, {snapshot_sql('b', 16)} SELECT address, coin FROM a UNION SELECT address, coin FROM b")
def set_5(t):
    return snapshot(t, 12).select("address", "coin").join(snapshot(t, 16).select("address", "coin"), ["address", "coin"], "full_outer")
