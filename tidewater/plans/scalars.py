"""Queries of projections, filters on rows, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators.guards import universe
from .registry import K, Tables, query, r

LINE = ["l_orderkey", "l_linenumber"]
LINE_SQL = "l_orderkey, l_linenumber"
col = F.col


def text_number(t: Tables):
    """Order prices as the decimal text that feeds deliver, with gaps."""
    raw = F.when(col("o_orderkey") % 7 == 0, "").when(col("o_orderkey") % 11 == 0, "NaN").when(col("o_orderkey") % 13 == 0, "n/a").otherwise(F.format_string("%.2f", "o_totalprice"))
    return t.orders.select("o_orderkey", raw.alias("raw"))


NUMBER_SQL = "CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE CAST(printf('%.2f', o_totalprice) AS DOUBLE) END"


@query("prj_1_to_number", f"SELECT o_orderkey, {NUMBER_SQL} AS price FROM orders")
def prj_1(t):
    return text_number(t).select("o_orderkey", s.to_number(col("raw")).alias("price"))


@query("prj_2_positive", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer")
def prj_2(t):
    return t.customer.select("c_custkey", s.positive(col("c_acctbal")).alias("balance"))


@query("prj_3_round_half_up", f"SELECT {LINE_SQL}, {r('l_extendedprice * l_discount', 2)} AS d2, {r('-l_extendedprice / 8', 0)} AS d0 FROM lineitem")
def prj_3(t):
    return t.lineitem.select(*LINE, s.round_half_up(col("l_extendedprice") * col("l_discount"), 2).alias("d2"), s.round_half_up(-col("l_extendedprice") / 8, 0).alias("d0"))


@query("prj_4_change", f"""SELECT {LINE_SQL}, CASE WHEN l_tax > 0 THEN {r('(l_discount / l_tax - 1) * 100')} END AS pct,
       CASE WHEN l_discount <> 0 THEN {r('(l_tax / l_discount - 1) * 100')} END AS pct_nonzero FROM lineitem""")
def prj_4(t):
    pct, other = s.change(col("l_discount"), col("l_tax")), s.change_from_nonzero(col("l_tax"), col("l_discount"))
    return t.lineitem.select(*LINE, s.round_half_up(pct).alias("pct"), s.round_half_up(other).alias("pct_nonzero"))


@query("prj_5_clamp", "SELECT c_custkey, least(greatest(c_acctbal / 10000, 0.0), 0.5) AS bounded FROM customer")
def prj_5(t):
    return t.customer.select("c_custkey", s.clamp(col("c_acctbal") / 10_000, 0.0, 0.5).alias("bounded"))


@query("prj_6_candle_flow", f"""
WITH x AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN l_extendedprice * 1.1 ELSE l_quantity * 10 END AS total,
                  CASE WHEN l_linestatus = 'O' THEN l_extendedprice * l_discount * 12 * 1.1 ELSE l_quantity * l_tax * 15 * 10 END AS buy FROM lineitem)
SELECT {LINE_SQL}, CASE WHEN buy <= total * 1.000001 THEN {r('buy')} END AS inflow, CASE WHEN buy <= total * 1.000001 THEN {r('total - buy')} END AS outflow,
       CASE WHEN buy <= total * 1.000001 THEN {r('2 * buy - total')} END AS net FROM x""")
def prj_6(t):
    row = {"quote_volume": col("l_extendedprice"), "taker_quote": col("l_extendedprice") * col("l_discount") * 12, "volume": col("l_quantity"), "taker_base": col("l_quantity") * col("l_tax") * 15}
    flow = s.candle_flow(F.when(col("l_linestatus") == "O", "UM").otherwise("CM"), row, F.lit(1.1), F.lit(10.0))
    return t.lineitem.withColumn("flow", flow).select(*LINE, *(s.round_half_up(col(f"flow.{k}")).alias(k) for k in ("inflow", "outflow", "net")))




def bases(t: Tables):
    """Contract names: parts' names without blanks, with the multipliers that some contracts carry."""
    prefix = F.element_at(F.array(*map(F.lit, ("1000", "1M", "1000000", "", "1"))), (col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", F.concat(prefix, F.upper(F.regexp_replace("p_name", "[^A-Za-z0-9]", ""))).alias("base"))


BASES = "(SELECT p_partkey, ['1000', '1M', '1000000', '', '1'][p_partkey % 5 + 1] || upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS base FROM part)"


@query("prj_7_token_identity", f"""SELECT p_partkey, base, CASE WHEN regexp_matches(base, '^(1000000|1000|1M)([A-Z][A-Z0-9]*)$') THEN regexp_extract(base, '^(1000000|1000|1M)([A-Z][A-Z0-9]*)$', 2) ELSE base END AS token,
       CASE regexp_extract(base, '^(1000000|1000|1M)([A-Z][A-Z0-9]*)$', 1) WHEN '1M' THEN 1e6 WHEN '1000' THEN 1e3 WHEN '1000000' THEN 1e6 ELSE 1e0 END AS multiplier FROM {BASES}""")
def prj_7(t):
    return bases(t).select("p_partkey", "base", s.token(col("base")).alias("token"), s.multiplier(col("base")).alias("multiplier"))


@query("prj_8_unscaled_coin", "SELECT p_partkey, coin, CASE WHEN regexp_matches(coin, '^k[A-Z]') THEN substring(coin, 2) ELSE coin END AS token FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'k' || upper(p_name) WHEN 1 THEN 'k' || lower(p_name) ELSE upper(p_name) END AS coin FROM part)")
def prj_8(t):
    k = col("p_partkey") % 3
    coin = F.when(k == 0, F.concat(F.lit("k"), F.upper("p_name"))).when(k == 1, F.concat(F.lit("k"), F.lower("p_name"))).otherwise(F.upper("p_name"))
    return t.part.select("p_partkey", coin.alias("coin")).withColumn("token", s.unscaled_coin(col("coin")))


@query("prj_9_round_trip_cost", f"SELECT {LINE_SQL}, {r('2 * l_tax / 100 + CASE WHEN l_discount > 0 THEN l_discount * 100 END / 1e4 + 0.0005')} AS cost FROM lineitem")
def prj_9(t):
    return t.lineitem.select(*LINE, s.round_half_up(s.round_trip_cost(col("l_tax") / 100, s.positive(col("l_discount")) * 100, F.lit(0.0005))).alias("cost"))


@query("prj_10_label_k", f"SELECT DISTINCT p_size, {r('sqrt(p_size / 4)')} AS k FROM part")
def prj_10(t):
    return t.part.select("p_size", s.round_half_up(s.barrier_width_k(col("p_size"))).alias("k")).distinct()


BID, ASK = "(l_extendedprice * (1 - l_discount / 100))", "(l_extendedprice * (1 + (l_tax - 0.01) / 100))"


@query("prj_11_spread_bps", f"SELECT {LINE_SQL}, CASE WHEN {ASK} >= {BID} THEN {r(f'({ASK} - {BID}) / (({ASK} + {BID}) / 2) * 10000')} END AS spread_bps FROM lineitem")
def prj_11(t):
    bid, ask = col("l_extendedprice") * (1 - col("l_discount") / 100), col("l_extendedprice") * (1 + (col("l_tax") - 0.01) / 100)
    return t.lineitem.select(*LINE, s.round_half_up(s.spread_bps(bid, ask)).alias("spread_bps"))


@query("prj_12_funding_daily", f"""SELECT {LINE_SQL}, {r("(l_discount - 0.05) * 100 * 24 / CASE WHEN l_returnflag <> 'R' THEN CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber % 3 * 4.0 ELSE 8.0 END END")} AS daily FROM lineitem""")
def prj_12(t):
    daily = s.funding_daily(col("l_discount") - 0.05, (col("l_linenumber") % 3 * 4.0), col("l_returnflag") != "R")
    return t.lineitem.select(*LINE, s.round_half_up(daily).alias("daily"))


@query("prj_13_basis_pct", f"SELECT p_partkey, {r('(p_retailprice * (1 + (p_size - 25) / 1000.0::DOUBLE) / p_retailprice - 1) * 100')} AS basis_pct FROM part")
def prj_13(t):
    return t.part.select("p_partkey", s.round_half_up(s.change(col("p_retailprice") * (1 + (col("p_size") - 25) / 1000.0), col("p_retailprice"))).alias("basis_pct"))


@query("prj_14_open_interest_value", f"""SELECT {LINE_SQL}, {r("CASE WHEN l_linestatus = 'F' THEN l_quantity * CASE WHEN l_tax > 0 THEN l_tax * 1000 END ELSE l_quantity * l_extendedprice * 0.99 END")} AS value FROM lineitem""")
def prj_14(t):
    family = F.when(col("l_linestatus") == "F", "CM").otherwise("UM")
    return t.lineitem.select(*LINE, s.round_half_up(s.open_interest_value(family, col("l_quantity"), col("l_extendedprice"), F.lit(0.99), col("l_tax") * 1000)).alias("value"))


@query("prj_15_estimated_cap", f"""SELECT p.p_partkey, CASE WHEN s.t = 0 AND s.price > 0 THEN {r('p.p_size * 1000 * s.price', 2)} END AS cap
FROM part p LEFT JOIN (SELECT s_suppkey, s_acctbal AS price, s_nationkey % 2 AS t FROM supplier) s ON s.s_suppkey = p.p_partkey % 200""")
def prj_15(t):
    spot = t.supplier.select("s_suppkey", col("s_acctbal").alias("price"), (col("s_nationkey") % 2).alias("t"))
    joined = t.part.join(spot, col("p_partkey") % 200 == col("s_suppkey"), "left")
    return joined.select("p_partkey", F.when((col("t") == 0) & (col("price") > 0), s.round_half_up(col("p_size") * 1000 * col("price"), 2)).alias("cap"))


@query("prj_16_history_too_short", """SELECT p_partkey, 'history too short: needs ' || printf('%.1f', 336 * 3600000.0 / 86400000) || ' days (336 bars), has ' || printf('%.1f', floor(p_size * 3600000.0 / 86400000 * 10 + 0.5) / 10) || ' days (' || p_size || ' bars)' AS reason
FROM part WHERE p_size < 336""")
def prj_16(t):
    return t.part.where("p_size < 336").select("p_partkey", s.history_too_short(col("p_size"), F.lit(336), s.HOUR_MS).alias("reason"))


@query("prj_18_publishable_columns", "SELECT event_id, user_id, event_type, value FROM events")
def prj_18(t):
    return t.events.drop("props", "ts")


@query("prj_19_row_validity", f"""
WITH b AS (SELECT {LINE_SQL}, l_extendedprice AS o, l_extendedprice * (1 + l_discount - 0.02) AS h, l_extendedprice * (1 - l_tax + 0.01) AS l, l_extendedprice * (1 + l_tax - l_discount) AS c FROM lineitem)
SELECT {LINE_SQL}, h + 1e-12 >= greatest(o, c, l) AND l - 1e-12 <= least(o, c, h) AND least(o, h, l, c) > 0 AS valid FROM b""")
def prj_19(t):
    x = t.lineitem.select(*LINE, col("l_extendedprice").alias("o"), (col("l_extendedprice") * (1 + col("l_discount") - 0.02)).alias("h"), (col("l_extendedprice") * (1 - col("l_tax") + 0.01)).alias("l"), (col("l_extendedprice") * (1 + col("l_tax") - col("l_discount"))).alias("c"))
    ok = (col("h") + 1e-12 >= F.greatest("o", "c", "l")) & (col("l") - 1e-12 <= F.least("o", "c", "h")) & (F.least("o", "h", "l", "c") > 0)
    return x.select(*LINE, ok.alias("valid"))


KIND_SQL = """CASE page_id % 8 WHEN 0 THEN 'https://fapi.binance.com/fapi/v1/klines?symbol=A&limit=' || (page_id % 1500) WHEN 1 THEN 'https://dapi.binance.com/dapi/v1/klines?symbol=A&limit=' || (page_id % 1500) WHEN 2 THEN 'https://fapi.binance.com/futures/data/openInterestHist?symbol=A' WHEN 3 THEN 'https://fapi.binance.com/fapi/v1/ticker/24hr'
 WHEN 4 THEN 'https://fapi.binance.com/fapi/v1/premiumIndex?symbol=A' WHEN 5 THEN 'https://dapi.binance.com/dapi/v1/ticker/bookTicker' WHEN 6 THEN 'https://api.binance.com/api/v3/klines?symbol=A' ELSE url END"""


@query("prj_20_request_weight", rf"""WITH u AS (SELECT page_id, {KIND_SQL} AS url FROM pages), x AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, coalesce(nullif(TRY_CAST(nullif(regexp_extract(url, '[?&]limit=([0-9]+)', 1), '') AS INT), 0), 500) AS n, regexp_matches(url, '[?&](symbol|pair)=') AS one FROM u),
f AS (SELECT *, CASE host WHEN 'api.binance.com' THEN 'spot' WHEN 'fapi.binance.com' THEN CASE WHEN starts_with(path, '/futures/data/') THEN 'futures data' ELSE 'linear' END WHEN 'dapi.binance.com' THEN CASE WHEN starts_with(path, '/futures/data/') THEN 'futures data' ELSE 'inverse' END END AS family FROM x)
SELECT page_id, family, CASE WHEN family IS NULL THEN NULL WHEN family = 'spot' THEN 4 WHEN family = 'futures data' THEN 1 WHEN suffix(path, '/klines') THEN CASE WHEN n < 100 THEN 1 WHEN n < 500 THEN 2 WHEN n <= 1000 THEN 5 ELSE 10 END WHEN suffix(path, '/ticker/24hr') THEN CASE WHEN one THEN 1 ELSE 40 END
 WHEN suffix(path, '/premiumIndex') THEN CASE WHEN one THEN 1 ELSE 10 END WHEN suffix(path, '/ticker/bookTicker') THEN CASE WHEN one THEN 2 ELSE 5 END WHEN suffix(path, '/exchangeInfo') THEN 10 ELSE 1 END AS weight FROM f""")
def prj_20(t):
    """Which limit a request counts against, and how much."""
    k, n = col("page_id") % 8, (col("page_id") % 1500).cast("string")
    text = lambda base, more=None: F.concat(F.lit(base), more) if more is not None else F.lit(base)
    url = (
        F.when(k == 0, text("https://fapi.binance.com/fapi/v1/klines?symbol=A&limit=", n)).when(k == 1, text("https://dapi.binance.com/dapi/v1/klines?symbol=A&limit=", n)).when(k == 2, text("https://fapi.binance.com/futures/data/openInterestHist?symbol=A"))
        .when(k == 3, text("https://fapi.binance.com/fapi/v1/ticker/24hr")).when(k == 4, text("https://fapi.binance.com/fapi/v1/premiumIndex?symbol=A")).when(k == 5, text("https://dapi.binance.com/dapi/v1/ticker/bookTicker")).when(k == 6, text("https://api.binance.com/api/v3/klines?symbol=A")).otherwise(col("url"))
    )
    family, weight = s.request_cost(url)
    return t.pages.select("page_id", family.alias("family"), weight.alias("weight"))


def forecast(t: Tables):
    """Three class probabilities from embeddings, each class scored by the mean of a third of the dimensions, and the class as the label modulo 3."""
    value = lambda k: F.aggregate(F.filter("embedding", lambda x, i: i % 3 == k), F.lit(0.0), lambda a, x: a + x.cast("double"))
    z = F.array(*(F.exp(value(k) / 8) for k in range(3)))
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select("vec_id", F.transform(z, lambda x: x / total).alias("p"), (col("label") % 3).alias("y"), (col("vec_id") % 3 + 1).cast("double").alias("w"))


FORECAST_SQL = f"""f AS (SELECT vec_id, [z[1] / (z[1] + z[2] + z[3]), z[2] / (z[1] + z[2] + z[3]), z[3] / (z[1] + z[2] + z[3])] AS p, label % 3 AS y, CAST(vec_id % 3 + 1 AS DOUBLE) AS w
  FROM (SELECT vec_id, label, [{", ".join(f"exp(list_sum(list_transform(range({k}, 65, 3), lambda i: embedding[i]::DOUBLE)) / 8)" for k in (1, 2, 3))}] AS z FROM embeddings))"""


@query("prj_22_prior_shift", f"""WITH {FORECAST_SQL}, q AS (SELECT vec_id, [p[1] * 0.5, p[2] * 2, p[3] * 1.5] AS q FROM f)
SELECT vec_id, {r('q[1] / (q[1] + q[2] + q[3])')} AS p0, {r('q[2] / (q[1] + q[2] + q[3])')} AS p1, {r('q[3] / (q[1] + q[2] + q[3])')} AS p2 FROM q""")
def prj_22(t):
    q = s.prior_shift(col("p"), F.array(F.lit(0.5), F.lit(2.0), F.lit(1.5)))
    return forecast(t).select("vec_id", *(s.round_half_up(q[i]).alias(f"p{i}") for i in range(3)))


@query("prj_23_brier_term", f"""WITH {FORECAST_SQL} SELECT vec_id, {r('pow(p[1] - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2) + pow(p[2] - CASE WHEN y = 1 THEN 1 ELSE 0 END, 2) + pow(p[3] - CASE WHEN y = 2 THEN 1 ELSE 0 END, 2)')} AS brier FROM f""")
def prj_23(t):
    return forecast(t).select("vec_id", s.round_half_up(s.brier_term(col("p"), col("y"))).alias("brier"))


# --- filters


@query("flt_2_finite", f"SELECT count(*) AS n FROM (SELECT {NUMBER_SQL} AS x FROM orders) WHERE x IS NOT NULL")
def flt_2(t):
    return text_number(t).where(s.finite(col("raw").try_cast("double")).isNotNull()).agg(F.count("*").alias("n"))


@query("flt_4_universe", "SELECT 'linear' AS family, s_suppkey AS symbol FROM supplier WHERE s_acctbal > 0 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'inverse', -c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def flt_4(t):
    """Members of two families that trade; one that is in both stops the job."""
    region = t.nation.where("n_regionkey = 1")
    linear = t.supplier.join(region, col("s_nationkey") == col("n_nationkey"), "left_semi").select(F.lit("linear").alias("family"), col("s_suppkey").alias("symbol"), (col("s_acctbal") > 0).alias("trading"))
    inverse = t.customer.where("c_mktsegment = 'BUILDING'").select(F.lit("inverse").alias("family"), (-col("c_custkey")).alias("symbol"), (col("c_acctbal") > 0).alias("trading"))
    return universe(linear.unionByName(inverse)).select("family", "symbol")


@query("flt_5_perpetual_symbols", "SELECT p_partkey, symbol FROM (SELECT p_partkey, upper(p_name) || CASE p_partkey % 5 WHEN 0 THEN 'USDT' WHEN 1 THEN 'USDT_240628' WHEN 2 THEN 'USD_PERP' WHEN 3 THEN 'USDC' ELSE 'XUSDT' END AS symbol FROM part) WHERE regexp_matches(symbol, 'USDT$') AND NOT regexp_matches(symbol, '_[0-9]{6}$')")
def flt_5(t):
    k = col("p_partkey") % 5
    suffix = F.when(k == 0, "USDT").when(k == 1, "USDT_240628").when(k == 2, "USD_PERP").when(k == 3, "USDC").otherwise("XUSDT")
    names = t.part.select("p_partkey", F.concat(F.upper("p_name"), suffix).alias("symbol"))
    return names.where(col("symbol").rlike("USDT$") & ~col("symbol").rlike("_[0-9]{6}$"))


@query("flt_6_listed_before", "SELECT o_custkey, min(o_orderdate) <= TIMESTAMP '1995-01-01' AS seasoned FROM orders GROUP BY 1 HAVING min(o_orderdate) <= TIMESTAMP '1995-01-01'")
def flt_6(t):
    """Members whose first day is at least thirty days before the start of the study (1995-01-31)."""
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    return first.where(col("first") <= F.expr("TIMESTAMP_NTZ '1995-01-31' - INTERVAL 30 DAY")).select("o_custkey", F.lit(True).alias("seasoned"))


NOW_MS = 1_706_400_000_000  # 2024-01-28T00:00Z


@query("flt_8_freshness", f"SELECT event_id, {', '.join(f'(epoch_us(ts) // 1000) <= {NOW_MS} + {ahead} AND {NOW_MS} - (epoch_us(ts) // 1000) <= {h} * 3600000 AS fresh{h}' for h, ahead in ((6, 60000), (12, 300000), (48, 300000)))} FROM events")
def flt_8(t):
    at = F.unix_millis(col("ts").cast("timestamp"))
    fresh = lambda hours, ahead: (at <= NOW_MS + ahead) & (NOW_MS - at <= hours * s.HOUR_MS)
    return t.events.select("event_id", *(fresh(h, ahead).alias(f"fresh{h}") for h, ahead in ((6, 60_000), (12, 300_000), (48, 300_000))))


@query("flt_10_raw_posts", f"SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id IS NOT NULL AND (epoch_us(ts) // 1000) <= {NOW_MS} AND (epoch_us(ts) // 1000) >= {NOW_MS} - 24 * 3600000")
def flt_10(t):
    at = F.unix_millis(col("ts").cast("timestamp"))
    posts = t.events.where((col("event_type") == "click") & col("user_id").isNotNull() & (at <= NOW_MS) & (at >= NOW_MS - s.DAY_MS))
    return posts.dropDuplicates(["event_id"]).select("event_id", "user_id")


VIEWS_SQL = """SELECT 'indicators' AS view, p_partkey AS id FROM part WHERE p_size >= 10 AND list_contains(string_split(p_type, ' '), 'PROMO') AND p_retailprice > 900 AND contains(lower(p_name), 'e')
UNION ALL SELECT 'copy', c_custkey FROM customer WHERE c_acctbal > 3000 AND c_mktsegment = 'BUILDING' AND (contains(lower(c_name), '1') OR contains(c_custkey::VARCHAR, '1'))
UNION ALL SELECT 'square', doc_id FROM documents WHERE lang = 'en' AND source IS NOT NULL AND n_chars > 1000 AND contains(lower(text), 'a')
UNION ALL SELECT 'cross', o_orderkey FROM orders WHERE CASE o_custkey % 3 WHEN 0 THEN o_orderstatus = 'F' WHEN 1 THEN o_orderstatus <> 'F' ELSE o_totalprice > 200000 END"""


@query("flt_11_view_filters", VIEWS_SQL)
def flt_11(t):
    """What each of the four views lets through: by state, tag or kind, and by the text searched for."""
    parts = t.part.where((col("p_size") >= 10) & F.array_contains(F.split("p_type", " "), "PROMO") & (col("p_retailprice") > 900) & F.lower("p_name").contains("e")).select(F.lit("indicators").alias("view"), col("p_partkey").alias("id"))
    copy = t.customer.where((col("c_acctbal") > 3000) & (col("c_mktsegment") == "BUILDING") & (F.lower("c_name").contains("1") | col("c_custkey").cast("string").contains("1"))).select(F.lit("copy").alias("view"), col("c_custkey").alias("id"))
    square = t.documents.where((col("lang") == "en") & col("source").isNotNull() & (col("n_chars") > 1000) & F.lower("text").contains("a")).select(F.lit("square").alias("view"), col("doc_id").alias("id"))
    k = col("o_custkey") % 3
    cross = t.orders.where(F.when(k == 0, col("o_orderstatus") == "F").when(k == 1, col("o_orderstatus") != "F").otherwise(col("o_totalprice") > 200_000)).select(F.lit("cross").alias("view"), col("o_orderkey").alias("id"))
    return parts.unionByName(copy).unionByName(square).unionByName(cross)


@query("flt_13_decision_eligible", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_quantity, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM lineitem) WHERE NOT (l_linenumber = last AND l_quantity < 10)")
def flt_13(t):
    """All bars but the last one of a series if that is partial."""
    from pyspark.sql import Window

    last = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return t.lineitem.withColumn("last", last).where(~((col("l_linenumber") == col("last")) & (col("l_quantity") < 10))).select(*LINE)


# --- text, dates, maths, arrays


@query("str_1_plain_text", r"SELECT page_id, md5(trim(regexp_replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\{(?:future|spot)\}\([^)]*\)', ' ', 'g'))) AS digest FROM pages")
def str_1(t):
    return t.pages.select("page_id", F.md5(s.plain_text(col("html"))).alias("digest"))


@query("str_2_mentions", r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[\n。.!！]'), lambda x: regexp_matches(x, '(?i)(^|[^A-Za-z0-9])\$?the([^A-Za-z0-9]|$)')), ' ') AS local FROM documents")
def str_2(t):
    return t.documents.select("doc_id", s.mentions(col("text"), "the").alias("local"))


BULL, BEAR, UNCLEAR = (x.replace("(?i)", "") for x in (s.BULLISH, s.BEARISH, s.UNCLEAR))


@query("str_3_direction", rf"""WITH x AS (SELECT 'conversation' AS kind, conv_id AS id, turn, text FROM conversations UNION ALL SELECT 'document', doc_id, 0, text FROM documents), y AS (SELECT *, regexp_matches(text, '{BULL}', 'i') AS up, regexp_matches(text, '{BEAR}', 'i') AS down, regexp_matches(text, '{UNCLEAR.replace("'", "''")}', 'i') AS unclear FROM x)
SELECT kind, id, turn, CASE WHEN unclear OR up = down THEN 0 WHEN up THEN 1 WHEN text IS NOT NULL THEN -1 END AS direction FROM y""")
def str_3(t):
    """Which side each text takes, of all turns and documents."""
    x = t.conversations.select(F.lit("conversation").alias("kind"), col("conv_id").alias("id"), col("turn").cast("long"), "text")
    x = x.unionByName(t.documents.select(F.lit("document").alias("kind"), col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text"))
    return x.select("kind", "id", "turn", F.when(col("text").isNotNull(), s.direction(col("text"))).alias("direction"))


@query("str_4_normal_text", r"SELECT conv_id, turn, md5(lower(regexp_replace(trim(text), '\s+', ' ', 'g'))) AS digest FROM conversations")
def str_4(t):
    return t.conversations.select("conv_id", "turn", F.md5(s.normal_text(col("text"))).alias("digest"))


@query("str_5_substring_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ar')")
def str_5(t):
    return t.part.where(F.lower("p_name").contains("ar")).select("p_partkey")


@query("str_6_reason_text", "SELECT c_custkey, c_name || ': ' || CASE WHEN c_acctbal > 0 THEN '+' ELSE '' END || printf('%.2f', c_acctbal) || '%' AS reason FROM customer")
def str_6(t):
    return t.customer.select("c_custkey", F.concat("c_name", F.lit(": "), F.when(col("c_acctbal") > 0, "+").otherwise(""), F.format_string("%.2f", "c_acctbal"), F.lit("%")).alias("reason"))


@query("str_7_address", "SELECT c_custkey, c_custkey % 3 <> 0 AS ok FROM customer")
def str_7(t):
    address = F.concat(F.lit("0x"), F.lpad(F.hex("c_custkey"), 40, "a"), F.when(col("c_custkey") % 3 == 0, "g").otherwise(""))
    return t.customer.select("c_custkey", s.is_address(address).alias("ok"))


@query("str_8_csv_quoting", """SELECT event_id, '"' || replace(props, '"', '""') || '"' AS field FROM events""")
def str_8(t):
    return t.events.select("event_id", s.csv_quoted(col("props")).alias("field"))


@query("str_9_digits_masked", r"SELECT regexp_replace(url, '[0-9]+(\.[0-9]+)?', '#', 'g') AS shape, count(*) AS n FROM pages GROUP BY 1")
def str_9(t):
    return t.pages.groupBy(s.digits_masked(col("url")).alias("shape")).agg(F.count("*").alias("n"))


@query("str_10_prompt_text", r"""WITH k AS (SELECT conv_id, max(regexp_extract(text, '[A-Za-z]{6,}')) AS key FROM conversations WHERE turn = 0 GROUP BY 1)
SELECT c.conv_id, string_agg(coalesce(role, '') || ': ' || CASE WHEN coalesce(key, '') = '' THEN coalesce(text, '') ELSE replace(coalesce(text, ''), key, '***') END, chr(10) ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS prompt
FROM conversations c LEFT JOIN k USING (conv_id) GROUP BY 1""")
def str_10(t):
    """The text that goes out for a conversation: its turns in order, a line each, without the key of that conversation, which a table of keys has (here a word of the first turn)."""
    keys = t.conversations.where("turn = 0").groupBy("conv_id").agg(F.max(F.regexp_extract("text", "[A-Za-z]{6,}", 0)).alias("key"))
    return s.prompts(t.conversations, keys, "conv_id", "turn")


@query("dat_1_floor", "SELECT event_id, (epoch_us(ts) // 1000) // 3600000 * 3600000 AS hour, (epoch_us(ts) // 1000) // 14400000 * 14400000 AS h4, (epoch_us(ts) // 1000) // 86400000 * 86400000 AS day FROM events")
def dat_1(t):
    at = F.unix_millis(col("ts").cast("timestamp"))
    return t.events.select("event_id", *(s.floor_to(at, step).alias(name) for name, step in (("hour", s.HOUR_MS), ("h4", 4 * s.HOUR_MS), ("day", s.DAY_MS))))


@query("dat_2_hour_slot", "SELECT (epoch_us(ts) // 1000) // 3600000 % 24 AS slot, count(*) AS n FROM events GROUP BY 1")
def dat_2(t):
    return t.events.groupBy(s.utc_hour(F.unix_millis(col("ts").cast("timestamp"))).alias("slot")).agg(F.count("*").alias("n"))


@query("dat_3_month_quarter", "SELECT strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY 1, 2")
def dat_3(t):
    month, quarter = F.date_format("o_orderdate", "yyyy-MM"), F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    return t.orders.groupBy(month.alias("month"), quarter.alias("quarter")).agg(F.count("*").alias("n"))


@query("dat_4_month_range", "SELECT o_custkey, strftime(m, '%Y-%m') AS month FROM (SELECT o_custkey, unnest(range(date_trunc('month', min(o_orderdate)), max(o_orderdate) + INTERVAL 1 MICROSECOND, INTERVAL 1 MONTH)) AS m FROM orders GROUP BY 1)")
def dat_4(t):
    """The months from a member's first to last day, over year ends; none if the range is inverted."""
    x = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    months = F.when(col("a") <= col("b"), F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH")))
    return x.select("o_custkey", F.explode(months).alias("m")).select("o_custkey", F.date_format("m", "yyyy-MM").alias("month"))


@query("dat_5_iso_age", f"SELECT event_id, {r(f'greatest(0, ({NOW_MS} - (epoch_us(ts) // 1000) // 1000 * 1000) / 86400000.0::DOUBLE)')} AS age_days FROM events")
def dat_5(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = F.unix_millis(F.try_to_timestamp(iso))
    return t.events.select("event_id", s.round_half_up(F.greatest(F.lit(0.0), (NOW_MS - at) / float(s.DAY_MS))).alias("age_days"))


@query("dat_6_aligned", "SELECT event_id, (epoch_us(ts) // 1000) % 60000 = 0 AS aligned FROM events")
def dat_6(t):
    return t.events.select("event_id", (F.unix_millis(col("ts").cast("timestamp")) % 60_000 == 0).alias("aligned"))


@query("mth_1_functions", f"""SELECT p_partkey, {r('ln(p_retailprice)')} AS ln, {r('ln(1 + p_size)')} AS log1p, {r('log10(p_retailprice)')} AS log10, {r('exp(-p_size / 10.0::DOUBLE)')} AS e,
{r('tanh(p_size / 25.0::DOUBLE)')} AS tanh, {r('sqrt(p_retailprice)')} AS root, {r('pow(p_size, 1.5)')} AS power, CAST(sign(p_size - 25) AS INT) AS sign, abs(p_size - 25) AS distance FROM part""")
def mth_1(t):
    n = col("p_size")
    f = {"ln": F.log("p_retailprice"), "log1p": F.log1p(n), "log10": F.log10("p_retailprice"), "e": F.exp(-n / 10.0), "tanh": F.tanh(n / 25.0), "root": F.sqrt("p_retailprice"), "power": F.pow(n, F.lit(1.5))}
    return t.part.select("p_partkey", *(s.round_half_up(v).alias(k) for k, v in f.items()), F.signum(n - 25).cast("int").alias("sign"), F.abs(n - 25).alias("distance"))


@query("mth_2_extremes", "SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS high, CAST(list_min(embedding) AS DOUBLE) AS low FROM embeddings")
def mth_2(t):
    return t.embeddings.select("vec_id", F.array_max("embedding").cast("double").alias("high"), F.array_min("embedding").cast("double").alias("low"))


@query("mth_3_close_to", f"SELECT {LINE_SQL}, abs(l_discount - l_tax) <= 0.02 * greatest(1.0, abs(l_discount), abs(l_tax)) AS close FROM lineitem")
def mth_3(t):
    return t.lineitem.select(*LINE, s.close_to(col("l_discount"), col("l_tax"), 0.02).alias("close"))


@query("arr_1_higher_order", f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings)
SELECT vec_id, CAST(len(list_filter(e, lambda a: a > 0)) AS BIGINT) AS positives, {r('list_sum(e)', 4)} AS total, {r('e[len(e)]')} AS last, {r('list_sum(e[1:4])', 4)} AS head, list_bool_or(list_transform(e, lambda a: a > 2)) AS any_high, list_bool_and(list_transform(e, lambda a: a > -5)) AS all_above FROM x""")
def arr_1(t):
    e = F.transform("embedding", lambda a: a.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    x = t.embeddings.select("vec_id", e.alias("e"))
    return x.select(
        "vec_id", F.size(F.filter("e", lambda a: a > 0)).cast("long").alias("positives"), s.round_half_up(total(col("e")), 4).alias("total"), s.round_half_up(F.element_at("e", -1)).alias("last"),
        s.round_half_up(total(F.slice("e", 1, 4)), 4).alias("head"), F.exists("e", lambda a: a > 2).alias("any_high"), F.forall("e", lambda a: a > -5).alias("all_above"),
    )


@query("arr_2_distinct_in_order", "SELECT user_id, array_to_string(list(event_type ORDER BY first), ',') AS kinds FROM (SELECT user_id, event_type, min(struct_pack(ts := ts, id := event_id)) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def arr_2(t):
    """A user's kinds of events in the order of their first; of each kind only the first event is kept, so lists are as long as there are kinds."""
    first = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))


@query("arr_3_pairs_to_map", f"SELECT c_nationkey, {r('avg(c_acctbal) FILTER (c_mktsegment = ' + chr(39) + 'BUILDING' + chr(39) + ')')} AS building, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1")
def arr_3(t):
    by = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("a"))
    m = by.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "a"))).alias("m"))
    return m.select("c_nationkey", s.round_half_up(F.try_element_at("m", F.lit("BUILDING"))).alias("building"), F.size(F.map_keys("m")).cast("long").alias("segments"))


@query("arr_4_explode", f"SELECT vec_id, CAST(i - 1 AS INT) AS i, {r('embedding[i]::DOUBLE')} AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def arr_4(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", s.round_half_up(col("x").cast("double")))


@query("map_1_entries", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS entries FROM (SELECT user_id, event_type, 10 * count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def map_1(t):
    by = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    entries = F.array_sort(F.map_entries(F.transform_values("m", lambda k, v: v * 10)))
    return by.select("user_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("entries"))


@query("map_2_reason_counters", "SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount = 0 THEN 'no discount' END, CASE WHEN l_tax = 0 THEN 'no tax' END, CASE WHEN l_quantity < 5 THEN 'small' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY 1")
def map_2(t):
    reasons = F.array(F.when(col("l_discount") == 0, "no discount"), F.when(col("l_tax") == 0, "no tax"), F.when(col("l_quantity") < 5, "small"))
    return t.lineitem.select(F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("jsn_1_nested_access", f"SELECT event_id, {K} AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def jsn_1(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.a.b").alias("missing"))


@query("jsn_2_signature", """SELECT n_regionkey, string_agg('{"n":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) AS signature FROM nation GROUP BY 1""")
def jsn_2(t):
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    text = F.array_join(F.transform(rows, lambda x: F.to_json(F.struct(x["n_nationkey"].alias("n"), x["n_name"].alias("name")))), ",")
    return t.nation.groupBy("n_regionkey").agg(text.alias("signature"))


@query("jsn_3_version_guard", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0")
def jsn_3(t):
    """Only documents of the expected schema and rule version."""
    doc = F.to_json(F.struct(F.when(col("o_orderkey") % 4 == 0, 2).otherwise(1).alias("schemaVersion"), F.lit("v1").alias("ruleVersion")))
    parsed = F.from_json(doc, "schemaVersion int, ruleVersion string")
    return t.orders.where((parsed["schemaVersion"] == 1) & (parsed["ruleVersion"] == "v1")).select("o_orderkey")
