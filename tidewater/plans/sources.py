"""Queries that write files and read them again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import HOUR_MS, round_half_up, to_number
from ..operators import bars as b
from ..operators.scale import shared_folder
from ..sources import files as f
from ..sources import pages
from .registry import bars_sql, query, r

H4 = 4 * HOUR_MS
col = F.col
r6 = round_half_up
BARS4 = bars_sql(H4)


def raw_rows(t, every: bool = False):
    """Bars as the positional text rows of an archive."""
    x = b.from_events(t.events, H4, F.lit("ALL") if every else None)
    text = lambda c: c.cast("string")
    return x.select(
        "symbol", text(col("t")).alias("open_time"), text(col("o")).alias("open"), text(col("h")).alias("high"), text(col("l")).alias("low"), text(col("c")).alias("close"), text(col("v")).alias("volume"),
        text(col("t") + H4 - 1).alias("close_time"), text(col("v")).alias("quote_volume"), text(col("trades")).alias("trades"), text(col("tb")).alias("taker_base"), text(col("tb")).alias("taker_quote"), F.lit("0").alias("ignore"),
    )


@query("src_1_klines_csv", f"WITH {bars_sql(H4, every=True)} SELECT t, o, h, l, c, trades FROM bars")
def src_1(t):
    path = shared_folder(t.spark)
    raw_rows(t, every=True).drop("symbol").write.option("header", True).csv(path)
    x = f.klines_csv(t.spark, path)
    return x.select(col("open_time").cast("long").alias("t"), *(col(n).cast("double").alias(k) for n, k in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"))), col("trades").cast("long"))


@query("src_2_funding_csv", f"WITH {bars_sql(H4, every=True)} SELECT t AS time, 4 AS hours, {r('(c - 50) / 100000', 9)} AS rate FROM bars")
def src_2(t):
    path = shared_folder(t.spark)
    b.from_events(t.events, H4, F.lit("ALL")).select(col("t").alias("calc_time"), F.lit(4).alias("hours"), ((col("c") - 50) / 100_000).alias("rate")).write.option("header", True).csv(path)
    return f.funding_csv(t.spark, path).withColumn("rate", r6(col("rate"), 9))


#: A series document holds this much of a series.
BLOCK_MS = 10 * 24 * HOUR_MS


def write_series(t, path: str) -> None:
    """Documents of at most ten days of a symbol's candles, a file each."""
    row = F.array(*(F.coalesce(c, F.lit("")) for c in map(col, b.RAW)))
    x = raw_rows(t).withColumn("start", F.floor(col("open_time").cast("long") / BLOCK_MS) * BLOCK_MS)
    docs = x.groupBy("symbol", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("open_time", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    docs = docs.select("symbol", F.lit("4h").alias("interval"), "start", (col("start") + BLOCK_MS).alias("end"), F.lit("native").alias("source"), "rows")
    docs.write.option("maxRecordsPerFile", 1).json(path)


@query("src_3_series_json", f"WITH {BARS4} SELECT symbol, t, o, c, row_number() OVER (PARTITION BY symbol, t // {BLOCK_MS} ORDER BY t) - 1 AS i FROM bars")
def src_3(t):
    path = shared_folder(t.spark)
    write_series(t, path)
    series = f.series_rows(f.series_json(t.spark, path))
    return series.select("symbol", col("open_time").cast("long").alias("t"), col("open").cast("double").alias("o"), col("close").cast("double").alias("c"), col("i").cast("long"))


@query("src_4_tolerant_scan", "SELECT count(*) AS readable, count(*) AS named, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) AS unreadable FROM nation WHERE n_nationkey % 5 <> 0")
def src_4(t):
    """Documents that can't be read are counted."""
    path = shared_folder(t.spark)
    text = F.when(col("n_nationkey") % 5 == 0, '{"symbol": "broken').otherwise(F.to_json(F.struct(col("n_name").alias("symbol"))))
    t.nation.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return f.series_json(t.spark, path).agg(F.count_if(col("_corrupt").isNull()).alias("readable"), F.count("symbol").alias("named"), F.count_if(col("_corrupt").isNotNull()).alias("unreadable"))


@query("src_5_latest_run", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def src_5(t):
    folder = shared_folder(t.spark)
    for region in (1, 2):
        f.publish(t.nation.where(col("n_regionkey") == region).select("n_nationkey", "n_name"), folder, f"run-{region}")
    return f.latest(t.spark, folder)


@query("snk_1_publish", "SELECT count(*) AS n, 2 AS pointers FROM nation WHERE n_regionkey = 2")
def snk_1(t):
    """Two runs published one after the other: readers are at the second, and the pointer to the first was never taken away."""
    folder = shared_folder(t.spark)
    for region in (1, 2):
        f.publish(t.nation.where(col("n_regionkey") == region).select("n_nationkey"), folder, f"run-{region}")
    pointers = t.spark.read.schema("run string").json(f"{folder}/latest-*.json").agg(F.count("*").cast("int").alias("pointers"))  # one row
    return f.latest(t.spark, folder).agg(F.count("*").alias("n")).join(F.broadcast(pointers))


SNAPSHOT = "id string, cutoff long, contracts array<struct<symbol:string,family:string,ticker:struct<last:string,volume:string>,book:struct<bid:string,ask:string>>>"


@query("src_6_snapshot_ingest", f"""SELECT p_brand AS id, p_partkey AS symbol, CASE WHEN p_partkey % 7 <> 0 THEN {r('p_retailprice', 4)} END AS last, CASE WHEN p_partkey % 5 <> 0 THEN {r('p_retailprice * 0.999::DOUBLE', 4)} END AS bid FROM part""")
def src_6(t):
    """Landed documents of a collector, one for each run, with what each endpoint gave for each contract; absent answers stay null."""
    path = shared_folder(t.spark)
    text = lambda c, on: F.when(on, c.cast("string"))
    last, bid = r6(col("p_retailprice"), 4), r6(col("p_retailprice") * 0.999, 4)
    contract = F.struct(
        col("p_partkey").cast("string").alias("symbol"), F.lit("UM").alias("family"), F.struct(text(last, col("p_partkey") % 7 != 0).alias("last")).alias("ticker"),
        F.when(col("p_partkey") % 5 != 0, F.struct(text(bid, F.lit(True)).alias("bid"))).alias("book"),
    )
    block = F.floor(col("p_partkey") / 1000)  # a run's document has a thousand contracts at most
    t.part.groupBy(col("p_brand").alias("id"), block.alias("block")).agg(F.collect_list(contract).alias("contracts")).drop("block").write.json(path)
    x = f.ndjson(t.spark, path, SNAPSHOT).select("id", F.explode("contracts").alias("c"))
    return x.select("id", col("c.symbol").cast("long").alias("symbol"), to_number(col("c.ticker.last")).alias("last"), to_number(col("c.book.bid")).alias("bid"))


@query("src_7_page_requests", f"""WITH {bars_sql(HOUR_MS)}, e AS (SELECT symbol, min(t) AS a, max(t) AS z FROM bars GROUP BY 1), x AS (SELECT symbol, t, t - a AS d, a FROM bars JOIN e USING (symbol) WHERE t < z)
SELECT symbol, t, a + CASE WHEN d > 0 AND d % 36000000 = 0 THEN d // 36000000 - 1 ELSE d // 36000000 END * 36000000 AS "from", CASE WHEN d > 0 AND d % 36000000 = 0 THEN 2 ELSE 1 END AS fetched, row_number() OVER (PARTITION BY symbol ORDER BY t) AS place FROM x""")
def src_7(t):
    """Rows of a range that is fetched by pages of ten hours: the request that brought each first, how often it came, and its place in the whole."""
    bars = b.from_events(t.events, HOUR_MS).select("symbol", "t")
    starts = bars.groupBy("symbol").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    rows = f.paged_rows(bars.join(starts, "symbol"), 10, HOUR_MS)
    requests = f.pages_of(starts, 10, HOUR_MS).join(starts.select("symbol", "start"), "symbol").withColumn("page", F.floor((col("from") - col("start")) / (10 * HOUR_MS)))
    return rows.join(requests, ["symbol", "page"]).select("symbol", "t", "from", "fetched", col("place").cast("long"))


@query("src_7_collected_pages", f"WITH {bars_sql(HOUR_MS)} SELECT symbol, t, c AS v FROM bars")
def src_7_pages(t):
    """Bars that landed as pages with repeated edges, read as a stream that is stopped and started: each once."""
    folder = shared_folder(t.spark)
    bars = b.from_events(t.events, HOUR_MS).select("symbol", "t", col("c").alias("v"))
    pages.register(t.spark)
    for since, until in ((0, 3), (3, None)):  # the first run ends after three pages of a hundred hours
        pages.land(bars, f"{folder}/pages", 100, HOUR_MS, since, until)
        q = t.spark.readStream.format("pages").load(f"{folder}/pages").writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return t.spark.read.schema(pages.SCHEMA).parquet(f"{folder}/out")


@query("src_8_ndjson", "SELECT n_nationkey, n_name FROM nation")
def src_8(t):
    path = shared_folder(t.spark)
    f.append_ndjson(t.nation.where("n_nationkey < 10").select("n_nationkey", "n_name"), path)
    f.append_ndjson(t.nation.where("n_nationkey >= 10").select("n_nationkey", "n_name"), path)
    return f.ndjson(t.spark, path, "n_nationkey int, n_name string")


@query("snk_3_append", "SELECT count(*) AS n FROM nation")
def snk_3(t):
    return src_8(t).agg(F.count("*").alias("n"))


@query("src_9_table_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def src_9(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("snk_4_insert", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def snk_4(t):
    path = shared_folder(t.spark)
    for half in (0, 1):
        f.append_rows(t.nation.where(col("n_nationkey") % 2 == half), path)
    return t.spark.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("src_10_listing", "SELECT p_name AS symbol, '2024-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') AS month, count(*) AS n FROM part GROUP BY 1, 2")
def src_10(t):
    key = F.concat(F.lit("<Contents><Key>data/klines/"), "p_name", F.lit("-2024-"), F.lpad((col("p_size") % 12 + 1).cast("string"), 2, "0"), F.lit(".zip</Key></Contents>"))
    pages = t.part.groupBy(F.floor(col("p_partkey") / 1000).alias("page")).agg(F.array_join(F.collect_list(key), "").alias("xml"))
    return pages.select(F.explode(f.listing(col("xml"))).alias("x")).groupBy("x.symbol", "x.month").agg(F.count("*").alias("n"))


@query("src_11_symbol_list", r"""WITH x AS (SELECT p_partkey, unnest([upper(replace(p_name, ' ', '_')), 'BTC', '1000' || regexp_extract(upper(p_brand), '^[^#]*')]) AS s FROM part) SELECT DISTINCT p_partkey, s AS symbol FROM x WHERE regexp_full_match(s, '[\p{L}\p{N}_]{2,40}')""")
def src_11(t):
    """The names in the lists that come with each part: comments and what is no name left out, each once."""
    name = F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))
    text = F.concat(name, F.lit(",  BTC # majors, NOT_THIS\n1000"), F.upper("p_brand"), F.lit("\nBTC x bad-name"))
    return t.part.select("p_partkey", F.explode(f.symbols(text)).alias("symbol"))


@query("src_12_verified_read", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_nationkey = 24 THEN 'missing' WHEN n_nationkey % 6 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM nation) GROUP BY 1")
def src_12(t):
    path = shared_folder(t.spark)
    t.nation.where("n_nationkey < 24").select("n_name", col("n_nationkey").alias("k")).repartition(24, "k").write.partitionBy("k").text(path)
    published = f.manifest(t.spark, path)
    changed = F.regexp_extract("name", "k=([0-9]+)", 1).cast("int") % 6 == 0
    sums = published.where(~col("name").startswith("_")).select("name", F.when(changed, F.lit("0" * 64)).otherwise(col("sha256")).alias("sha256"))
    sums = sums.unionByName(t.spark.createDataFrame([("gone.txt", "0" * 64)], "name string, sha256 string"))
    return f.verified(t.spark, path, sums).groupBy("status").agg(F.count("*").alias("n"))


@query("src_13_provenance", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def src_13(t):
    x = t.orders.where("o_orderstatus = 'F'").withColumn("source", F.when(col("o_orderstatus") == "F", "native"))
    return f.with_provenance(x, "native").where("source is not null").agg(F.count("*").alias("n"))


@query("snk_2_quoted_csv", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def snk_2(t):
    path = shared_folder(t.spark)
    f.write_quoted_csv(t.customer.select("c_custkey", "c_name", "c_mktsegment"), path)
    return t.spark.read.schema("c_custkey long, c_name string, c_mktsegment string").option("header", True).option("escape", '"').csv(path)


@query("snk_6_manifest")
def snk_6(t):
    """Sizes and checksums of a run's files, with a written report on its first rows and the counts of its summary."""
    folder = shared_folder(t.spark)
    f.publish(t.region.coalesce(1), folder, "run-1")
    summary = t.region.agg(F.count("*").alias("rows"), F.countDistinct("r_name").alias("names"))  # one row
    f.write_text(t.spark, f.report(t.region.orderBy("r_regionkey").limit(10).collect(), "Regions"), f"{folder}/runs/report.md")
    m = f.manifest(t.spark, f"{folder}/runs").where(col("name").endswith(".parquet") | col("name").endswith(".md"))
    return m.select(F.regexp_extract("name", "([^.]+)$", 1).alias("kind"), "bytes", "sha256").join(F.broadcast(summary))


@query("snk_7_run_lock", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def snk_7(t):
    """Two runs that would append the same counts: the second stops at the lock of the first, so they are there once."""
    folder = shared_folder(t.spark)

    def run(inside=None):
        with f.RunLock(t.spark, f"{folder}/run.lock"):
            t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).write.mode("append").parquet(f"{folder}/out")
            if inside:
                inside()

    def second():
        try:
            run()
        except Exception:  # noqa: BLE001 - the file system's own
            return
        raise RuntimeError("two runs at once")

    run(second)
    return t.spark.read.schema("o_orderpriority string, n long").parquet(f"{folder}/out")


#: Files of delisted contracts, made of bars and orders: candles by the hour and by four, settlements, and what the plan says of each.
BATCH_SQL = f"""one AS (SELECT o_custkey % 60 AS k, o_orderkey AS t, o_orderdate FROM orders), f1 AS (SELECT k, count(*) AS n, CASE WHEN k % 11 = 4 THEN 1 ELSE 0 END AS unordered, max(t) AS last FROM one GROUP BY 1),
p AS (SELECT k, n, unordered, last, CASE WHEN k % 13 = 5 THEN 'aggregated' ELSE 'native' END AS source, CASE WHEN k % 3 = 0 THEN last - 1 END AS delivery, CASE WHEN k % 7 = 0 THEN 'signature' WHEN k % 7 = 1 THEN 'trailing' WHEN k % 7 = 2 THEN NULL ELSE 'delivery' END AS cut_by, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 10 = 0 THEN last - 4 ELSE last END END AS partial, k % 10 = 5 AND k % 15 = 5 AS partial_eligible,
 CASE WHEN k % 4 <> 1 THEN CASE WHEN k % 17 = 2 THEN 0 ELSE n // 4 END END AS n4, CASE WHEN k % 19 = 3 THEN 'aggregated' ELSE 'native' END AS source4, k % 23 = 6 AS partial4, CASE WHEN k % 9 <> 2 THEN last - CASE WHEN k % 8 = 3 THEN 0 ELSE 2 END END AS funding_last FROM f1)"""
PROBLEMS = {
    "source of the candles": "source <> 'native'", "no candles": "n = 0", "candles out of order": "unordered > 0", "delivery planned but cut otherwise": "delivery IS NOT NULL AND cut_by NOT IN ('delivery', 'both', 'trailing')", "cut at a delivery that is not planned": "delivery IS NULL AND cut_by = 'delivery'",
    "partial bar is not the last": "partial <> last", "partial bar may be decided on": "partial IS NOT NULL AND partial_eligible", "no candles of four hours": "n4 = 0", "source of the candles of four hours": "n4 IS NOT NULL AND source4 <> 'native'", "partial bar of four hours": "n4 IS NOT NULL AND partial4",
    "settlement after the cut": "NOT funding_last < coalesce(delivery, last + 1)", "no settlements": "funding_last IS NULL",
}


@query("flt_15_batch_verification", f"WITH {BATCH_SQL} SELECT k AS symbol, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{k}{chr(39)} END' for k, c in PROBLEMS.items())}) AS problems FROM p")
def flt_15(t):
    """What is wrong with the files of each delisted contract, one condition for each check; the files are written of orders first, some of them wrong."""
    k, folder = col("symbol"), shared_folder(t.spark)
    rows = t.orders.select((col("o_custkey") % 60).alias("symbol"), col("o_orderkey").alias("t"))
    facts = rows.groupBy("symbol").agg(F.max("t").alias("last"), F.count("*").alias("n"))
    x = rows.join(F.broadcast(facts), "symbol")  # sixty rows
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("t"))

    def write(rows, name, *order):
        rows.repartition("symbol").sortWithinPartitions("symbol", *order).write.parquet(f"{folder}/{name}")

    partial = F.when(k % 10 == 0, col("last") - 4).when(k % 5 == 0, col("last"))
    hours = x.select("symbol", F.explode(F.when((col("t") == col("last")) & (partial != col("last")), F.array("t", partial)).otherwise(F.array("t"))).alias("t"), "last")
    hours = hours.select("symbol", "t", F.when(k % 13 == 5, "aggregated").otherwise("native").alias("source"), F.coalesce(col("t") == partial, F.lit(False)).alias("partial"), ((k % 10 == 5) & (k % 15 == 5)).alias("eligible"))
    write(hours, "hours", F.when(k % 11 == 4, -col("t")).otherwise(col("t")))
    four = x.withColumn("place", place).where((k % 4 != 1) & (k % 17 != 2) & (col("place") % 4 == 0))
    four = four.select("symbol", "t", F.when(k % 19 == 3, "aggregated").otherwise("native").alias("source"), ((k % 23 == 6) & (col("place") + 4 > col("n"))).alias("partial"), F.lit(False).alias("eligible"))
    write(four, "four_hours", "t")
    late = F.when(k % 8 == 3, 0).otherwise(2)
    write(facts.where(k % 9 != 2).select("symbol", F.explode(F.sequence(col("last") - late - 16, col("last") - late, F.lit(8))).alias("t")), "settlements", "t")
    plan = facts.select("symbol", F.when(k % 3 == 0, col("last") - 1).alias("delivery"), F.when(k % 7 == 0, "signature").when(k % 7 == 1, "trailing").when(k % 7 == 2, None).otherwise("delivery").alias("cut_by"), (k % 4 != 1).alias("four"))
    judged = f.batch_facts(t.spark, folder, plan)
    return judged.select("symbol", F.array_join(f.batch_problems(step_ms=1), ",").alias("problems"))
