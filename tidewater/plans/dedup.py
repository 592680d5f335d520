"""Queries that keep one row for each key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as d
from ..operators.scale import shared_folder
from ..sources.bucketed import BucketedTable
from .registry import query

col = F.col


@query("ded_1_last_wins", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def ded_1(t):
    """Aggregated rather than ranked: the last row is a maximum, so each task sends one row for each key."""
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    return last.select("user_id", "event_type", "x.event_id", "x.value")


@query("ded_2_first_wins", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def ded_2(t):
    first = t.events.groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    return first.select("user_id", "event_type", "x.event_id", "x.value")


@query("ded_3_preferred_kind", """SELECT address, kind, balance FROM (SELECT c_nationkey AS address, 'trader' AS kind, c_acctbal AS balance, c_custkey AS n FROM customer UNION ALL SELECT s_nationkey, 'vault', s_acctbal, s_suppkey FROM supplier)
QUALIFY row_number() OVER (PARTITION BY address ORDER BY kind = 'vault' DESC, n) = 1""")
def ded_3(t):
    c = t.customer.select(col("c_nationkey").alias("address"), F.lit("trader").alias("kind"), col("c_acctbal").alias("balance"), col("c_custkey").alias("n"))
    s = t.supplier.select(col("s_nationkey").alias("address"), F.lit("vault").alias("kind"), col("s_acctbal").alias("balance"), col("s_suppkey").alias("n"))
    return d.keep_first(c.unionByName(s), ["address"], (col("kind") == "vault").desc(), "n").drop("n")


@query("ded_4_latest_opinion", "SELECT conv_id, role, last(length(text) ORDER BY turn, length(text)) AS size FROM conversations GROUP BY 1, 2")
def ded_4(t):
    return t.conversations.groupBy("conv_id", "role").agg(F.max_by(F.length("text"), F.struct("turn", F.length("text"))).cast("long").alias("size"))


@query("ded_5_evidence_once", "SELECT event_id, CASE WHEN rn = 1 THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END AS weight, rn = 1 AS eligible FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY ts, event_id) AS rn FROM events)")
def ded_5(t):
    """A piece of evidence counts once for each symbol; later uses get the plain weight. First uses are minima, joined back, so no piece is sorted."""
    e = t.events.select("event_type", (col("user_id") % 20).alias("evidence"), "ts", "event_id")
    first = e.groupBy("event_type", "evidence").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    once = col("event_id") == col("first.event_id")
    return e.join(first, ["event_type", "evidence"]).select("event_id", F.when(once, 1.35).otherwise(1.0).alias("weight"), once.alias("eligible"))


@query("ded_6_duplicate_signatures", "SELECT user_id, count(*) - count(DISTINCT (event_type, value)) AS duplicates FROM (SELECT user_id, event_type, round(value) AS value FROM events) GROUP BY 1")
def ded_6(t):
    """Repeats are counted, not removed: without an id they may be true."""
    x = t.events.withColumn("signature", F.to_json(F.struct("event_type", F.round("value").alias("v"))))
    return x.groupBy("user_id").agg((F.count("*") - F.countDistinct("signature")).alias("duplicates"))


@query("ded_7_first_settlement", "SELECT event_type, hour, first(value ORDER BY ts, event_id) AS rate FROM (SELECT *, (epoch_us(ts) // 1000) // 3600000 AS hour FROM events) GROUP BY 1, 2")
def ded_7(t):
    hour = F.floor(F.unix_millis(col("ts").cast("timestamp")) / 3_600_000)
    return t.events.groupBy("event_type", hour.alias("hour")).agg(F.min_by("value", F.struct("ts", "event_id")).alias("rate"))


NOW = 1_706_400_000_000
POSTS_SQL = f"""posts AS (SELECT doc_id AS ordinal, doc_id // 2 AS id, source AS author, lang AS symbol, text, {NOW} - doc_id % 30 * 3600000 AS posted, CASE WHEN doc_id % 17 = 0 THEN 1 END AS duplicate_of, n_chars AS likes FROM documents)"""


def posts(t):
    return as_posts(t.documents)


def as_posts(documents):
    return documents.select(
        col("doc_id").alias("ordinal"), F.floor(col("doc_id") / 2).alias("id"), col("source").alias("author"), col("lang").alias("symbol"), "text",
        (NOW - col("doc_id") % 30 * 3_600_000).alias("at"), F.when(col("doc_id") % 17 == 0, 1).alias("duplicate_of"), col("n_chars").alias("likes"),
    )


CLEAN_SQL = rf"""{POSTS_SQL}, n AS (SELECT *, lower(regexp_replace(trim(text), '\s+', ' ', 'g')) AS norm FROM posts WHERE posted >= {NOW} - 24 * 3600000 AND duplicate_of IS NULL),
i AS (SELECT * FROM n WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1), clean AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY author, symbol, norm ORDER BY ordinal) = 1)"""


def clean(t):
    return d.clean_posts(posts(t), NOW, 24 * 3_600_000)


@query("flt_9_clean_posts", f"WITH {CLEAN_SQL} SELECT ordinal, id, author, symbol FROM clean")
def flt_9(t):
    return clean(t).select("ordinal", "id", "author", "symbol")


@query("snk_5_upsert", """SELECT k, v FROM (SELECT o_custkey AS k, o_totalprice AS v, 0 AS new, o_orderkey AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' UNION ALL SELECT o_custkey, -o_totalprice, 1, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
QUALIFY row_number() OVER (PARTITION BY k ORDER BY new DESC, n DESC) = 1""")
def snk_5(t):
    """Older orders, replaced by newer ones."""
    day = F.expr("TIMESTAMP_NTZ '1997-01-01'")
    old = t.orders.where(col("o_orderdate") < day).select(col("o_custkey").alias("k"), col("o_totalprice").alias("v"), col("o_orderkey").alias("n"))
    new = t.orders.where(col("o_orderdate") >= day).select(col("o_custkey").alias("k"), (-col("o_totalprice")).alias("v"), col("o_orderkey").alias("n"))
    table = BucketedTable(t.spark, f"{shared_folder(t.spark)}/upserts", ["k"], "n")
    table.update(old)
    table.update(new)
    return table.read().select("k", "v")


@query("snk_9_merge_batch", """SELECT c_custkey, coalesce(b.v, c_acctbal) AS balance, CASE WHEN b.v IS NULL THEN 'ordinary' ELSE 'quality' END AS pool, CASE WHEN c_custkey % 3 = 0 THEN 1700000000000 + c_custkey END AS quality_at, CASE WHEN c_custkey % 4 = 0 THEN 1700000000000 - c_custkey END AS ordinary_at
FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b ON o_custkey = c_custkey""")
def snk_9(t):
    """Existing records, replaced by those of an interrupted batch that have a known id; when each pool was last updated stays, as the batch did not finish."""
    k = col("c_custkey")
    known = t.customer.select("c_custkey", col("c_acctbal").alias("balance"), F.lit("ordinary").alias("pool"), F.when(k % 3 == 0, 1_700_000_000_000 + k).alias("quality_at"), F.when(k % 4 == 0, 1_700_000_000_000 - k).alias("ordinary_at"))
    batch = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("balance")).withColumn("pool", F.lit("quality"))
    return d.merged_batch(known, batch, ["c_custkey"], ["balance", "pool"])
