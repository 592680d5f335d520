"""Queries of streams, run over what has landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import HOUR_MS
from ..operators import bars as b
from ..operators.scale import shared_folder
from ..sources.bucketed import BucketedTable
from ..streaming import jobs as s
from ..streaming import posts as po
from ..streaming import stateful as sp
from .dedup import POSTS_SQL, as_posts
from .registry import bars_sql, query

H4 = 4 * HOUR_MS
col = F.col


def ticks(t):
    return s.ticks(t.spark, f"{t.folder}/events.parque[t]")


@query("stm_1_incremental_upsert", "SELECT user_id, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY 1")
def stm_1(t):
    path = shared_folder(t.spark)
    table = BucketedTable(t.spark, f"{path}/out", ["user_id"], "at")
    newest = ticks(t).select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    reduce = lambda batch, i: table.update(batch.groupBy("user_id").agg(F.max("at").alias("at"), F.max_by("value", "at").alias("value")), i)
    q = newest.writeStream.foreachBatch(reduce).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return table.read().select("user_id", "value")


@query("stm_2_closed_bars", f"WITH {bars_sql(H4)} SELECT symbol, t, o, h, l, c, trades FROM bars WHERE (t + {H4}) * 1000 <= (SELECT max(epoch_us(ts)) FROM events) // 1000 * 1000 - 600000000")
def stm_2(t):
    return s.to_the_end(s.closed_bars(ticks(t), "4 hours", "10 minutes"))


@query("stm_3_position_changes")
def stm_3(t):
    return s.to_the_end(sp.position_changes(ticks(t))).groupBy("type").agg(F.count("*").alias("n"))


@query("stm_4_swings")
def stm_4(t):
    path = shared_folder(t.spark)
    b.from_events(t.events, H4).select("symbol", "t", "h", "l").write.parquet(path)
    bars = t.spark.readStream.schema("symbol string, t long, h double, l double").parquet(path)
    return s.to_the_end(sp.swings(bars, threshold=120.0))


POSTS = "doc_id long, text string, lang string, source string, n_chars long"


@query("stm_5_clean_posts", rf"""WITH {POSTS_SQL}, n AS (SELECT *, lower(regexp_replace(trim(text), '\s+', ' ', 'g')) AS norm, unnest(range(posted // 3600000 + 1, posted // 3600000 + 25)) * 3600000 AS cutoff FROM posts WHERE duplicate_of IS NULL),
i AS (SELECT * FROM n WHERE norm <> '' AND cutoff <= (SELECT max(posted) FROM posts) - 600000 QUALIFY row_number() OVER (PARTITION BY cutoff, id ORDER BY ordinal) = 1)
SELECT cutoff, ordinal, id, author, symbol, posted AS "at" FROM i QUALIFY row_number() OVER (PARTITION BY cutoff, author, symbol, norm ORDER BY ordinal) = 1""")
def stm_5_posts(t):
    """The clean posts of the day before each full hour."""
    docs = t.spark.readStream.schema(POSTS).parquet(f"{t.folder}/documents.parque[t]")
    return s.to_the_end(po.clean_posts(as_posts(docs).withColumn("at", F.timestamp_millis("at"))))


@query("stm_5_first_sightings", "SELECT event_type, user_id FROM events GROUP BY 1, 2")
def stm_5(t):
    return s.to_the_end(s.first_sightings(ticks(t).select("ts", "event_type", "user_id"), "40 days", "event_type", "user_id")).select("event_type", "user_id")


@query("stm_6_activity_runs", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, (epoch_us(min(ts)) // 1000) AS start, (epoch_us(max(ts)) // 1000) + 21600000 AS "end", count(*) AS n FROM r GROUP BY user_id, k HAVING (epoch_us(max(ts)) // 1000) + 21600000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 600000""")
def stm_6(t):
    return s.to_the_end(s.runs(ticks(t), "6 hours", "10 minutes"))


@query("stm_7_resumed_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stm_7(t):
    """Two runs from one checkpoint: the second finds nothing new, and nothing is counted twice."""
    path = shared_folder(t.spark)
    for _ in range(2):
        q = ticks(t).select("event_type", "event_id").writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return t.spark.read.schema("event_type string, event_id long").parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stm_8_provisional_rows", "SELECT user_id, last(value ORDER BY ts, event_id) AS value, count(*) AS n FROM events GROUP BY 1")
def stm_8(t):
    """The newest row is shown until its successor arrives; the last update of each key counts."""
    out = s.to_the_end(s.provisional(ticks(t), "40 days"), "update")
    x = out.groupBy("user_id", "bucket").agg(F.max_by(F.struct("ts", "value", "n"), "batch").alias("x"))
    return x.groupBy("user_id").agg(F.max_by("x.value", "x.ts").alias("value"), F.sum("x.n").alias("n"))
