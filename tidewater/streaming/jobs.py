"""Streaming forms of the market operators.

Each takes a streaming DataFrame of ticks (``ts`` timestamp, ``event_id, user_id, event_type, value, props``) and returns a
streaming DataFrame. State is keyed and expires by watermark or is a few numbers for each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import shared_folder
from .stateful import state_in_rocksdb

TICKS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def ticks(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Ticks from Parquet files as they land."""
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def closed_bars(events: DataFrame, step: str, late: str) -> DataFrame:
    """Bars that no tick can change any more: a window is given out once the watermark has passed its end."""
    order = F.struct("ts", "event_id")
    w = events.withWatermark("ts", late).groupBy(F.window("ts", step), F.col("event_type").alias("symbol"))
    bars = w.agg(F.min_by("value", order).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", order).alias("c"), F.count("*").alias("trades"))
    return bars.select("symbol", F.unix_millis("window.start").alias("t"), "o", "h", "l", "c", "trades")


def first_sightings(events: DataFrame, late: str, *keys: str) -> DataFrame:
    """The first tick of each key; keys are forgotten when the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def runs(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Stretches of activity of each user, ended by a gap."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_millis("session_window.start").alias("start"), F.unix_millis("session_window.end").alias("end"), "n")


def provisional(events: DataFrame, bucket: str = "1 day", late: str = "2 days") -> DataFrame:
    """For update mode: each user's newest tick of a bucket of time, given out again when a newer one arrives, until the watermark has passed the bucket and its
    state is dropped. The newest bucket of a user has the row that no successor has replaced yet."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", bucket), "user_id")
    x = w.agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))
    return x.select(F.col("window.start").alias("bucket"), "user_id", "ts", "value", "n")


def to_the_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, with its checkpoint and output in the shared folder, and read the output."""
    spark = stream.sparkSession
    path = shared_folder(spark)
    with state_in_rocksdb(spark):
        if mode == "append":
            q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
        else:
            q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out/batch={i}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out") if mode == "append" else spark.read.parquet(f"{path}/out")
