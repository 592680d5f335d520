"""Posts of a sliding day, as they come: repeats dropped by id and by text within each window, and evidence joined to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["ordinal", "id", "author", "symbol", "text_hash", "at"]


def clean_posts(posts: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``cutoff`` (ms, the window's end) and ``ordinal, id, author, symbol, at`` of the posts that a window holds, once no post can come to it any more.

    ``posts`` are ``id, author, symbol, text, at`` (timestamp), ``duplicate_of, ordinal``. As ``operators.dedup.clean_posts`` has it at each cutoff: posts that are marked as
    duplicates or blank are out; within a window of [end - length, end) the first by ordinal of each id stays, and of these the first of each author, symbol and text without case
    and runs of blanks. A repeat comes back when what it repeats has left the window. Two aggregations with state by window follow each other; both let a window go with the watermark.
    State holds hashes of texts, not texts.
    """
    text = F.lower(F.regexp_replace(F.btrim("text"), r"\s+", " "))
    x = posts.withWatermark("at", late).where(F.col("duplicate_of").isNull() & F.coalesce(text != "", F.lit(False)))
    x = x.select("ordinal", "id", "author", "symbol", F.sha2(text.cast("binary"), 256).alias("text_hash"), "at")
    first = lambda *keys: F.min_by(F.struct(*FIELDS), "ordinal").alias("x")
    by_id = x.groupBy(F.window("at", window, slide), "id").agg(first()).select("window", "x.*")
    by_text = by_id.groupBy("window", "author", "symbol", "text_hash").agg(first())
    return by_text.select(F.unix_millis("window.end").alias("cutoff"), "x.ordinal", "x.id", "x.author", "x.symbol", F.unix_millis("x.at").alias("at"))


def with_evidence(posts: DataFrame, evidence: DataFrame, within: str = "24 hours", late: str = "10 minutes") -> DataFrame:
    """Posts (``author, symbol, at`` and others) with each piece of evidence (``author, symbol, at, evidence``) of the same author and symbol in the time ``within`` before them.

    Both sides are held only as long as the other may still bring a match. Null authors or symbols match nothing.
    """
    p = posts.withWatermark("at", late)
    e = evidence.withWatermark("at", late).select(F.col("author").alias("_author"), F.col("symbol").alias("_symbol"), F.col("at").alias("evidence_at"), "evidence")
    near = (F.col("evidence_at") <= F.col("at")) & (F.col("evidence_at") >= F.col("at") - F.expr(f"INTERVAL {within}"))
    return p.join(e, (F.col("author") == F.col("_author")) & (F.col("symbol") == F.col("_symbol")) & near).drop("_author", "_symbol")
