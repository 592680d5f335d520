"""One row for each key: first or last wins, latest by a tie-broken order, and dedup that looks at two keys in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The row of each key that comes first."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables with one row for each key: new rows win over old ones, later over earlier."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return keep_first(both, keys, F.col("_new").desc(), F.col(order).desc()).drop("_new")


def clean_posts(posts: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    """Posts (``id, author, symbol, text, at, duplicate_of, ordinal``) inside the window, without repeats of an id or of an author's text.

    Ids are told apart first, then texts: in the order of ``ordinal``. A post that is dropped for its id so never blocks another by its text.
    Texts are compared whole, by the SHA-256 of what they are without case and runs of blanks.
    """
    text = F.lower(F.regexp_replace(F.btrim("text"), r"\s+", " "))
    x = posts.where((F.col("at") <= now_ms) & (F.col("at") >= now_ms - window_ms) & F.col("duplicate_of").isNull() & (text != "")).withColumn("_text", F.sha2(text.cast("binary"), 256))
    return keep_first(keep_first(x, ["id"], "ordinal"), ["author", "symbol", "_text"], "ordinal").drop("_text")


def merged_batch(known: DataFrame, batch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``known`` with ``columns`` from the completed records of a batch; records that are not known are left out, other columns stay as they were."""
    new = batch.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_done"))
    x = known.join(new, keys, "left")
    return x.select(*(F.when(F.col("_done"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in known.columns))
