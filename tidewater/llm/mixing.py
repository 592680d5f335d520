"""Mixing sources to target weights along a low-discrepancy schedule.

The mix is a row of slots, each a block of equally many words. Slot i takes its source from the golden-ratio point
frac(i * phi) through the cumulative target shares, so that every stretch of the mix is close to the targets. The slots of a source are
ranked, and its r-th slot gets the r-th block of its documents, shuffled by a hash and repeated once where the target is beyond
the source's size. The last block of a source is cut at its target, and slots that it is still owed follow the others.

No step brings a source's documents or slots together: running word counts are taken within hash ranges, of which a source of n documents
has the square root of n, from the sums of the ranges before, and slots are ranked within stretches of the mix alike. The number of slots grows
with the mix, as a slot is a block of ``block_words`` words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, free_name, stored, with_row_ids, with_text

#: By rank of the source. Fixed values of the contract, as the share of all words and the most that a document may be used.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
GOLDEN = 0.6180339887498949
CELLS = 4096
#: Slots that are ranked together.
STRETCH = 16_384


def n_words(text: Column) -> Column:
    """Runs of anything but blanks (0x20, 0x09-0x0D); 0 for null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, BLANKS, -1))).cast("long")


def _running(ranged: DataFrame, value: str, name: str) -> DataFrame:
    """The sum of ``value`` over all sources before, from the sums of the ranges before (one row for each of them)."""
    sums = ranged.groupBy("range").agg(F.sum(value).alias("_t"))
    before = sums.select("range", (F.sum("_t").over(Window.orderBy("range")) - F.col("_t")).alias("_before"))
    w = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "range").withColumn(name, F.col("_before") + F.sum(value).over(w) - F.col(value)).drop("_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source``, ``n_docs``, ``source_size``, ``rank`` (by code point, null last), ``target`` and the interval ``lo``, ``hi`` of its points.

    Shares by weight that are above ``repeats`` times a source's size stop there, and what is left is shared again. With
    level x, a source gets min(x * weight, cap): a few rounds of two sums find the level, over one row for each source.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    ranged = stored(by.repartitionByRange(F.col("source").asc_nulls_last()).select("*", F.lit(1).alias("one"), F.spark_partition_id().alias("range")))
    ranked = _running(ranged, "one", "rank").withColumn("weight", F.array(*map(F.lit, weights))[(F.col("rank") % len(weights)).cast("int")].cast("double"))
    ranked = stored(ranked.withColumn("cap", (F.col("source_size") * repeats).cast("double")))
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.col("cap") < level * F.col("weight")
        fixed, free = ranked.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0))).first()
        if not free:  # no source, or all are capped
            break
        new = (total - fixed) / free
        if new <= level:
            break
        level = new
    aimed = ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), "cap"))
    spread = _running(aimed, "target", "_lo")
    return spread.select("source", "n_docs", "source_size", F.col("rank").cast("long"), "target", (F.col("_lo") / max(total, 1.0)).alias("lo"), ((F.col("_lo") + F.col("target")) / max(total, 1.0)).alias("hi"))


def schedule(aims: DataFrame, slots: int, block: int) -> DataFrame:
    """``rank`` (of the source), ``nth`` and ``slot``: where in the mix the n-th block of a source comes."""
    spark = aims.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * GOLDEN % 1.0).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.least("hi", F.lit(1.0)) * CELLS))
    spans = aims.where("hi > lo").select("rank", "lo", "hi", F.explode(cells).alias("cell"))
    drawn = points.join(spans, "cell").where("u >= lo and u < hi").select("rank", "slot", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    sums = drawn.groupBy("rank", "stretch").agg(F.count("*").alias("_n"))
    before = sums.select("rank", "stretch", (F.sum("_n").over(Window.partitionBy("rank").orderBy("stretch")) - F.col("_n")).alias("_before"))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("rank", "stretch").orderBy("slot")) - 1
    drawn = drawn.join(before, ["rank", "stretch"]).select("rank", nth.alias("nth"), "slot")
    owed = F.ceil(F.round("target") / block).cast("long")
    parts = aims.where(F.round("target") > 0).select("rank", owed.alias("owed"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((owed - 1) / STRETCH))).alias("part"))
    wanted = parts.repartition("rank", "part").select("rank", F.explode(F.sequence(F.col("part") * STRETCH, F.least("owed", (F.col("part") + 1) * STRETCH) - 1)).alias("nth"))
    return wanted.join(drawn, ["rank", "nth"], "left").select("rank", "nth", F.coalesce("slot", F.lit(slots) + F.col("nth")).alias("slot"))


def _streams(sizes: DataFrame, aims: DataFrame, key: list[str]) -> DataFrame:
    """Documents with words, with ``at``: the words of their source's shuffled documents before them."""
    ranges = F.ceil(F.sqrt("n_docs"))
    keyed = sizes.where("size > 0").join(aims.drop("lo", "hi"), sizes["source"].eqNullSafe(aims["source"])).drop("source")
    keyed = keyed.withColumn("bin", F.floor(F.shiftrightunsigned("h", 11) / float(1 << 53) * ranges))
    sums = keyed.groupBy("rank", "bin").agg(F.sum("size").alias("_t"))
    before = sums.select("rank", "bin", (F.sum("_t").over(Window.partitionBy("rank").orderBy("bin")) - F.col("_t")).alias("_before"))
    w = Window.partitionBy("rank", "bin").orderBy("h", "doc_id", "size", *key).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(before, ["rank", "bin"]).withColumn("at", F.col("_before") + F.sum("size").over(w) - F.col("size")).drop("_before", "bin", "h", "n_docs")


def _laid_out(docs: DataFrame, weights: tuple[int, ...], share: float, slots: int | None, seed: int, block_words: int, keys: list[Column]) -> tuple[DataFrame, ...]:
    """Sizes of all rows, aims of the sources, streams of the documents with words, and what is laid into slots: ``words`` of the document ``at`` in its source, on its first pass or ``again``."""
    sizes = stored(docs.select(F.col("doc_id").cast("long"), "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), *keys))
    aims = stored(targets(sizes, weights, share))
    total = aims.agg(F.sum("target")).first()[0] or 0.0
    block = max(1, round(total / slots)) if slots else block_words
    slots = slots or max(1, math.ceil(total / block))
    streams = stored(_streams(sizes, aims, ["key"] if keys else []))
    quota = F.round("target").cast("long")
    passes = streams.select("*", F.posexplode(F.array(F.col("at"), F.col("at") + F.col("source_size"))).alias("again", "start")).withColumn("end", F.least(F.col("start") + F.col("size"), quota))
    pieces = passes.where("start < end").withColumn("nth", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    nth = F.col("nth")
    pieces = pieces.select("rank", "at", "again", "nth", (F.least("end", (nth + 1) * block) - F.greatest("start", nth * block)).alias("words"))
    return sizes, aims, streams, pieces.join(schedule(aims, slots, block), ["rank", "nth"])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, slots: int | None = None, seed: int = 1, block_words: int = 2048, key: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``first_slot`` for every row of ``docs`` (``doc_id``, ``text``, ``source``).

    ``taken`` are the words of the document in the mix, repeats counted: at most twice its size, and by source they add up to the
    rounded target. ``first_slot`` is null where nothing is taken. Null and blank texts have size 0; null is a source of its
    own; repeated rows are documents of their own. Reruns agree, whatever the order of rows. An empty table gives no rows. Texts are counted
    whole. A slot has ``block_words`` words, or what makes ``slots`` slots. ``key`` names a column that is carried along, other columns are ignored.
    """
    sizes, aims, streams, placed = _laid_out(docs, weights, share, slots, seed, block_words, [F.col(key).alias("key")] if key else [])
    placed = placed.groupBy("rank", "at").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    names = aims.select("rank", "source")
    taken = streams.join(placed, ["rank", "at"], "left").join(names, "rank")
    columns = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", *([F.col("key").alias(key)] if key else [])]
    blank = sizes.where("size = 0").join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return taken.select(*columns).unionByName(blank.withColumns({"taken": F.lit(0), "first_slot": F.lit(None).cast("long")}).select(*columns))


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, a blank between them."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.array_join(F.slice(F.split(trimmed, BLANKS, -1), 1, n.cast("int")), " ")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, slots: int | None = None, seed: int = 1, block_words: int = 2048) -> DataFrame:
    """The mix itself: a row of ``docs`` for each pass in which it is used, with its columns and the text that is used there.

    A source beyond whose size its target lies is used a second time (``again`` 1); the text at which a pass ends is cut to the words that are ``taken`` of it, joined by blanks, and
    ``n_chars``, if there is one, follows. So the words of a source add up to its rounded target. ``slots`` lists the slots that the text is laid into, in its order, with the words in each. The other
    added columns are ``size``, ``source_size`` and ``target``; names that ``docs`` has already get underscores before them. Rows without words are not part of the mix. Rows get an id of their
    own, so repeated ones are told apart and the join has no large key. An empty table gives no rows.
    """
    key = free_name(docs, "row_id")
    keyed = with_row_ids(docs, key)
    _, _, streams, placed = _laid_out(keyed, weights, share, slots, seed, block_words, [F.col(key).alias("key")])
    laid = F.transform(F.array_sort(F.collect_list(F.struct("nth", "slot", "words"))), lambda x: F.struct(x["slot"].alias("slot"), x["words"].alias("words")))
    used = placed.groupBy("rank", "at", "again").agg(F.sum("words").alias("taken"), laid.alias("slots"))
    names = {c: free_name(docs, c) for c in ("size", "source_size", "target", "again", "taken", "slots")}
    drawn = streams.join(used, ["rank", "at"]).select(F.col("key").alias(key), *(F.col(c).alias(n) for c, n in names.items()))
    rows = keyed.join(drawn.hint("shuffle_hash"), key).select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), *names.values())
    text = F.col("row.text")
    return with_text(rows, docs, F.col(names["taken"]) < F.col(names["size"]), first_words(text, F.col(names["taken"])), list(names.values()))


def digest(docs: DataFrame) -> DataFrame:
    """What the mix takes of each row of ``docs``, as ``mix`` has it."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot")
