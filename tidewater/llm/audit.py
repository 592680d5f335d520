"""Interaction of filters: what each removes in every order of applying them.

The orders form a trie of prefixes; prefixes with the same filters in another order leave the same survivors, so there is one state for each set of filters.
States are visited depth first: a state's survivors are a persisted DataFrame, filtered from its parent's, and one aggregation counts what each
filter that is still to come removes from it. A state is let go once all that follow are done, so no more are held than there are filters. The orders' rows
are put together from the counts of these edges.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, looked_up, shared_folder, stored

FILTERS = "ABCDE"


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def rules(text: Column) -> dict[str, Column]:
    """Whether a text, which is not null, fails the filters that look at it alone: too short, repetitive, capitals, odd characters."""
    w = words(text)
    return {
        "A": F.size(w) < 50,
        "B": 100 * F.size(F.array_distinct(w)) < 65 * F.size(w),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A stored row for each of ``docs``: ``part`` (its source, null as the empty string), whether it fails each filter, and ``good`` and ``toxic`` by its labels.

    Filter E fails a text that a row with a smaller ``doc_id`` has anywhere in the table. Null texts are empty. A row without an id is neither smaller nor greater
    than another, and has no label; rows that repeat an id and a text don't fail each other. Of several labels of an id one that is 1 counts. Texts are compared by
    SHA-256, whose smallest id the tasks find before rows are moved; only digests that occur more than once are looked up.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), *(v.alias(k) for k, v in rules(text).items()), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    d = stored(d)
    seen = d.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
    x = looked_up(d, stored(seen), ["sha"], "n")
    known = x.where("doc_id is not null").join(by_id, "doc_id", "left")
    x = known.unionByName(x.where("doc_id is null"), allowMissingColumns=True)
    return stored(x.select("part", *FILTERS[:4], F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"), flag("good"), flag("toxic")))


def edges(judged: DataFrame, filters: str) -> DataFrame:
    """For each state (``applied``: its filters in the order of ``filters``), ``part`` and filter still to come (``step``): ``n`` survivors, and what the filter removes of them, ``removed``, ``good_lost``, ``toxic_lost``.

    Parts without survivors have no row. The counts of a state are written as they are made.
    """
    path, done = shared_folder(judged.sparkSession), set()

    def visit(survivors: DataFrame, applied: frozenset[str]) -> None:
        name, rest = "".join(f for f in filters if f in applied), [f for f in filters if f not in applied]
        done.add(applied)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        count = lambda c: F.count_if(c)
        sums = [F.struct(F.lit(f).alias("step"), count(F.col(f)).alias("removed"), count(F.col(f) & F.col("good")).alias("good_lost"), count(F.col(f) & F.col("toxic")).alias("toxic_lost")) for f in rest]
        found = survivors.groupBy("part").agg(F.count("*").alias("n"), F.array(*sums).alias("x"))
        found.select(F.lit(name).alias("applied"), "part", "n", F.inline("x")).write.parquet(f"{path}/{name or 'none'}")
        for f in rest:
            after = applied | {f}
            if after not in done and len(after) < len(filters):  # a set of filters that was reached in another order leaves the same rows
                visit(survivors.where(~F.col(f)).drop(f), after)
        survivors.unpersist()

    visit(judged, frozenset())
    schema = "applied string, part string, n long, step string, removed long, good_lost long, toxic_lost long"
    names = ["".join(s) or "none" for k in range(len(filters)) for s in combinations(filters, k)]
    return judged.sparkSession.read.schema(schema).parquet(*(f"{path}/{name}" for name in names))


def audit(judged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the counts of that step, zeros included, for every order of ``filters``; ``judged`` has a boolean column for each, true where it fails a row.

    An empty table has no parts and gives an empty result.
    """
    spark, n = judged.sparkSession, len(filters)
    found = stored(edges(judged, filters))
    orders = [("".join(p), k + 1, p[k], "".join(f for f in filters if f in p[:k])) for p in permutations(filters) for k in range(n)]
    grid = spark.createDataFrame(orders, "filter_order string, step int, filter string, applied string")
    # of one filter in one part: all it fails, what only it fails, and what it removes in all orders
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.length("applied") + 1)
    of = lambda k, c: F.sum(F.when(F.length("applied") == k, F.col(c)).otherwise(0))
    whole = found.groupBy("part", F.col("step").alias("filter")).agg(of(0, "removed").alias("fails"), of(n - 1, "removed").alias("unique_fails"), F.sum(weight * F.col("removed")).alias("shapley"))
    each = whole.join(F.broadcast(grid), "filter").join(found.withColumnRenamed("step", "filter"), ["part", "filter", "applied"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    removed = zero(F.col("removed"))
    return each.select(
        "part", "filter_order", "step", (zero(F.col("n")) - removed).alias("kept"), removed.alias("removed"), (F.col("fails") - removed).cast("long").alias("redundant"),
        F.col("unique_fails").cast("long").alias("unique_fails"), zero(F.col("good_lost")).alias("good_lost"), zero(F.col("toxic_lost")).alias("toxic_lost"), F.col("shapley").cast("long").alias("shapley"),
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(verdicts(docs, labels))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
first AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
f AS (
  SELECT part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 5 * length(w.t) AS c,
         regexp_matches(w.t, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM w JOIN first ON w.t = first.t LEFT JOIN l ON w.doc_id = l.doc_id),
-- one row for each part and combination of what matters, and its filters that fail as a string
s AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         good, toxic, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
steps AS (SELECT filter_order, i AS step, substr(filter_order, i, 1) AS filter, substr(filter_order, 1, i - 1) AS before FROM orders, range(1, 6) r(i)),
placed AS (
  SELECT s.part, filter_order, step, filter, n, good, toxic, contains(fails, filter) AS failing, fails = filter AS alone,
         len(list_filter(string_split(before, ''), lambda b: b <> '' AND contains(fails, b))) > 0 AS gone
  FROM s, steps),
counted AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""
