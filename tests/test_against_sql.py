"""Queries against their SQL on rows that the small tables don't have: halves and thresholds, letters beyond ASCII."""

import functools
import random

import duckdb
from pyspark.sql import functions as F

from tidewater.catalog import ORACLE_SQL, QUERIES
from tidewater.operators.aggregates import exact_mean


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over ``tables``: rows and schema each."""
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = QUERIES[name](spark, str(folder)), c.sql(ORACLE_SQL[name])
    return sorted((tuple(r[k] for k in want.columns) for r in got.collect()), key=str), sorted(want.fetchall(), key=str)


def test_a_score_at_a_half_is_rounded_up(spark, tmp_path):
    # 9.5 * 0.7 + 96 * 0.3 is 35.45
    rows = [(i, n, b) for i, (n, b) in enumerate((n, s * (950.0 + 50 * k)) for n in range(25) for k in range(120) for s in (-1, 1))]
    got, want = both(spark, tmp_path, "rul_13_composite_cap", customer=(rows, "c_custkey long, c_nationkey int, c_acctbal double"))
    assert got == want
    assert {r[0]: r[1] for r in got}[next(i for i, n, b in rows if (n, b) == (1, -950.0))] == 35.5


def test_words_end_at_letters_beyond_ascii(spark, tmp_path):
    texts = ["no con sellóta de", "ñsell", "sellĺ", "sell\u0301", "buy̧", "buyé", "é buy", "a_sell", "sell_", "買buy看", "ſhort", "aſhort", "unleſs buy", "SELLING", "İf buy", "ıf buy", "ifé buy", "if buy", "don't", "donʼt buy", "buy？", "看涨é", "buy٣", "buy3", "", None]
    docs = [(i, x) for i, x in enumerate(texts)]
    got, want = both(spark, tmp_path, "str_3_direction", documents=(docs, "doc_id long, text string"), conversations=([(i, 1, x) for i, x in docs], "conv_id long, turn int, text string"))
    assert got == want and {r[3] for r in got} == {-1, 0, 1, None}


def test_a_mean_at_a_threshold_does_not_depend_on_the_order(spark, tmp_path):
    cents = [(4500 + d) / 100 for d in (-3, 7, -12, 31, -23, 5, -5, 41, -41, 13, -13)]
    rng, sums = random.Random(1), set()
    for _ in range(200):
        rng.shuffle(cents)
        sums.add(functools.reduce(float.__add__, cents) / len(cents))
    assert len(sums) > 1 and max(sums) > 45  # the order matters for doubles
    high = max((rng.sample(cents, len(cents)) for _ in range(200)), key=lambda x: functools.reduce(float.__add__, x))
    clicks = [(i, user, "click", x, '{"k": 1}') for user, order in enumerate((high, sorted(cents))) for i, x in enumerate(order)]
    spark.createDataFrame(clicks, "event_id long, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [r.indicators_direction for r in QUERIES["rul_18_module_availability"](spark, str(tmp_path)).collect()] == [-1, -1]
    rows = [(0, x) for x in high] + [(1, 1e300), (1, 1.0), (2, float("inf")), (3, None), (4, 0.1), (4, 0.2), (4, None), (5, 9e18), (5, 9e18), (6, 1e-9)]
    x = spark.createDataFrame(rows, "k int, v double").repartition(1).groupBy("k").agg(exact_mean(F.col("v")).alias("m"))
    got = {r.k: r.m for r in x.collect()}
    assert got == {0: 45.0, 1: 5e299, 2: float("inf"), 3: None, 4: 0.15, 5: 9e18, 6: 1e-9}
