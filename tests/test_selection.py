"""Selection by counted bits against sorting: hot keys, ties, negative values, infinities, whole numbers beyond 2^53, missing values and keys."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import aggregates as a
from tidewater.operators import selection as s


def rows_of(seed):
    rng = random.Random(seed)
    special = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1e308, -1e308, 1.0, math.nextafter(1.0, 2), None]
    rows = [("hot", rng.choice([rng.gauss(0, 1e3), float(rng.randrange(-3, 4)), rng.choice(special)])) for _ in range(900)]
    rows += [(f"k{i % 9}", rng.choice([rng.gauss(0, 1), rng.choice(special)])) for i in range(90)]
    return rows + [(None, float(i % 5)) for i in range(70)] + [("none", None)]


def test_bits_are_in_the_order_of_numbers(spark):
    v = sorted([0.0, math.inf, -math.inf, 5e-324, -5e-324, 1e308, -1e308, 1.0, -1.0, math.pi, -math.pi, 2.0**60, -(2.0**60)])
    df = spark.createDataFrame([(x,) for x in [*v, -0.0, math.nan]], "x double").select("x", s.ordered_bits("x").alias("u"), s._from_bits(s.ordered_bits("x")).alias("back"))
    got = {repr(r.x): r for r in df.collect()}
    u = [got[repr(x)].u for x in v]
    assert u == sorted(u) and len(set(u)) == len(u) and got["-0.0"].u == got["0.0"].u and got["nan"].u > max(u)
    assert all(r.back == r.x or math.isnan(r.x) for r in got.values())


@pytest.mark.parametrize("large", [1, 60, 500, 1 << 20])
def test_same_values_however_many_keys_are_counted(spark, large):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "key string, v double").repartition(6)
    n = F.col("n")
    got = {r.key: r for r in s.at_ranks(df, F.col("key"), F.col("v"), {"first": F.lit(0), "mid": F.floor(n / 2), "last": n - 1}, large).collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, v in by.items():
        v.sort()
        for name, i in (("first", 0), ("mid", len(v) // 2), ("last", len(v) - 1)):
            assert got[k][name] == v[i] and got[k][f"{name}_before"] == sum(x < v[i] for x in v), (k, name)
        assert got[k].n == len(v)
    finite = df.where("v is null or abs(v) < 1e300")
    q = {r.key: r for r in a.quantiles(finite, "key", "v", large, low=0.1, high=0.75).collect()}
    f = {r.key: r.v for r in a.floor_quantile(finite, "key", "v", 0.9, large).collect()}
    for k, v in by.items():
        v = sorted(x for x in v if abs(x) < 1e300)
        assert q[k].low == pytest.approx(np.quantile(v, 0.1)) and q[k].high == pytest.approx(np.quantile(v, 0.75))
        assert f[k] == v[min(len(v) - 1, math.floor(0.9 * len(v)))]


def test_whole_numbers_are_exact(spark):
    v = [2**53 + i for i in range(50)] + [-(2**62), 2**62, 2**62 + 1]
    df = spark.createDataFrame([(1, x) for x in v], "k int, v long")
    r = s.at_ranks(df, F.col("k"), F.col("v"), {"a": F.lit(0), "b": F.lit(3), "c": F.col("n") - 1}, 1).first()
    assert (r.a, r.b, r.c) == (-(2**62), 2**53 + 2, 2**62 + 1)
    assert a.floor_quantile(df, "k", "v", 0.5, 1).schema["v"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("large", [1, 1 << 20])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("n,bins", [(503, 10), (7, 10), (1, 3), (40, 1)])
def test_bins_of_equal_frequency(spark, large, descending, n, bins):
    rng = random.Random(n)
    rows = [(i, float(rng.randrange(4))) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (n, None)], "id long, v double")
    order = sorted(rows, key=lambda x: (-x[1] if descending else x[1], x[0]))
    want = {i: ((r + 1) * bins - 1) // n for r, (i, _) in enumerate(order)}
    assert {r.id: r.bin for r in s.equal_bins(df, bins, "v", "id", descending, large=large).collect()} == want


def test_nothing(spark):
    none = spark.createDataFrame([], "key string, v double")
    for large in (1, 100):
        assert a.quantiles(none, "key", "v", large, q=0.5).collect() == [] and a.global_quantile(none, "v", 0.5, large).first().v is None
    assert s.equal_bins(none.selectExpr("v", "1L as id"), 4, "v", "id").collect() == []


def test_a_hot_key_is_not_sorted(spark):
    df = spark.range(5_000).select(F.lit("k").alias("key"), F.rand(1).alias("v"))
    plan = s.counted(df.select("key", s.ordered_bits("v").alias("u")), spark.createDataFrame([("k", "m", 2_500)], "key string, name string, rank long"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan
    want = sorted(r.v for r in df.collect())[2_500]
    assert s.at_ranks(df, F.col("key"), F.col("v"), {"m": F.lit(2_500)}, 1).first().m == want


def test_small_keys_are_sorted_once_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(s, "SORTED", 100, raising=False)
    df = spark.range(5_000).select((F.col("id") % 70).alias("key"), F.rand(3).alias("v"))
    x = s.at_ranks(df, F.col("key"), F.col("v"), {"low": F.lit(0), "mid": F.floor(F.col("n") / 2)})
    assert x.rdd.getNumPartitions() == 50
    plan = x._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window ") == 1 and "SortAggregate" not in plan
    by = {}
    for r in df.collect():
        by.setdefault(r.key, []).append(r.v)
    assert {(r.key, r.n, r.low, r.mid, r.mid_before) for r in x.collect()} == {(k, len(v), min(v), sorted(v)[len(v) // 2], len(v) // 2) for k, v in by.items()}
