"""Tables that grow: buckets that an update rewrites, and draws that a stopped run goes on with."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import draws
from tidewater.operators.modelling import day_map
from tidewater.sources.bucketed import BucketedTable


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_an_update_rewrites_the_buckets_that_it_touches(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["k"], "at", buckets=16)
    assert t.read() is None and t.versions() == []
    first = spark.range(400).select(F.col("id").alias("k"), F.lit(1).alias("at"), F.concat(F.lit("v"), "id").alias("v"))
    assert t.update(first) == list(range(16))
    before = t.manifest()
    touched = t.update(spark.createDataFrame([(7, 0, "new"), (1000, 5, "more"), (1000, 4, "less")], "k long, at int, v string"))
    after = t.manifest()
    assert len(touched) <= 2 and {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)} == {str(b) for b in touched}
    got = dict((k, v) for k, _, v in rows_of(t.read()))
    assert len(got) == 401 and got[7] == "new" and got[1000] == "more" and got[8] == "v8"
    # who read before still sees the table as it was
    assert dict((k, v) for k, _, v in rows_of(t.read(1)))[7] == "v7"
    t.update(spark.createDataFrame([(9, 9, "x")], "k long, at int, v string"))
    t.vacuum(keep=1)
    assert t.versions() == [3] and dict((k, v) for k, _, v in rows_of(t.read()))[9] == "x"
    kept = {f.partition("/")[0] for f in t.manifest()["folders"].values()}
    assert {p.name for p in (tmp_path / "t").glob("data-*")} == kept


def test_batches_count_once_and_races_are_merged(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["a", "b"], "at", buckets=4)
    rows = lambda *x: spark.createDataFrame(list(x), "a string, b int, at int, v double")
    t.update(rows(("x", 1, 1, 1.0), (None, None, 1, 5.0)), batch=0)
    t.update(rows(("x", 1, 1, 2.0)), batch=1)
    assert t.update(rows(("x", 1, 9, 99.0)), batch=1) == [] and t.update(rows(("x", 1, 9, 99.0)), batch=0) == []
    assert rows_of(t.read().select("v")) == [(2.0,), (5.0,)]
    # someone else takes the number while this update writes: it is merged again, on top
    claim, other = t._claim, BucketedTable(spark, str(tmp_path / "t"), ["a", "b"], "at", buckets=4)

    def late(m):
        t._claim = claim
        other.update(rows(("x", 1, 1, 3.0), ("y", 2, 1, 7.0)))
        return claim(m)

    t._claim = late
    t.update(rows(("z", 3, 1, 8.0)))
    assert rows_of(t.read().select("v")) == [(3.0,), (5.0,), (7.0,), (8.0,)] and t.versions() == [1, 2, 3, 4]
    assert t.update(rows().limit(0)) == [] and t.read().count() == 4


def test_an_empty_first_update(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["k"], "at")
    assert t.update(spark.createDataFrame([], "k long, at int")) == [] and t.read().count() == 0


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(9)
    return [(rng.choice("ab"), rng.randrange(12), rng.randrange(3)) for _ in range(300)]


def by_hand(rows, block, seed):
    mapping, label = day_map(sorted({d for _, d, _ in rows}), block, seed), {}
    for g, d, y in rows:
        label[g, d] = max(y, label.get((g, d), y))
    return sum(label.get((g, mapping[d])) == y for g, d, y in rows) / len(rows)


def test_a_stopped_run_goes_on(spark, tmp_path, samples):
    df = spark.createDataFrame(samples, "group string, day long, y int")
    draw, seeds = draws.permuted_agreement(df, 3), spark.range(1, 24).toDF("seed")
    asked = []

    def counted(some):
        asked.extend(r.seed for r in some.collect())
        return draw(some)

    store, settings = draws.DrawStore(spark, str(tmp_path / "d")), {"block": 3, "horizon": 24}
    part = store.fill(settings, seeds, counted, block=5, most_blocks=2)
    assert part.count() == 10 and store.missing(settings, seeds).count() == 13
    # draws of other settings, and a block that was written twice before the run died
    store.fill({"block": 4, "horizon": 24}, spark.range(1, 9).toDF("seed"), draws.permuted_agreement(df, 4))
    spark.read.parquet(store.path).where("seed < 4").write.mode("append").parquet(store.path)
    whole = {r.seed: r.value for r in store.fill({"horizon": 24, "block": 3}, seeds, counted, block=5).collect()}
    assert sorted(asked) == list(range(1, 24))  # none was drawn again
    assert whole == {s: pytest.approx(by_hand(samples, 3, s)) for s in range(1, 24)}
    at_once = {r.seed: r.value for r in draws.DrawStore(spark, str(tmp_path / "e")).fill(settings, seeds, draw).collect()}
    assert at_once == whole and store.fill(settings, seeds, counted).count() == 23 and len(asked) == 23
