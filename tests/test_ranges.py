"""Work on ranges of a key: as-of joins, overlaps and ranks of a key that has most rows, for any number of ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import joins, labels, ranking
from tidewater.operators import modelling as m

HOUR = 3_600_000


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_as_of_over_ranges(spark, parts):
    rng = random.Random(5)
    key = lambda: "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
    left = [(i, key(), rng.randrange(120)) for i in range(250)]
    right = [(key(), rng.randrange(-5, 120, 9), rng.choice([None, rng.randrange(5)])) for _ in range(60)]
    l = spark.createDataFrame(left, "i long, k string, t long").repartition(3)
    r = spark.createDataFrame(right, "k string, at long, v long").repartition(2)
    got = {x.i: x.v for x in joins.as_of(l, r, "k", "t", "at", ["v"], parts).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        of = [(at, v is not None, v or 0) for q, at, v in right if q == k and at <= t]
        assert got[i] == ((max(of)[2] if max(of)[1] else None) if of else None)


@pytest.mark.parametrize("parts", [None, 1, 9])
def test_overlap_weights_are_means_over_slots(spark, parts):
    """Spans of an hour to a year; the rows that are made are as many as the spans' ends."""
    rng = random.Random(6)
    spans = []
    for i in range(150):
        a = rng.randrange(0, 9_000) * HOUR
        spans.append((i, rng.choice(["g", "g", "g", "h", None]), a, a + rng.choice([1, 3, 50, 24 * 365]) * HOUR))
    spans += [(200, "g", 0, 0), (201, "lone", 5 * HOUR, 6 * HOUR)]
    got = {r.id: r.weight for r in labels.uniqueness(spark.createDataFrame(spans, "id long, group string, time long, end long"), parts).collect()}
    held = {}
    for _, g, a, z in spans:
        c = held.setdefault(g, np.zeros(20_000))
        c[a // HOUR : z // HOUR] += 1
    for i, g, a, z in spans:
        want = None if a == z else float((1 / held[g][a // HOUR : z // HOUR]).mean())
        assert got[i] == (None if want is None else pytest.approx(want))
    rows = joins.overlaps(spark.createDataFrame(spans, "id long, group string, time long, end long"), parts).count()
    assert rows <= 2 * len(spans)


def test_counts_of_slots_over_ranges(spark):
    spans = [("x", a, a + 5) for a in range(0, 300, 2)]
    got = {r.slot: r.n for r in joins.overlap_counts(spark.createDataFrame(spans, "group string, time long, end long"), 1).collect()}
    assert got == {s: n for s in range(303) if (n := sum(a <= s < z for _, a, z in spans))}


@pytest.mark.parametrize("parts", [None, 1, 11])
def test_ranks_within_keys_over_ranges(spark, parts):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 10 else rng.choice(["a", None]), rng.randrange(9)) for i in range(400)]
    got = {r.i: r.place for r in ranking.keyed_rank(spark.createDataFrame(rows, "i long, k string, v long").repartition(4), "k", [F.col("v"), F.col("i")], "place", parts).collect()}
    for k in ("hot", "a", None):
        mine = sorted((v, i) for i, q, v in rows if q == k)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))


def test_nothing_to_fit(spark):
    model = m.fit_softmax(spark.createDataFrame([], "x array<double>, y int, w double"), 3)
    assert model.weights.shape == (3, 1) and not model.weights.any()
    assert joins.overlaps(spark.createDataFrame([], "group string, time long, end long")).count() == 0
