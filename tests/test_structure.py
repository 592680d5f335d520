"""Swings, levels, ranges and sweeps, without Spark and with it."""

import math
import random

from tidewater.functions import structure as s
from tidewater.operators.structure import features, swings

PATH = [100, 102, 105, 104, 101, 98, 95, 97, 100, 104, 108, 106, 103]


def oscillating(n, seed):
    rng = random.Random(seed)
    c = [100 + 5 * math.sin(2 * math.pi * i / 40) + rng.uniform(-0.3, 0.3) for i in range(n)]
    half = [rng.uniform(0.3, 0.7) for _ in c]
    return [x + y for x, y in zip(c, half)], [x - y for x, y in zip(c, half)], c


def test_swings_are_confirmed_after_a_turn():
    z = s.Zigzag(1.0)
    for p in PATH:
        z.feed(p, p, 4.0)
    # the low at 95 is known only once price is back at 99 or above, the high at 108 at 104 or below
    assert [x[1:] for x in z.swings] == [(105, "high", 4), (95, "low", 8), (108, "high", 12)]
    assert all(x[3] > x[0] for x in z.swings)


def test_no_swing_without_atr():
    z = s.Zigzag(1.0)
    for p in PATH:
        z.feed(p, p, None)
    assert z.swings == []


def test_prefix_gives_the_same_swings():
    h, l, c = oscillating(300, 1)
    atr = s.atr_series(h, l, c, 14)
    whole = s.swings_of(h, l, atr, 2.0)
    for cut in (50, 120, 233):
        assert s.swings_of(h[:cut], l[:cut], atr[:cut], 2.0) == [x for x in whole if x[3] < cut]


def test_the_future_does_not_matter():
    h, l, c = oscillating(300, 2)
    p = s.PARAMS
    at = 230
    atr = s.atr_series(h, l, c, 14)
    before = s.features_at(at, h, l, c, atr, s.swings_of(h, l, atr, 2.0), p, 48)
    rng = random.Random(3)
    for i in range(at + 1, 300):
        h[i], l[i], c[i] = 300 + rng.random(), 1.0, 50 + rng.random()
    atr = s.atr_series(h, l, c, 14)
    assert s.features_at(at, h, l, c, atr, s.swings_of(h, l, atr, 2.0), p, 48) == before
    # and the check can fail: a change before the bar is seen
    l[at - 3] = 1.0
    atr = s.atr_series(h, l, c, 14)
    assert s.features_at(at, h, l, c, atr, s.swings_of(h, l, atr, 2.0), p, 48) != before


def test_an_oscillation_is_a_range():
    h, l, c = oscillating(260, 4)
    atr = s.atr_series(h, l, c, 14)
    r = s.range_at(250, h, l, c, atr, s.swings_of(h, l, atr, 2.0), s.PARAMS)
    assert r["state"] == "range" and 103 < r["top"] < 107 and 93 < r["bottom"] < 97 and r["containment"] > 0.9


def test_a_staircase_is_none_and_its_features_are_zero_not_missing():
    c = [100 + 0.8 * i + 6 * math.sin(2 * math.pi * i / 30) for i in range(260)]
    h, l = [x + 0.5 for x in c], [x - 0.5 for x in c]
    atr = s.atr_series(h, l, c, 14)
    f = s.features_at(250, h, l, c, atr, s.swings_of(h, l, atr, 2.0), s.PARAMS, 48)
    assert (f["state"], f["f1"], f["f3"]) == ("no_range", 0.0, 0.0)
    assert (f["f2_up"], f["f2_down"]) == (1, 0)


def test_few_swings_leave_structure_missing():
    c = [100.0 + i for i in range(260)]
    atr = s.atr_series([x + 1 for x in c], [x - 1 for x in c], c, 14)
    f = s.features_at(250, c, c, c, atr, s.swings_of(c, c, atr, 2.0), s.PARAMS, 48)
    assert f["f1"] == 0.0 and f["f2_up"] is None and f["f2_down"] is None


def test_short_history_is_unavailable():
    c = [100.0] * 50
    assert s.range_at(49, c, c, c, [1.0] * 50, [], s.PARAMS)["state"] == "unavailable"


def test_levels_chain_by_the_last_member():
    sw = [(i, p, "high", i + 1) for i, p in enumerate((10.0, 10.4, 10.8, 12.0, 12.3))]
    assert [(x["low"], x["high"], x["touches"]) for x in s.levels(sw, "high", 0.5, 2)] == [(10.0, 10.8, 3), (12.0, 12.3, 2)]


def test_spark_forms_agree_with_the_kernel(spark):
    h, l, c = oscillating(220, 5)
    bars = spark.createDataFrame([("X", i * 10, h[i], l[i], c[i]) for i in range(220)] + [("Y", i * 10, h[i], l[i], c[i]) for i in range(220) if i != 100], "symbol string, t long, h double, l double, c double")
    atr = s.atr_series(h, l, c, 14)
    got = sorted((r.t // 10, r.price, r.type, r.confirmed // 10) for r in swings(bars).where("symbol = 'X'").collect())
    assert got == sorted(s.swings_of(h, l, atr, 2.0))
    f = {(r.symbol, r.t): r for r in features(bars, 168, 48, 10).collect()}
    assert f["X", 2190].state == "range" and f["X", 2190].f1 is not None
    assert f["X", 1000].state == "unavailable" and f["X", 1000].f1 is None
    assert f["Y", 2190].reason == "bars missing where the structure is looked for"
