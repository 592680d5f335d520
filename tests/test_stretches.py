"""A zigzag over stretches of bars, put together by their summaries, is that of the whole series, wherever it is cut; so are the features of tiles."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import structure as s
from tidewater.operators import structure as st


def prices(seed, n, odd=0.03, grid=None):
    rng, p, h, l, c, atr = random.Random(seed), 100.0, [], [], [], []
    for _ in range(n):
        p = max(1.0, p + rng.gauss(0, 1))
        a, b = p + rng.random(), p - rng.random()
        if grid:
            a, b = round(a * grid) / grid, round(b * grid) / grid
        x = [a, b, (a + b) / 2]
        if rng.random() < odd:
            x[rng.randrange(3)] = rng.choice([math.nan, math.inf])
        h.append(x[0]), l.append(x[1]), c.append(x[2])
        atr.append(None if rng.random() < odd else rng.choice([0.0, 0.5, 1.0, 1.5]))
    return h, l, c, atr


@pytest.mark.parametrize("pct", [False, True])
@pytest.mark.parametrize("grid", [None, 2, 8])
@pytest.mark.parametrize("seed", range(8))
def test_stretches_of_any_length(seed, grid, pct):
    """Coarse prices make ties of highs, lows and limits."""
    rng, n = random.Random(seed), 600
    h, l, c, atr = prices(seed, n, grid=grid)
    mult = rng.choice([0.5, 2.0, 4.0])
    whole, states = s.Zigzag(mult, pct), []
    for x in zip(h, l, atr, c):
        states.append((whole.direction, whole.high, whole.low))
        whole.feed(*x)
    states.append((whole.direction, whole.high, whole.low))
    for _ in range(25):
        a, z = sorted(rng.sample(range(n + 1), 2))
        d, high, low = states[a]
        if d == 0:
            continue
        part = s.Stretch(list(range(a, z)), h[a:z], l[a:z], c[a:z], atr[a:z], mult, pct)
        summary = json.loads(json.dumps(part.summary()))
        d_after, high_after, low_after = states[z]
        assert s.after(summary, d, *(high if d == 1 else low)) == (d_after, *(high_after if d_after == 1 else low_after))
        # far fewer numbers than bars
        assert sum(len(x) for of in summary.values() for x in of) <= 4 * (z - a)


def bars_of(seed, n, symbol, gaps=True):
    h, l, c, _ = prices(seed, n, odd=0.01)
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += 10 if not gaps or rng.random() > 0.004 else 30
        out.append((symbol, t, h[i], l[i], c[i]))
    return out


SCHEMA = "symbol string, t long, h double, l double, c double"


@pytest.mark.parametrize("pct", [False, True])
def test_swings_over_tiles(spark, pct):
    # the flat one has no swing for many tiles, and then some
    flat = [("F", i * 10, 50.0, 50.0, 50.0) for i in range(60)] + [("F", 600 + i * 10, 50.0 + 9 * (i % 7), 50.0 + 9 * (i % 7), 50.0) for i in range(40)]
    nothing = [("N", i * 10, math.nan, 1.0, 1.0) for i in range(30)] + [("N", 300 + i * 10, 5.0 + i % 9, 4.0 + i % 9, 5.0) for i in range(40)]
    rows = bars_of(1, 700, "A") + bars_of(2, 333, "B") + flat + nothing
    mult = 3.0 if pct else 1.5
    want = set()
    for symbol in "ABFN":
        of = [r for r in rows if r[0] == symbol]
        t, h, l, c = ([r[i] for r in of] for i in (1, 2, 3, 4))
        z = s.Zigzag(mult, pct)
        for x in zip(h, l, s.atr_series(h, l, c, 3), c):
            z.feed(*x)
        want |= {(symbol, t[i], p, kind, t[j]) for i, p, kind, j in z.swings}
    df = spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(2))
    got = [tuple(r) for r in st.swings(df, mult, 3, pct, tile=1).collect()]  # tiles of eight bars
    assert len(got) == len(set(got)) and set(got) == want and {x[0] for x in want} >= {"A", "B"}
    assert {tuple(r) for r in st.swings(df, mult, 3, pct).collect()} == want


def test_features_over_tiles(spark):
    rows = bars_of(3, 900, "A") + bars_of(4, 260, "B", gaps=False) + bars_of(5, 20, "S")
    p = s.PARAMS | {"lookback": 24, "atr_period": 3, "mult": 1.0, "tol_atr": 1.5}
    df = spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(3))
    got = {(r.symbol, r.t): r for r in st.features(df, 24, 9, 10, params=p, tile=1).collect()}
    assert len(got) == len(rows)
    need, kinds = 24 + 3 + 1, set()
    for symbol in "ABS":
        of = [r for r in rows if r[0] == symbol]
        t, h, l, c = ([r[i] for r in of] for i in (1, 2, 3, 4))
        atr = s.atr_series(h, l, c, 3)
        swings = s.swings_of(h, l, atr, p["mult"], c)
        for at in range(len(of)):
            r = got[symbol, t[at]]
            if at + 1 < need:
                assert r.reason == f"history too short: {need} bars needed"
                continue
            if t[at] - t[at - need + 1] != (need - 1) * 10:
                assert r.reason == "bars missing where the structure is looked for"
                continue
            x = s.features_at(at, h, l, c, atr, swings, p, 9)
            kinds.add(x["state"])
            for k in ("state", "reason", "top", "bottom", "f1", "f2_up", "f2_down"):
                assert r[k] == x.get(k), (symbol, at, k)
            assert r.f3 == (None if x["f3"] is None else pytest.approx(x["f3"]))
    assert kinds == {"range", "no_range", "unavailable"}


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert st.swings(none).collect() == [] and st.features(none, 24, 9, 10).collect() == []
