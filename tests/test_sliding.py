"""Sliding order statistics against brute force: single tiles and many, gaps, missing values, ties, odd columns."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import sliding as sl

STEP = 3_600_000


def test_sorted_window_like_a_list():
    rng = random.Random(1)
    window, plain = sl.SortedWindow(4), []
    for _ in range(3_000):
        if plain and rng.random() < 0.45:
            x = rng.choice(plain)
            window.remove(x)
            plain.remove(x)
        else:
            x = float(rng.randrange(-20, 20))
            window.add(x)
            plain.append(x)
        plain.sort()
        y = rng.randrange(-22, 22) / 2
        assert len(window) == len(plain) and window.rank(y) == (sum(v < y for v in plain), sum(v <= y for v in plain))
        assert window.rank(y, lambda v: v / 3) == (sum(v / 3 < y for v in plain), sum(v / 3 <= y for v in plain))
        if plain:
            assert window.median() == (plain[(len(plain) - 1) // 2] + plain[len(plain) // 2]) / 2 and window[len(plain) - 1] == plain[-1]


def series(seed, n, values, gaps=0.02, missing=0.02):
    rng, t, out = random.Random(seed), rng_start(seed), []
    for _ in range(n):
        t += STEP * (1 if rng.random() > gaps else rng.randrange(2, 9))
        x = float(rng.randrange(values)) + 1
        out.append((t, rng.choice([None, math.nan, math.inf]) if rng.random() < missing else x))
    return out


def rng_start(seed):
    return (seed * 977 - 1500) * STEP  # before 1970 too


def frame_of(rows, i, n):
    """The last n rows if they are all finite and a step apart."""
    f = rows[max(0, i - n + 1) : i + 1]
    ok = len(f) == n and all(x is not None and math.isfinite(x) for _, x in f) and f[-1][0] - f[0][0] == (n - 1) * STEP
    return [x for _, x in f] if ok else None


def mid(x, xs):
    return 100.0 * (sum(v < x for v in xs) + 0.5 * sum(v == x for v in xs)) / len(xs)


def median(xs):
    s = sorted(xs)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def by_hand(rows, i, n, slots, least, longest):
    xs, t = frame_of(rows, i, n), rows[i][0]
    earlier = [x for _, x in rows[max(0, i - n) : i] if x is not None]
    now = rows[i][1]
    share = 100.0 * sum(x <= now for x in earlier) / len(earlier) if len(earlier) >= 3 and now is not None else (0.0 if len(earlier) >= 3 else None)
    if xs is None:
        return None, share, None, None
    by = {}
    for k, x in enumerate(xs):
        by.setdefault((t // STEP - n + 1 + k) % slots, []).append(x)
    dry = None
    if all(len(v) >= least for v in by.values()):
        ratios = [x / median(by[(t // STEP - n + 1 + k) % slots]) for k, x in enumerate(xs)]
        dry = mid(ratios[-1], ratios)
    m, run = median(xs), 0
    while run < min(longest, n) and xs[-1 - run] < m:
        run += 1
    return mid(xs[-1], xs), share, dry, float(run)


@pytest.mark.parametrize("tile,values", [(4096, 5), (1, 1000), (40, 3)])
def test_like_brute_force_at_every_seam(spark, tile, values):
    """The smallest tiles are eight windows wide, so each series crosses many of them."""
    n, slots, least, longest = 12, 4, 3, 7
    every = {f"s{k}": series(k, 400, values) for k in range(3)} | {None: series(7, 150, values, gaps=0)}
    rows = [(s, t, x, f"note {t}") for s, v in every.items() for t, x in v]
    df = spark.createDataFrame(rows, "symbol string, t long, x double, note string").withColumns({"_t": F.lit(1), "_row": F.lit("y")}).orderBy(F.rand(1))
    measures = {"rank": sl.mid_rank("x", n), "dry": sl.dry_up("x", n, slots, least), "run": sl.run_below_median("x", n, longest)}
    got = {(r.symbol, r.t): r for r in sl.sliding(df, measures, STEP, tile=tile).collect()}
    share = {(r.symbol, r.t): r.share for r in sl.sliding_rows(df.where("not isnan(x) or x is null").where("x is null or x < 1e300"), {"share": sl.share_at_most("x", n, 3)}, "symbol", [F.col("t")], tile).collect()}
    assert len(got) == len(rows)
    for s, v in every.items():
        for i, (t, _) in enumerate(v):
            r = got[s, t]
            rank, _, dry, run = by_hand(v, i, n, slots, least, longest)
            assert (r.rank, r.dry, r.run) == (rank, dry, run) and r.note == f"note {t}" and r._row == "y"
        finite = [(t, x) for t, x in v if x is None or math.isfinite(x)]
        for i, (t, _) in enumerate(finite):
            assert share[s, t] == by_hand(finite, i, n, slots, least, longest)[1]


def test_one_series_is_spread_and_copies_are_few(spark):
    df = spark.range(20_000).select(F.lit("a").alias("symbol"), (F.col("id") * STEP).alias("t"), F.rand(1).alias("x"))
    out = sl.sliding(df, {"r": sl.mid_rank("x", 50)}, STEP, tile=400)
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan and "collect_list" not in plan and plan.count("Exchange") <= 2
    assert out.count() == 20_000
    tiles = out.select(F.floor(F.col("t") / (400 * STEP))).distinct().count()
    assert tiles == 50  # each a task's work of its own


def test_nothing_and_rows_without_a_time(spark):
    df = spark.createDataFrame([], "symbol string, t long, x double")
    assert sl.sliding(df, {"r": sl.mid_rank("x", 3)}, STEP).collect() == []
    df = spark.createDataFrame([("a", None, 1.0), ("a", 0, 1.0)], "symbol string, t long, x double")
    assert [(r.t, r.r) for r in sl.sliding(df, {"r": sl.mid_rank("x", 1)}, STEP).collect()] == [(0, 50.0)]


@pytest.mark.parametrize("tile_days", [None, 1])
def test_funding_z_like_brute_force(spark, tile_days):
    """Decisions over many tiles, rows whose interval changes at the next, gaps, and decisions at settlements' own times."""
    from tidewater.operators import funding

    rng = random.Random(11)
    rows, at = [], []
    for s in ("A", "B"):
        t = -40 * 24
        for _ in range(500):
            t += rng.choice([4, 4, 4, 4, 8, 3, 30] if rng.random() < 0.1 else [4])
            rows.append((s, t * STEP, rng.gauss(0, 1e-4)))
        at += [(s, rng.randrange(-40 * 24, 50 * 24) * STEP) for _ in range(80)] + [(s, rows[-7][1])]
    normal = funding.normalised(spark.createDataFrame(rows, "symbol string, time long, rate double"))
    of = [r.asDict() for r in normal.collect()]
    days, least, span = 10, 20, 8
    got = {(r.symbol, r.at): r.z for r in funding.z_scores(spark.createDataFrame(at + at[:5], "symbol string, at long"), normal, 1e-9, days, least, span, tile_days=tile_days).collect()}
    assert set(got) == set(at)
    some = 0
    for s, a in at:
        seen = sorted((r["time"], r["daily"]) for r in of if r["symbol"] == s and a - days * 24 * STEP < r["time"] <= a and (r["next_time"] is None or r["next_time"] > a or r["next_hours"] == r["hours"]))
        if len(seen) < least or seen[-1][0] - seen[0][0] < span * 24 * STEP or a - seen[-1][0] > 9 * STEP:
            assert got[s, a] is None
            continue
        v = sorted(x for _, x in seen)
        q = lambda p: v[int((len(v) - 1) * p)] + ((len(v) - 1) * p % 1) * (v[min(len(v) - 1, int((len(v) - 1) * p) + 1)] - v[int((len(v) - 1) * p)])  # noqa: B023, E731
        z = (seen[-1][1] - q(0.5)) / max(q(0.75) - q(0.25), 1e-9)
        assert got[s, a] == pytest.approx(max(-5, min(5, z)))
        some += 1
    assert some > 40
