"""Rules on literal cases, and fits against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import structure as s
from tidewater.functions import windows as w
from tidewater.functions.random import Mulberry32
from tidewater.operators import aggregates as a
from tidewater.operators import bars as b
from tidewater.operators import features as fe
from tidewater.operators import gate, guards
from tidewater.operators import labels as la
from tidewater.operators import modelling as m
from tidewater.operators import ranking as k
from tidewater.operators import traders as tr
from tidewater.operators.structure import features, snapshots
from tidewater.sources import files as f

H = 3_600_000


# --- windows


def test_gaps_and_numbers_that_are_none_make_windows_missing(spark):
    rows = [("X", i * H, float("nan") if i == 3 else float(i)) for i in range(20) if i != 12]
    x = spark.createDataFrame(rows, "symbol string, t long, c double")
    got = {r.t // H: tuple(r)[1:] for r in x.select("t", w.mean_of("c", 3, step_ms=H), w.midrank("c", 3, step_ms=H), w.ema("c", 2, 3, step_ms=H), w.rsi("c", 2, 3, step_ms=H)).collect()}
    for i, values in got.items():
        whole = i >= 2 and not {3, 12} & set(range(i - 2, i + 1))
        assert all((v is not None) == whole for v in values), i
    assert got[8][:2] == (7.0, 100 * 2.5 / 3)


# --- contracts that were taken off


def hours(spark, live, delivery=None):
    rows = [("X", i * H, *([10.0 + i % 7] * 4 if not on else [10.0, 11.0 + i % 7, 9.0, 10.5]), 100.0 * on, 40 * on, delivery) for i, on in enumerate(live)]
    return spark.createDataFrame(rows, "symbol string, t long, o double, h double, l double, c double, v double, trades int, delivery long")


@pytest.mark.parametrize(
    ("live", "delivery", "want"),
    [
        ([1] * 10 + [0] * 24 + [1] * 3, None, (10, "signature", 27, 0)), ([1] * 10 + [0] * 23 + [1] * 3, None, (36, None, 0, 0)), ([1] * 10 + [0], None, (10, "trailing", 0, 1)), ([1] * 5 + [0] * 20 + [1] + [0] * 20, None, (26, "trailing", 0, 20)),
        ([1] * 20, 12 * H, (12, "delivery", 0, 0)), ([1] * 20, 12 * H + 1, (13, "delivery", 0, 0)), ([1] * 12 + [0] * 30, 12 * H, (12, "both", 30, 0)), ([1] * 10 + [0] * 4 + [1], 13 * H, (10, "delivery+trailing", 0, 3)),
    ],
)
def test_trimming(spark, live, delivery, want):
    r = b.trimmed(hours(spark, live, delivery), H, keep_partial_last=True).first()
    assert (r.kept, r.cut_by, r.by_signature, r.by_trailing) == want
    assert r.partial_last == (12 * H if delivery == 12 * H + 1 else None)
    whole = b.trimmed(hours(spark, live, delivery), H).first()
    assert whole.kept <= r.kept and whole.partial_last is None


# --- structure


def test_unknown_ranges_block_turns_and_odd_closes_are_passed_over():
    z = s.Zigzag(2.0)
    for p in (100, 90, 110, 80, 120):
        z.feed(p, p, float("nan"))
    assert z.swings == []
    path = [90, 102, 105, 104, 101, 98, 95, 97, 100, 104]
    plain, odd = s.Zigzag(1.0), s.Zigzag(1.0)
    for p in path:
        plain.feed(p, p, 4.0, p)
    for i, p in enumerate(path):
        odd.feed(1000.0 if i == 4 else p, p, 4.0, float("nan") if i == 4 else p)
    assert [x[1:3] for x in plain.swings] == [x[1:3] for x in odd.swings]
    pct = s.Zigzag(5.0, pct=True)
    for p in path:
        pct.feed(p, p, None, p)
    assert [x[1:] for x in pct.swings] == [(105, "high", 5), (95, "low", 8)]  # 98 is 6.7 % below 105, 100 5.3 % above 95
    h = [1.0, 2.0, float("nan"), 2.0, 2.0, 2.0]
    assert s.atr_series(h, [0.0] * 6, [1.0] * 6, 2) == [None, 1.5, None, None, 2.0, 2.0]


def test_snapshot_of_an_oscillation(spark):
    rng = random.Random(5)
    rows = []
    for i in range(260):
        c = 100 + 5 * math.sin(2 * math.pi * i / 40) + rng.uniform(-0.3, 0.3)
        rows.append(("X", i * H, c + 0.5, c - 0.5, c))
    x = spark.createDataFrame(rows, "symbol string, t long, h double, l double, c double")
    r = snapshots(x, 168).first()
    last = {q.t: q for q in features(x, 168, 48, H).collect()}[259 * H]
    assert (r.state, r.t, r.coverage) == ("range", 259 * H, 1.0) and r.containment == pytest.approx(last.f3) and (r.top, r.bottom) == (last.top, last.bottom)
    assert r.swing_count == len(r.swings) >= 4 and all(q.confirmed <= r.t and q.t > r.t - 168 * H for q in r.swings) and min(r.top_touches, r.bottom_touches) >= 2


# --- feature vector


def test_feature_vector_of_long_series(spark):
    rng = random.Random(6)
    rows = []
    for sym in ("A", "B", "C"):
        c = 100.0
        for i in range(380):
            o, c = c, c * math.exp(rng.gauss(0, 0.01))
            if not (sym == "C" and i == 370):
                rows.append((sym, i * H, o, max(o, c) * 1.002, min(o, c) * 0.998, c, 100.0 + rng.random(), 40.0 + rng.random()))
    bars = spark.createDataFrame(rows, "symbol string, t long, o double, h double, l double, c double, v double, tb double")
    market = bars.where("symbol = 'A'").withColumn("symbol", F.lit("M"))
    four = bars.where(F.col("t") % (4 * H) == 0)
    paid = spark.createDataFrame([("A", i * 8 * H, 0.0001) for i in range(10)], "symbol string, time long, rate double")
    got = {(r.symbol, r.t // H): r for r in fe.feature_vectors(bars, four, market, paid, 0.01, least_coins=2).collect()}
    r = got["A", 379]
    assert len(fe.FEATURES) == 21 and r.version == "features-v1" and set(r.missing) == set(r.reasons) == {c for c in fe.FEATURES if r[c] is None}
    assert list(r.missing) == [c for c in fe.FEATURES if c in r.missing]
    assert r.e1_rel_btc_24h == pytest.approx(0.0, abs=1e-9)  # the benchmark against itself
    mine = [x for x in rows if x[0] == "A"]
    tr_ = [max(h - l, abs(h - mine[i - 1][5]), abs(l - mine[i - 1][5])) if i else h - l for i, (_, _, _, h, l, *_) in enumerate(mine)]
    pct = [sum(tr_[i - 13 : i + 1]) / 14 / mine[i][5] * 100 for i in range(379 - 335, 380)]
    assert r.d1_vol_squeeze_pct == pytest.approx(100 * (sum(v < pct[-1] for v in pct) + 0.5 * sum(v == pct[-1] for v in pct)) / 336)
    limit = sorted(pct)[167:169]
    run = 0
    for v in reversed(pct[-168:]):
        if v >= sum(limit) / 2:
            break
        run += 1
    assert r.d3_compression_bars == run and r.d2_volume_dryup_pct is not None and r.c1_effort_vs_result is not None
    broken = got["C", 379]
    assert broken.reasons["d1_vol_squeeze_pct"] == "bars missing between the first and the last of the window" and broken.reasons["c2_sell_absorbed"] == "bars missing between the first and the last of the window"
    assert got["A", 100].reasons["d1_vol_squeeze_pct"].startswith("history too short: needs 14.5 days (349 bars), has 4.2 days (101 bars)")
    assert r.reasons["g2_btc_vol_regime"].startswith("history too short") and "a3_funding_z" in r.reasons


# --- traders


def test_relations_of_cycles(spark):
    rows = [("x", "LONG", 0, 100), ("x", "LONG", 130, 200), ("x", "SHORT", 250, 300), ("x", "LONG", 290, 400), ("y", "LONG", 401, 500), ("x", "SHORT", 460, 470)]
    x = spark.createDataFrame([(1, sym, side, o * 1000, c * 1000, i) for i, (sym, side, o, c) in enumerate(rows)], "id int, symbol string, side string, opened long, closed long, n int")
    r = tr.relations(x, "n").first()
    # reopened: 130 after 100; reversed: 250 after 200 and 460 after 400; 290 opens while the short of 250 is held
    assert (r.reopened, r.reversed, r.overlapping) == (1, 2, 1)
    t = tr.adjacent_reversals(x, "n").first()
    assert (t.adjacent, t.turned) == (5, 3)  # one opens before the other side has closed
    o = spark.createDataFrame([(1, "x", "LONG", "open", q, 1.0, at * 1000, i) for i, (q, at) in enumerate([(1.0, 0), (1.0005, 100), (1.0, 600), (2.0, 700), (2.0, 900)])], "id int, symbol string, side string, action string, qty double, price double, at long, n int")
    q = tr.repeats(o, "n").first()
    assert (q.comparable, q.repeated) == (3, 2)


# --- gate, guards, folds


def test_gate_rows_fail_closed(spark):
    good = {
        "bss": 0.05, "random_p95": 0.01, "residual_bss": 0.01, "ece": 0.01, "class_counts": [500, 500, 500], "folds": [0.1, 0.1, 0.1], "effective_n": 2000.0, "effective_test_n": 800.0, "test_span_days": 100.0, "same_cutpoints": True, "sampling_days": 1,
        **{x: 40.0 for x in gate.REGIMES}, "identified": 100, "obtained": 95, "listed": 5, "unexplained": 0, "leak": "clean",
    }
    schema = "bss double, random_p95 double, residual_bss double, ece double, class_counts array<long>, folds array<double>, effective_n double, effective_test_n double, test_span_days double, same_cutpoints boolean, sampling_days int, trend_low double, trend_high double, vol_low double, vol_high double, identified int, obtained int, listed int, unexplained int, leak string"
    limits = {"ece_max": 0.02, "min_class_samples": 100}
    why = lambda t=limits, **x: spark.createDataFrame([tuple((good | x).values())], schema).select(gate.reasons(t).alias("r")).first().r
    assert why() == [] and why({}) == ["limit ece_max has no number", "limit min_class_samples has no number"]
    assert why(bss=float("nan")) == ["skill missing"] and why(bss=0.005) == ["skill below baseline"] and why(random_p95=None) == ["baseline missing"] and why(folds=[0.1, None, 0.2]) == ["fold skill missing"]
    assert why(class_counts=[0, 5, 5]) == ["class without samples"] and why(vol_low=29.0) == ["regime vol low thin"] and why(leak=None) == ["control not clean"] and why(identified=None) == ["universe not stated"]
    assert why(obtained=80, listed=20) == ["delisted too few"] and why(listed=4) == ["unobtained not listed"] and why(unexplained=1) == ["unobtained unexplained"] and why(sampling_days=2) == ["test days not daily"]


def test_a_symbol_of_two_families_stops_the_job(spark):
    x = spark.createDataFrame([("a", "S", True), ("b", "S", False), ("b", "T", True)], "family string, symbol string, trading boolean")
    assert guards.universe(x).count() == 2
    with pytest.raises(Exception, match="more than one contract of the symbol S"):
        guards.universe(x.withColumn("trading", F.lit(True))).collect()


def test_folds_are_guarded_and_their_faults_named(spark):
    x = spark.createDataFrame([(i, i * 10, i * 10 + 5) for i in range(20)], "id int, time int, end int")
    with pytest.raises(ValueError):
        la.walk_forward(x, [(50, 80)], 10, earliest_test=60)
    y = la.walk_forward(x, [(100, 150), (150, 200)], 20, earliest_test=100)
    assert la.fold_violations(y, 20).count() == 0
    leaked = y.withColumn("role", F.when((F.col("id") == 9) & (F.col("fold") == 0), "train").otherwise(F.col("role")))
    assert [(r.id, r.violation) for r in la.fold_violations(leaked, 20).collect()] == [(9, "train label reaches into the embargo")]


# --- aggregates and ranks


def test_a_day_with_two_values_makes_its_universe_missing(spark):
    rows = [("a", "trend", 1, "low"), ("a", "trend", 2, "low"), ("a", "vol", 1, "high"), ("b", "trend", 1, "low"), ("b", "trend", 1, "high"), ("b", "vol", 1, "mid")]
    got = {(r.u, r.axis): (r.low, r.mid, r.high) for r in a.regime_days(spark.createDataFrame(rows, "u string, axis string, day int, bin string"), "u").collect()}
    assert got == {("a", "trend"): (2, 0, 0), ("a", "vol"): (0, 0, 1), ("b", "trend"): (None, None, None), ("b", "vol"): (None, None, None)}


def test_ranks_and_quantiles_of_large_keys(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.8 else rng.randrange(5), rng.choice([None, rng.randrange(50)]) if rng.random() < 0.1 else rng.randrange(50), i) for i in range(700)]
    x = spark.createDataFrame([(q, None if v is None else float(v), i) for q, v, i in rows], "k int, v double, i int")
    got = {r.i: r.place for r in k.keyed_rank(x, "k", [F.col("v").desc_nulls_last(), F.col("i")], "place", parts=7).collect()}
    for key in range(5):
        mine = sorted((q for q in rows if q[0] == key), key=lambda q: (q[1] is None, -(q[1] or 0), q[2]))
        assert [got[q[2]] for q in mine] == list(range(1, len(mine) + 1))
    for r in a.quantiles(x, "k", "v", low=0.1, mid=0.5, top=1.0).collect():
        v = [q[1] for q in rows if q[0] == r.k and q[1] is not None]
        assert (r.low, r.mid, r.top) == tuple(pytest.approx(np.quantile(v, p)) for p in (0.1, 0.5, 1.0))
    assert a.global_quantile(x, "v", 0.3).first().v == pytest.approx(np.quantile([q[1] for q in rows if q[1] is not None], 0.3))


# --- fits


def test_isotonic_is_exact(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60) / 60, float(rng.random() < 0.5), rng.choice([0.5, 1.0, 2.0])) for _ in range(300)]
    x = spark.createDataFrame(rows, "p double, y double, w double").repartition(7)
    blocks = m.isotonic(x)
    ps = sorted({p for p, _, _ in rows})
    sw = [sum(w_ for p, _, w_ in rows if p == q) for q in ps]
    sy = [sum(w_ * y for p, y, w_ in rows if p == q) for q in ps]
    mean = lambda i, j: sum(sy[i : j + 1]) / sum(sw[i : j + 1])
    want = [max(min(mean(i, j) for j in range(q, len(ps))) for i in range(q + 1)) for q in range(len(ps))]
    got = {r.p: r.calibrated for r in m.calibrated(spark.createDataFrame([(p,) for p in [*ps, -1.0, 2.0]], "p double"), blocks).collect()}
    assert [got[p] for p in ps] == pytest.approx(want) and (got[-1.0], got[2.0]) == (pytest.approx(want[0]), pytest.approx(want[-1]))


def test_lifts_of_draws_are_those_of_sorting_each(spark):
    rng = random.Random(7)
    rows = [(i, rng.random(), float(rng.random() < 0.4), rng.choice([1.0, 2.0]), rng.randrange(9)) for i in range(400)]
    x = spark.createDataFrame(rows, "id int, p double, hit double, w double, day int")
    whole, draws = m.lift_draws(x, 20, seed=5, parts=6)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    g = Mulberry32(5)
    for n in range(21):
        times = [1] * 9 if n == 0 else np.bincount([int(g.uniform() * 9) for _ in range(9)], minlength=9).tolist()
        many = [r for r in order for _ in range(times[r[4]])]
        rate = lambda of: sum(r[2] * r[3] for r in of) / sum(r[3] for r in of)
        tenth = len(many) // 10
        want = (rate(many[:tenth]) - rate(many), rate(many[:tenth]) - rate(many[-tenth:]))
        assert (whole if n == 0 else draws[n - 1]) == pytest.approx(want)


def test_random_features_are_the_same_wherever_they_are_made(spark):
    z = m.gaussians(np.arange(20_000), 3, 2)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs(np.corrcoef(z.T)[0, 1]) < 0.03
    x = spark.range(400).select("id", (F.col("id") % 3).cast("int").alias("y"), F.lit(1.0).alias("w"), (F.col("id") % 4 == 0).alias("test"))
    one, other = ({r.seed: r.value for r in m.random_baseline(x.repartition(n), 3, 3, [1, 2]).collect()} for n in (1, 5))
    assert one[1] == pytest.approx(other[1], abs=1e-9) and one[1] != one[2] and all(v < 0.05 for v in one.values())


# --- files and streams


def test_there_is_a_pointer_at_every_moment(spark, tmp_path):
    folder = f"{tmp_path}/p"
    f.publish(spark.range(3), folder, "one")
    (tmp_path / "p" / "latest-000000002.json").write_text('{"run": "one"}\n')  # someone else was faster
    f.publish(spark.range(5), folder, "two")
    assert sorted(q.name for q in (tmp_path / "p").glob("latest-*.json")) == [f"latest-{i:09d}.json" for i in (1, 2, 3)] and f.latest(spark, folder).count() == 5


# --- votes, settlements, grids


def test_votes_of_positions_and_flows(spark):
    from tidewater.operators import cycles as cy

    held = spark.createDataFrame([(1, "A", "LONG", 75.0), (1, "A", "SHORT", 0.0), (1, "B", "SHORT", 25.0), (2, "A", "SHORT", 10.0)], "trader long, symbol string, side string, cost double")
    orders = spark.createDataFrame(
        [(1, "A", "LONG", True, 10.0, 6.0, 5), (1, "A", "LONG", False, 10.0, 2.0, 6), (1, "C", "SHORT", True, 20.0, 1.0, 7), (1, "C", "SHORT", True, 99.0, 9.0, 1), (1, "C", "SHORT", True, 99.0, 9.0, 20)],
        "trader long, symbol string, side string, opens boolean, qty double, price double, time long",
    )
    got = {(r.trader, r.symbol): r for r in cy.votes(held, orders, 5, 10).collect()}
    assert got[1, "A"].holding == pytest.approx(math.sqrt(0.75)) and got[1, "B"].holding == pytest.approx(-0.5) and got[2, "A"].holding == -1.0
    # 60 bought and 20 sold of A, 20 sold of C: 80 and 20 of 100
    assert got[1, "A"].flow == pytest.approx(0.5 * math.sqrt(0.8)) and got[1, "C"].flow == pytest.approx(-math.sqrt(0.2)) and (got[1, "C"].orders, got[1, "C"].holding) == (1, None)


def test_intervals_against_the_truth(spark):
    from tidewater.operators.funding import interval_check

    hours = [0, 8, 16, 24, 28, 32, 33.5, 37.5, 41.5]
    truth = [8, 8, 8, 8, 4, 8, 4, 4, 4]
    r = interval_check(spark.createDataFrame([("X", int(h * H), t) for h, t in zip(hours, truth)], "symbol string, time long, truth int")).first()
    # kept are 8, 16, 28 and both 4-hour rows at the end: 24 is followed by another interval, 32 by none, 33.5 fits none
    assert (r.compared, r.matched, r.lagging, r.refused) == (5, 5, 0, 3)
    assert (r.refused_by_next, r.longer, r.shorter, r.broken) == (1, 0, 1, 1)


def test_points_of_a_grid_are_those_of_range_detection(spark):
    from tidewater.operators.structure import range_points

    rng = random.Random(8)
    c = [100 + 5 * math.sin(2 * math.pi * i / 40) + rng.uniform(-0.3, 0.3) for i in range(240)]
    h, l = [x + 0.5 for x in c], [x - 0.5 for x in c]
    x = spark.createDataFrame([("X", i * H, h[i], l[i], c[i]) for i in range(240)], "symbol string, t long, h double, l double, c double")
    atr = s.atr_series(h, l, c, 14)
    got = {(r.t // H, r.mult, r.tol): r for r in range_points(x, 84, 20, [1.5, 2.0], [0.5, 1.0]).collect()}
    assert len(got) == 4 * len(range(98, 240, 20))
    for (at, mult, tol), r in got.items():
        want = s.range_at(at, h, l, c, atr, s.swings_of(h, l, atr, mult), s.PARAMS | {"lookback": 84, "tol_atr": tol, "max_height_atr": math.inf})
        assert r.state == want["state"] and (r.height_atr, r.containment) == (want.get("height_atr"), want.get("containment"))
        assert r.touches == (min(want["top_touches"], want["bottom_touches"]) if want["state"] == "range" else None)
    assert any(r.state == "range" for r in got.values())
