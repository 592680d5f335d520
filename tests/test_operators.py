"""Literal cases of the operators: missing values, gaps, ties, and what must not be seen."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars as s
from tidewater.functions import windows as w
from tidewater.functions.random import Mulberry32
from tidewater.operators import aggregates, bars, cycles, dedup, funding, joins, labels, modelling, ranking, rules, selection
from tidewater.operators.gate import evaluate_gate

H, D = s.HOUR_MS, s.DAY_MS


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def series(spark, closes, symbol="X", step=H, skip=()):
    return spark.createDataFrame([(symbol, i * step, float(c) + 1, float(c) - 1, float(c), 10.0 + i) for i, c in enumerate(closes) if i not in skip], "symbol string, t long, h double, l double, c double, v double")


def test_numbers_from_text(spark):
    x = spark.createDataFrame([(v,) for v in ("1.5", "", None, "NaN", "Infinity", "abc", " 2 ")], "v string")
    assert values(x, s.to_number(F.col("v"))) == [1.5, None, None, None, None, None, 2.0]


def test_rounding_goes_up_at_halves(spark):
    x = spark.createDataFrame([(-2.5,), (2.5,), (None,)], "v double")
    assert values(x, s.round_half_up(F.col("v"), 0)) == [-2.0, 3.0, None]


def test_change_needs_a_positive_base(spark):
    x = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (None, 1.0), (1.0, -1.0)], "a double, b double")
    assert values(x, s.change(F.col("a"), F.col("b"))) == [None, 100.0, None, None]


def test_impossible_flow_is_missing(spark):
    x = spark.createDataFrame([("UM", 10.0, 4.0), ("UM", 10.0, 11.0), ("UM", None, 1.0), ("CM", 3.0, 1.0)], "f string, total double, buy double")
    row = {"quote_volume": F.col("total"), "taker_quote": F.col("buy"), "volume": F.col("total"), "taker_base": F.col("buy")}
    got = values(x, s.candle_flow(F.col("f"), row, F.lit(2.0), F.lit(100.0)))
    assert [g and tuple(g) for g in got] == [(8.0, 12.0, -4.0, 20.0), None, None, (100.0, 200.0, -100.0, 300.0)]


def test_direction_of_posts(spark):
    cases = {"buy": 1, "Do not buy": 0, "sell now": -1, "buy or sell": 0, "why?": 0, "belonging": 0, "看涨": 1, "不看涨": 0, "": 0, "LONG": 1}
    x = spark.createDataFrame([(k,) for k in cases], "t string")
    assert dict(values(x, "t", s.direction(F.col("t")))) == cases


def test_raw_candles(spark):
    def row(i, close="11", quote="55", end=None):
        return ("X", "UM", 1.0, 1.0, str(i * H), "10", "12", "9", close, "5", str(i * H + H - 1 if end is None else end), quote, "7", "2", "22", "0")

    schema = "symbol string, family string, fx double, contract_size double, " + ", ".join(f"{c} string" for c in bars.RAW)
    whole = bars.from_raw(spark.createDataFrame([row(2), row(0), row(1), row(3)], schema), 3 * H, H)  # out of order; the last closes too late
    assert values(whole.orderBy("t"), "t", "contiguous") == [(0, True), (H, True), (2 * H, True)]
    assert values(whole.limit(1), "flow.net") == [-11.0]
    gap = bars.from_raw(spark.createDataFrame([row(0), row(2)], schema), 3 * H, H)
    assert set(values(gap, "contiguous")) == {False}
    odd = bars.from_raw(spark.createDataFrame([row(0, close="0"), row(1, quote=""), row(2, end=0)], schema), 3 * H, H)
    assert values(odd, "t", "flow") == [(H, None)]


def test_coarser_bars_need_whole_groups(spark):
    x = series(spark, range(1, 10), skip=(5,)).withColumns({"o": F.col("c"), "tb": F.lit(0.0), "trades": F.lit(1)})
    assert values(bars.coarser(x, H, 4), "t", "o", "c") == [(0, 1.0, 4.0)]


def test_windows_are_exact(spark):
    x = series(spark, [1, 2, 4, 8, 16], skip=(2,))
    x = x.select("t", w.contiguous(F.col("t"), 2, H).alias("ok"), w.exact_change(1, H).alias("p"), w.mean_of("v", 3).alias("m")).orderBy("t")
    assert values(x, "ok", "p", "m") == [(False, None, None), (True, 100.0, None), (False, None, 34 / 3), (True, 100.0, 38 / 3)]


def test_a_missing_value_breaks_a_mean(spark):
    x = series(spark, [1, 2, 3, 4]).withColumn("v", F.when(F.col("t") != H, F.col("v")))
    assert values(x.select("t", w.mean_of("v", 2).alias("m")).orderBy("t"), "m") == [None, None, None, 12.5]


def test_midrank_counts_ties_half(spark):
    x = series(spark, [5, 5, 7, 5]).select("t", w.midrank("c", 4).alias("m")).orderBy("t")
    assert values(x, "m") == [None, None, None, 100 * 1.5 / 4]


def test_ema_and_rsi_against_loops(spark):
    rng = random.Random(0)
    c = [50 + rng.gauss(0, 1) for _ in range(30)]
    got = series(spark, c).select("t", w.ema("c", 5, 30).alias("e"), w.rsi("c", 14, 30).alias("r")).orderBy(F.desc("t")).first()
    e = sum(c[:5]) / 5
    for v in c[5:]:
        e += 2 / 6 * (v - e)
    gain = loss = 0.0
    for i in range(1, 30):
        d = c[i] - c[i - 1]
        up, down = max(d, 0), max(-d, 0)
        gain, loss = (gain + up / 14, loss + down / 14) if i <= 14 else ((gain * 13 + up) / 14, (loss * 13 + down) / 14)
    assert got.e == pytest.approx(e) and got.r == pytest.approx(100 - 100 / (1 + gain / loss))


def test_window_functions_see_no_future(spark):
    rng = random.Random(1)
    c = [50 + rng.gauss(0, 1) for _ in range(60)]
    f = lambda x: {r.t: tuple(r) for r in x.select("t", w.midrank("c", 20).alias("m"), w.ema("c", 5, 20).alias("e"), w.streak("c", 10).alias("s")).collect()}
    whole, cut = f(series(spark, c)), f(series(spark, c[:40]))
    assert all(whole[t] == cut[t] for t in cut)


def test_streaks(spark):
    x = series(spark, [1, 1, 1, 1, 1]).withColumn("n", F.element_at(F.array(*map(F.lit, (1.0, 2.0, -1.0, -2.0, 0.0))), (F.col("t") / H + 1).cast("int")))
    assert values(x.select("t", w.streak("n", 5).alias("s")).orderBy("t"), "s") == [1, 2, -1, -2, 0]


def test_as_of_takes_the_last_not_later(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 10)], "k string, t long")
    right = spark.createDataFrame([("a", 6, 1.0), ("a", 10, 2.0), ("a", 11, 3.0)], "k string, at long, v double")
    assert sorted(values(joins.as_of(left, right, "k", "t", "at", ["v"]), "k", "t", "v"), key=str) == [("a", 10, 2.0), ("a", 5, None), ("b", 10, None)]


def test_overlaps_by_sums_of_ends(spark):
    rng = random.Random(2)
    spans = [("g", a, a + rng.randint(1, 6)) for a in (rng.randint(0, 40) for _ in range(60))]
    want = {}
    for _, a, z in spans:
        for t in range(a, z):
            want[t] = want.get(t, 0) + 1
    got = joins.overlap_counts(spark.createDataFrame(spans, "group string, time long, end long"), 1)
    assert dict(values(got, "slot", "n")) == want


def test_position_changes(spark):
    schema = "address string, coin string, side string, notional double"
    a = spark.createDataFrame([("x", "A", "LONG", 100.0), ("x", "B", "LONG", 100.0), ("x", "C", "LONG", 100.0), ("x", "D", "LONG", 100.0), ("x", "E", "LONG", 100.0)], schema)
    b = spark.createDataFrame([("x", "A", "LONG", 130.0), ("x", "B", "LONG", 129.0), ("x", "C", "SHORT", 100.0), ("x", "E", "LONG", 60.0), ("x", "F", "LONG", 1.0), ("new", "A", "LONG", 5.0)], schema)
    assert dict(values(joins.position_changes(a, b), "coin", "type")) == {"A": "increased", "C": "reversed", "D": "closed", "E": "reduced", "F": "opened"}


def test_chained_duplicates(spark):
    rows = [(0, 1, "a", "s", "Hello"), (1, 1, "a", "s", "other"), (2, 2, "a", "s", " hello "), (3, 3, "a", "s", "OTHER"), (4, 4, "a", "s", " ")]
    posts = spark.createDataFrame([(*r, 50, None) for r in rows], "ordinal long, id long, author string, symbol string, text string, at long, duplicate_of long")
    # 1 repeats the id of 0, and so doesn't keep 3 out by its text
    assert sorted(values(dedup.clean_posts(posts, 100, 100), "ordinal")) == [0, 3]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 9), (2, "b", 1)], "k long, v string, n long")
    new = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (3, "e", 1)], "k long, v string, n long")
    assert sorted(values(dedup.upsert(old, new, ["k"], "n"), "k", "v")) == [(1, "d"), (2, "b"), (3, "e")]


def test_all_or_nothing(spark):
    x = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 2.0)], "k string, v double")
    assert dict(values(x.groupBy("k").agg(aggregates.sum_if_all(F.col("v")).alias("s")), "k", "s")) == {"a": None, "b": 3.0}


def test_global_rank_is_the_order(spark):
    x = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(97)))
    got = ranking.global_rank(x, [F.col("v"), F.col("id")], parts=7).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 1001)) and got[0]._rows == 1000
    assert [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)
    sizes = selection.equal_bins(x, 7, "v", "id").groupBy("bin").count().collect()
    assert sorted(r["count"] for r in sizes) == [142, 143, 143, 143, 143, 143, 143]


def pairs(n, start=0):
    return [(start + i * D + (0 if opens else H), opens, 1.0, 100.0, None if opens else 5.0) for i in range(n) for opens in (True, False)]


def test_cycles_after_a_known_flat_point():
    kinds = [c[-1] for c in cycles.walk(pairs(42), strict=True)]
    assert kinds.count("cycle") == 41 and kinds.count("boundary") == 1
    assert [c[-1] for c in cycles.walk(pairs(42), strict=False)].count("cycle") == 42


def test_cycle_cases():
    buy, sell = (lambda t, q: (t, True, q, 10.0, None)), (lambda t, q, p=1.0: (t, False, q, 10.0, p))
    flat = [buy(0, 1), sell(1, 1)]
    assert [c[-1] for c in cycles.walk([*flat, buy(2, 3), sell(3, 1), sell(4, 2)], True)] == ["boundary", "cycle"]
    assert [c[-1] for c in cycles.walk([*flat, buy(2, 1), sell(3, 5), sell(4, 1)], True)] == ["boundary", "unmatched", "unmatched"]
    assert [c[-1] for c in cycles.walk([*flat, buy(2, 1), sell(3, 5)], False)] == ["cycle", "unmatched", "cycle"]
    missing = [c for c in cycles.walk([*flat, buy(2, 2), sell(3, 1, None), sell(4, 1)], True) if c[-1] == "cycle"]
    assert missing[0][3] is None
    assert [c[-1] for c in cycles.walk([buy(0, 1)], True)] == ["open"]


def rates(spark, n, value=lambda i: 0.01, hours=8):
    return spark.createDataFrame([("X", i * hours * H, float(value(i))) for i in range(n)], "symbol string, time long, rate double")


def z_at(spark, x, at, floor=0.009):
    return funding.z_scores(spark.createDataFrame([("X", at)], "symbol string, at long"), funding.normalised(x), floor).first().z


def test_funding_z(spark):
    last = 119 * 8 * H
    assert z_at(spark, rates(spark, 120), last) == 0.0
    assert z_at(spark, rates(spark, 120, lambda i: 0.01 + (i == 119)), last) == 5.0
    assert z_at(spark, rates(spark, 120, lambda i: 0.01 - (i == 119)), last) == -5.0
    assert z_at(spark, rates(spark, 120), last + 10 * H) is None  # stale
    assert z_at(spark, rates(spark, 50), 49 * 8 * H) is None  # too few
    # a later row doesn't change what was known
    assert z_at(spark, rates(spark, 120, lambda i: 0.01 + (i == 119)), last - 8 * H) == 0.0


def test_interval_switch_drops_the_row_before_it_once_it_is_known(spark):
    times = [0, 4, 8, 12, 13, 14]
    x = funding.normalised(spark.createDataFrame([("X", h * H, 0.01) for h in times], "symbol string, time long, rate double"))
    assert sorted(values(x, "time", "hours")) == [(4 * H, 4), (8 * H, 4), (12 * H, 4), (13 * H, 1), (14 * H, 1)]
    assert sorted(values(funding.kept(x), "time")) == [4 * H, 8 * H, 13 * H, 14 * H]


def barrier(spark, moves, horizon=3, settled=None, skip=()):
    rows = [("X", i * H, 100.0 + up, 100.0 - down, 100.0, 1.0) for i, (up, down) in enumerate(moves) if i not in skip]
    x = spark.createDataFrame(rows, "symbol string, t long, h double, l double, c double, atr double")
    return labels.triple_barrier(x, horizon, H, 1.0, 0.0, settled).orderBy("t").first()


def test_triple_barrier(spark):
    calm = (0.2, 0.2)
    assert barrier(spark, [calm] * 4).label == "flat"
    assert barrier(spark, [calm, calm, (2, 0.2), (0.2, 9)]).label == "up"
    both = barrier(spark, [calm, (2, 2), calm, calm])
    assert (both.label, both.ambiguous, both.touch) == ("down", True, H)
    assert barrier(spark, [calm] * 3).label is None  # short
    assert barrier(spark, [calm] * 3, settled=F.lit(True)).label == "flat"
    assert barrier(spark, [calm] * 5, skip=(2,)).label is None  # gap
    assert barrier(spark, [calm, (2, 0.2), calm, calm, calm], skip=(2,)).label == "up"  # before the gap


def test_uniqueness_weights(spark):
    x = spark.createDataFrame([(1, "g", 0, 4), (2, "g", 2, 4), (3, "h", 0, 4)], "id long, group string, time long, end long")
    assert dict(values(labels.uniqueness(x), "id", "weight")) == {1: 0.75, 2: 0.5, 3: 1.0}


def test_softmax_finds_the_minimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (x @ [1.0, -1.0] + rng.normal(size=400) > 0).astype(int) + (x[:, 0] > 1)
    df = spark.createDataFrame([(row.tolist(), int(k), 1.0) for row, k in zip(x, y)], "x array<double>, y int, w double")
    m = modelling.fit_softmax(df, 3)
    p, z = m.probabilities(x), np.hstack([np.ones((400, 1)), (x - x.mean(axis=0)) / x.std(axis=0)])
    grad = (p - np.eye(3)[y]).T @ z + np.c_[np.zeros(3), m.weights[:, 1:]]
    assert np.abs(grad).max() < 1e-3
    got = np.array([r.p for r in df.select(m.column(F.col("x")).alias("p")).collect()])
    assert np.allclose(got, p)


def test_isotonic_rises(spark):
    df = spark.createDataFrame([(p / 100, float(p % 3 == 0 or p > 60), 1.0) for p in range(100)], "p double, y double, w double")
    blocks = modelling.isotonic(df)
    ys = [sy / w for _, _, sy, w in blocks]
    assert [a for a, *_ in blocks] == sorted(a for a, *_ in blocks) and ys == sorted(ys) and ys[0] < 0.5 < ys[-1]


def test_block_shift_keeps_the_labels_of_a_group(spark):
    x = spark.createDataFrame([("a", i, i % 3) for i in range(20)] + [("b", i, i) for i in range(5)], "group string, time long, y int")
    got = modelling.block_shifted(x, 1).orderBy("group", "time").collect()
    a = [r for r in got if r.group == "a"]
    assert sorted(r.shifted for r in a) == sorted(r.y for r in a) and [r.shifted for r in a] != [r.y for r in a]
    assert all(r.shifted == r.y for r in got if r.group == "b")


def test_generator_is_the_published_one():
    g = Mulberry32(1)
    assert [round(g.uniform(), 10) for _ in range(2)] == [0.6270739406, 0.0027357212]
    assert sorted(Mulberry32(3).shuffled(list(range(9)))) == list(range(9))


GOOD = {
    "folds": [0.02, 0.03, 0.01],
    "pooled": {"bss": 0.02, "residual_bss": 0.01, "ece": 0.01, "effective_n": 9000, "effective_test_n": 900, "test_span_days": 90, "class_counts": [300, 300, 300], "regime_days": {a: {"low": 40, "high": 40} for a in ("trend", "vol")}},
    "random_p95": 0.005, "leak": "clean", "universe": {"identified": 10, "obtained": 9, "unobtained": [{"symbol": "X", "reason": "no archive"}]},
}
SET = {"ece_max": 0.02, "min_class_samples": 100}


def test_the_gate_fails_closed():
    assert evaluate_gate(GOOD, SET) == (True, [])
    assert not evaluate_gate(GOOD)[0]  # thresholds that are not set
    assert not evaluate_gate(None, SET)[0] and not evaluate_gate({"pooled": 3, "folds": []}, SET)[0]
    for key, bad in (("bss", 0.004), ("residual_bss", 0.0), ("ece", math.nan), ("effective_n", None), ("class_counts", [1]), ("regime_days", {})):
        ok, why = evaluate_gate(GOOD | {"pooled": GOOD["pooled"] | {key: bad}}, SET)
        assert not ok and why, key
    for key, bad in (("leak", "inconclusive"), ("random_p95", None), ("universe", None), ("folds", [0.1, -0.1, 0.1])):
        assert not evaluate_gate(GOOD | {key: bad}, SET)[0], key


def test_early_score_needs_two_terms(spark):
    x = spark.createDataFrame([(0.06, 0.0, None, None, 0.0), (0.06, None, None, None, 0.0), (0.06, 0.0, 12.0, 60.0, 0.1)], "a double, b double, c double, d double, f double")
    assert values(x, rules.early_score(*(F.col(k) for k in "abcdf"))) == [55.0, None, 85.0]


def test_verdicts(spark):
    x = spark.createDataFrame([([True, True], [1, 1]), ([True, True], [1, -1]), ([True, False], [1, 1]), ([True, True], [1, 0]), ([True], [1])], "a array<boolean>, d array<int>")
    assert values(x, rules.verdict(F.col("a"), F.col("d"))) == ["aligned up", "conflict", "insufficient", "no consensus", "too few modules"]


def test_cycles_are_the_same_for_any_batches(spark):
    rng = random.Random(9)
    rows = [(tr, "S", "LONG", rng.random() < 0.5, float(rng.randint(1, 3)), 10.0, None if rng.random() < 0.1 else 1.0, i, i) for i in range(600) for tr in [rng.randint(0, 5)]]
    df = spark.createDataFrame(rows, "trader long, symbol string, side string, opens boolean, qty double, price double, pnl double, time long, ordinal long")
    for strict in (True, False):
        want = [(k, *c) for k in range(6) for c in cycles.walk([(r[7], *r[3:7]) for r in rows if r[0] == k], strict)]
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        try:
            got = [(r.trader, *tuple(r)[3:]) for r in cycles.cycles(df, strict).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(str, got)) == sorted(map(str, want))
