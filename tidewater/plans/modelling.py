"""Queries of splits, weights, fits and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.random import Mulberry32
from ..functions.scalars import DAY_MS, HOUR_MS, brier_term, round_half_up
from ..operators import labels as la
from ..operators import modelling as m
from ..operators.draws import DrawStore, permuted_agreement
from ..operators.scale import checkpointed, shared_folder
from ..operators.selection import equal_bins
from ..operators import ranking as k
from ..operators.gate import evaluate_gate
from .joins import spans
from .registry import query, r
from .scalars import FORECAST_SQL, forecast

col = F.col
r6 = round_half_up
T0 = 1_704_067_200_000
FOLDS = [(T0 + 10 * DAY_MS, T0 + 16 * DAY_MS), (T0 + 16 * DAY_MS, T0 + 22 * DAY_MS), (T0 + 22 * DAY_MS, T0 + 28 * DAY_MS)]
EMBARGO = 24 * HOUR_MS
FOLD_SQL = f"""s AS (SELECT event_id AS id, event_type AS g, (epoch_us(ts) // 1000) // {HOUR_MS} * {HOUR_MS} AS time, (epoch_us(ts) // 1000) // {HOUR_MS} * {HOUR_MS} + (user_id % 5 + 1) * {HOUR_MS} AS z FROM events),
fo(fold, a, b) AS (VALUES {', '.join(f'({i}, {a}, {z})' for i, (a, z) in enumerate(FOLDS))}),
x AS (SELECT id, fold, a, time, z, CASE WHEN time >= a THEN 'test' WHEN z <= a - {EMBARGO} THEN 'train' ELSE 'purged' END AS role FROM s, fo WHERE time < b)"""


def folds(t):
    return la.walk_forward(spans(t).withColumnRenamed("event_id", "id"), FOLDS, EMBARGO, earliest_test=FOLDS[0][0])


@query("mdl_1_walk_forward", f"WITH {FOLD_SQL} SELECT id, CAST(fold AS INT) AS fold, role FROM x")
def mdl_1(t):
    """Samples by fold; the first test must not begin before the days that the rules were chosen on have ended."""
    return folds(t).select("id", "fold", "role")


@query("mdl_2_fold_invariants", f"""WITH {FOLD_SQL}, y AS (SELECT * FROM x UNION ALL SELECT id, fold, a, a - {HOUR_MS}, a, 'train' FROM x WHERE id % 97 = 0 AND role = 'test'),
v AS (SELECT fold, id, 'train label reaches into the embargo' AS violation FROM y WHERE role = 'train' AND z > a - {EMBARGO} UNION ALL SELECT fold, id, 'test outside its block' FROM y WHERE role = 'test' AND (time < a OR time >= (SELECT b FROM fo WHERE fo.fold = y.fold))
UNION ALL SELECT fold, id, 'in both train and test' FROM y WHERE role IN ('train', 'test') GROUP BY 1, 2 HAVING count(DISTINCT role) = 2) SELECT CAST(fold AS INT) AS fold, id, violation FROM v""")
def mdl_2(t):
    """What is wrong with folds, here of some that leak: test samples that were also learnt from."""
    x = folds(t)
    leaked = x.where("role = 'test' and id % 97 = 0").withColumns({"role": F.lit("train"), "time": col("start") - HOUR_MS, "end": col("start")})
    return la.fold_violations(x.unionByName(leaked.select(x.columns)), EMBARGO)


@query("mdl_3_uniqueness", f"""WITH s AS (SELECT event_id AS id, event_type AS g, (epoch_us(ts) // 1000) // {HOUR_MS} * {HOUR_MS} AS a, (epoch_us(ts) // 1000) // {HOUR_MS} * {HOUR_MS} + (user_id % 5 + 1) * {HOUR_MS} AS z FROM events),
e AS (SELECT id, g, unnest(range(a, z, {HOUR_MS})) AS slot FROM s), n AS (SELECT g, slot, count(*) AS n FROM e GROUP BY 1, 2) SELECT id, {r('avg(1.0::DOUBLE / n)')} AS weight FROM e JOIN n USING (g, slot) GROUP BY 1""")
def mdl_3(t):
    return la.uniqueness(spans(t).withColumnRenamed("event_id", "id")).select("id", r6(col("weight")).alias("weight"))


@query("agg_18_effective_n", f"""WITH s AS (SELECT event_id AS id, event_type AS g, (epoch_us(ts) // 1000) // {HOUR_MS} * {HOUR_MS} AS a, (epoch_us(ts) // 1000) // {HOUR_MS} * {HOUR_MS} + (user_id % 5 + 1) * {HOUR_MS} AS z FROM events),
e AS (SELECT id, g, unnest(range(a, z, {HOUR_MS})) AS slot FROM s), n AS (SELECT g, slot, count(*) AS n FROM e GROUP BY 1, 2), u AS (SELECT id, g, avg(1.0::DOUBLE / n) AS weight FROM e JOIN n USING (g, slot) GROUP BY 1, 2)
SELECT g AS symbol, count(*) AS n, {r('sum(weight)', 4)} AS effective_n FROM u GROUP BY 1""")
def agg_18(t):
    """How many samples those are worth whose labels overlap: the sum of their weights."""
    x = spans(t).withColumnRenamed("event_id", "id")
    return la.uniqueness(x).groupBy(col("group").alias("symbol")).agg(F.count("*").alias("n"), r6(F.sum("weight"), 4).alias("effective_n"))


def training(t):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return t.embeddings.select("vec_id", x.alias("x"), (col("label") % 3).cast("int").alias("y"), F.lit(1.0).alias("w"))


@query("mdl_4_softmax_fit")
def mdl_4(t):
    model = m.fit_softmax(training(t).where("vec_id % 4 <> 0"), 3)
    return t.spark.createDataFrame([(i, [round(float(v), 6) for v in w]) for i, w in enumerate(model.weights)], "class int, weights array<double>")


@query("mdl_5_predict")
def mdl_5(t):
    x = training(t)
    model = m.fit_softmax(x.where("vec_id % 4 <> 0"), 3)
    p = x.where("vec_id % 4 = 0").withColumn("p", model.column(col("x")))
    return p.select("vec_id", "y", *(r6(col("p")[i]).alias(f"p{i}") for i in range(3)))


@query("mdl_6_random_baseline")
def mdl_6(t):
    """Skill of features that carry nothing, as many as a feature vector has: the mark that a model has to beat. All rows are learnt from or judged."""
    rows = training(t).select(col("vec_id").alias("id"), "y", "w", (col("vec_id") % 4 == 0).alias("test"))
    draws = m.random_baseline(rows, 3, 21, list(range(1, 41)))
    return draws.agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.percentile("value", F.lit(0.95))).alias("p95"))


def labelled_days(t):
    at = F.unix_millis(col("ts").cast("timestamp"))
    return t.events.select(col("event_type").alias("group"), at.alias("time"), F.floor(at / DAY_MS).alias("day"), (col("user_id") % 3).alias("y"))


@query("mdl_7_block_shift")
def mdl_7(t):
    x = m.block_shifted(labelled_days(t), seed=1)
    return x.groupBy("group", "y", "shifted").agg(F.count("*").alias("n"))


@query("mdl_8_day_permutation")
def mdl_8(t):
    x = m.day_permuted(t.spark, labelled_days(t), block=3, seed=1)
    return x.groupBy("group", "day").agg(F.max("permuted").alias("label"), F.count("*").alias("n"))


def day_stats(t):
    x = forecast(t).select((col("vec_id") % 4).alias("fold"), (col("vec_id") % 20).alias("day"), brier_term(col("p"), col("y")).alias("b"))
    return x.groupBy("fold", "day").agg(F.sum("b").alias("model"), (F.count("*") * 2 / 3.0).alias("base"))


@query("mdl_9_bootstrap")
def mdl_9(t):
    draws = m.bootstrap_skill(t.spark, day_stats(t), 500)
    return draws.agg(r6(F.percentile("value", F.lit(0.025))).alias("low"), r6(F.percentile("value", F.lit(0.975))).alias("high"))


#: Days of forecasts: what is learnt from, of which the last fifth calibrates, and what is judged.
DAYS, CALIBRATE, TEST = 20, 12, 15


def scored(t):
    """Forecasts of the last class with their day."""
    return forecast(t).select("vec_id", col("p")[2].alias("p"), F.when(col("y") == 2, 1.0).otherwise(0.0).alias("y"), "w", (col("vec_id") % DAYS).alias("day"))


SCORED_SQL = f"""{FORECAST_SQL}, sc AS (SELECT vec_id, p[3] AS p, CASE WHEN y = 2 THEN 1.0::DOUBLE ELSE 0.0 END AS y, w, vec_id % {DAYS} AS day FROM f)"""


@query("mdl_10_lift_interval")
def mdl_10(t):
    """How much more often the outcome is in the top tenth than in all and than in the bottom tenth, each with an interval over a thousand draws of days."""
    all_rows, draws = m.lift_draws(scored(t).select(col("vec_id").alias("id"), "p", col("y").alias("hit"), "w", "day"), 1000)
    out = [(name, round(float(all_rows[i]), 6), *(None if v is None else round(float(v), 6) for v in m.interval([d[i] for d in draws]))) for i, name in enumerate(("top over all", "top over bottom"))]
    return t.spark.createDataFrame(out, "lift string, value double, low double, high double")


@query("mdl_11_isotonic", f"""WITH {SCORED_SQL}, c AS (SELECT p, sum(w) AS w, sum(w * y) AS s, row_number() OVER (ORDER BY p) AS i FROM sc WHERE day >= {CALIBRATE} AND day < {TEST} GROUP BY 1), u AS (SELECT *, sum(w) OVER (ORDER BY i) AS cw, sum(s) OVER (ORDER BY i) AS cs FROM c),
mn AS (SELECT a.i AS a, k.i AS k, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) AS v FROM u a JOIN u k ON a.i <= k.i JOIN u b ON b.i >= k.i GROUP BY 1, 2), fit AS (SELECT u.p, max(v) AS v FROM mn JOIN u ON u.i = mn.k GROUP BY 1),
n AS (SELECT vec_id, sc.p, (SELECT max(p) FROM fit WHERE fit.p <= sc.p) AS lo, (SELECT min(p) FROM fit WHERE fit.p >= sc.p) AS hi FROM sc WHERE day >= {TEST})
SELECT vec_id, {r('CASE WHEN lo IS NULL THEN b.v WHEN hi IS NULL OR lo = hi THEN a.v ELSE a.v + (n.p - lo) / (hi - lo) * (b.v - a.v) END')} AS calibrated FROM n LEFT JOIN fit a ON a.p = lo LEFT JOIN fit b ON b.p = hi""")
def mdl_11(t):
    """Fitted on the last fifth of the days that are learnt from, applied to those that are judged."""
    x = scored(t)
    blocks = m.isotonic(x.where(col("day").between(CALIBRATE, TEST - 1)))
    return m.calibrated(x.where(col("day") >= TEST), blocks).select("vec_id", F.when(~F.isnan("calibrated"), r6(col("calibrated"))).alias("calibrated"))


@query("mdl_12_platt")
def mdl_12(t):
    """Two parameters on the log odds, fitted on the last fifth of the days that are learnt from, applied to those that are judged."""
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), col("p")))
    x = scored(t).select("vec_id", "day", F.array(F.log(p / (1 - p))).alias("x"), col("y").cast("int").alias("y"), "w")
    model = m.fit_softmax(x.where(col("day").between(CALIBRATE, TEST - 1)), 2, l2=1e-6)
    return x.where(col("day") >= TEST).select("vec_id", r6(model.column(col("x"))[1]).alias("calibrated"))


def calibration_error(x):
    """The expected gap between confidence and hit rate over bins of equal frequency (``vec_id, p, y``), as ``agg_14`` has it."""
    top = F.array_max("p")
    x = checkpointed(x.select("vec_id", top.alias("conf"), F.when(F.array_position("p", top) - 1 == col("y"), 1.0).otherwise(0.0).alias("hit")))
    bins = min(10, x.count() // 50)
    if bins < 2:
        return None
    e = equal_bins(x, bins, "conf", "vec_id").groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("conf") - F.avg("hit")).alias("gap"))
    return e.agg((F.sum(col("n") * col("gap")) / F.sum("n")).alias("ece")).first().ece


@query("mdl_13_nested_features")
def mdl_13(t):
    """The same days judged with one, three and all of the features of a vector: skill with its interval over days, calibration error, and lift."""
    rows, out = training(t).withColumn("day", (col("vec_id") % DAYS).cast("int")), []
    rates = rows.where(col("day") < TEST).groupBy("y").agg(F.sum("w").alias("w")).collect()  # three
    base = [sum(r_.w for r_ in rates if r_.y == i) / sum(r_.w for r_ in rates) for i in range(3)]
    for n in (1, 3, 21):
        some = rows.withColumn("x", F.slice("x", 1, n))
        model = m.fit_softmax(some.where(col("day") < TEST), 3)
        test = some.where(col("day") >= TEST).withColumn("p", model.column(col("x"))).drop("x").persist()
        days = test.groupBy((col("day") % 2).alias("fold"), "day").agg(F.sum(col("w") * brier_term(col("p"), col("y"))).alias("model"), F.sum(col("w") * brier_term(F.array(*map(F.lit, base)), col("y"))).alias("base"))
        total = days.agg((1 - F.sum("model") / F.sum("base")).alias("b")).first().b
        low, high = m.interval([r_.value for r_ in m.bootstrap_skill(t.spark, days, 300).collect()])
        lift, _ = m.lift_draws(test.select(col("vec_id").alias("id"), col("p")[2].alias("p"), F.when(col("y") == 2, 1.0).otherwise(0.0).alias("hit"), "w", "day"), 0)
        ece = calibration_error(test)
        test.unpersist()
        out.append((n, *(None if v is None or v != v else round(float(v), 6) for v in (total, low, high, ece, *lift))))
    return t.spark.createDataFrame(out, "features int, bss double, low double, high double, ece double, top_over_all double, top_over_bottom double")


@query("prj_21_generator")
def prj_21(t):
    """A Gaussian draw and a shuffle for each customer, whose key is the seed."""

    def draw(batches):
        for pdf in batches:
            of = [Mulberry32(int(seed)) for seed in pdf.seed]
            yield pdf.assign(value=[g.gaussian() + g.shuffled(list(range(10)))[0] for g in of])

    return t.customer.select(col("c_custkey").cast("long").alias("seed")).mapInPandas(draw, "seed long, value double").select("seed", r6(col("value")).alias("value"))


@query("snk_8_resumed_draws", "SELECT CAST(s AS BIGINT) AS seed FROM (SELECT unnest(range(1, 101)) AS s) WHERE s NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def snk_8(t):
    """Which draws a resumed run still has to make."""
    done = t.events.where("event_type = 'view'").select(col("event_id").alias("seed"), F.lit(24).alias("horizon"))
    other = t.events.where("event_type = 'click'").select(col("event_id").alias("seed"), F.lit(4).alias("horizon"))
    return m.missing_draws(done.unionByName(other), t.spark.range(1, 101).toDF("seed"), {"horizon": 24})


@query("snk_8_stored_draws")
def snk_8_stored(t):
    """A null distribution whose run was stopped and resumed: how well labels agree with those of permuted days, for each seed."""
    store, seeds = DrawStore(t.spark, f"{shared_folder(t.spark)}/draws"), t.spark.range(1, 41).toDF("seed")
    draw, settings = permuted_agreement(labelled_days(t), block=3), {"block": 3, "statistic": "agreement"}
    store.fill(settings, seeds, draw, block=15, most_blocks=1)
    return store.fill(settings, seeds, draw, block=15).select("seed", r6(col("value")).alias("value"))


@query("mdl_gate_report")
def gate_report(t):
    """The gate over a report of the forecasts: what it lacks is listed."""
    d = day_stats(t)
    by_fold = [row.b for row in d.groupBy("fold").agg((1 - F.sum("model") / F.sum("base")).alias("b")).orderBy("fold").collect()]
    total = d.agg((1 - F.sum("model") / F.sum("base")).alias("b"), F.count("*").alias("n")).first()
    ok, reasons = evaluate_gate({"folds": by_fold, "pooled": {"bss": total.b, "effective_test_n": total.n}, "random_p95": 0.0, "leak": "clean"})
    return t.spark.createDataFrame([(ok, i, x) for i, x in enumerate(reasons)], "pass boolean, i int, reason string")

