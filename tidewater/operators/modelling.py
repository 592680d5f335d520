"""Fitting and judging forecasts: softmax regression, calibration, controls and resampling.

Fits are Newton steps whose sums are taken by the tasks: a pass returns one small matrix for each task, whatever the rows. Resampling
works on sums by day, of which there are as many as days.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import Mulberry32


@dataclass
class Softmax:
    mean: np.ndarray
    sd: np.ndarray
    #: by class: bias, then one weight for each feature
    weights: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.sd]) @ self.weights.T
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def column(self, x: Column) -> Column:
        """array of probabilities of an array column, as an expression."""
        scaled = F.zip_with(F.zip_with(x, _literal(self.mean), lambda a, b: a - b), _literal(self.sd), lambda a, b: a / b)
        z = F.array(*(F.aggregate(F.zip_with(scaled, _literal(w[1:]), lambda a, b: a * b), F.lit(float(w[0])), lambda s, v: s + v) for w in self.weights))
        e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, u: s + u))


def _literal(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _summed(df: DataFrame, one, fan_in: int = 8) -> np.ndarray:
    """The sum over all tasks of the vector that ``one`` makes of a task's pandas batches; ``fan_in`` tasks add them up before the driver does."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        total = None
        for pdf in batches:
            if len(pdf):
                v = one(pdf)
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"v": [total.tobytes()]})

    def add(batches: Iterator) -> Iterator:
        import pandas as pd

        total = None
        for pdf in batches:
            for v in pdf.v:
                total = np.frombuffer(v) if total is None else total + np.frombuffer(v)
        if total is not None:
            yield pd.DataFrame({"v": [total.tobytes()]})

    parts = df.mapInPandas(run, "v binary").repartition(fan_in, F.spark_partition_id()).mapInPandas(add, "v binary")
    return sum(np.frombuffer(r.v) for r in parts.collect())


def fit_softmax(df: DataFrame, k: int, l2: float = 1.0, rounds: int = 25, tolerance: float = 1e-9) -> Softmax:
    """Weighted multinomial regression of ``y`` (0 to k - 1) on ``x`` (array<double>, no missing values) with weights ``w``.

    Features are standardised by weighted mean and deviation (1 if that is 0); biases carry no penalty. The loss is convex, so Newton steps, halved
    while they don't lower it, reach the same weights as any descent. An empty table gives a model without features, for which all classes are alike.
    """
    df = df.select("x", "y", "w").persist()
    try:
        one = df.first()
        if one is None:
            return Softmax(np.zeros(0), np.ones(0), np.zeros((k, 1)))
        d = len(one.x)
        m = df.agg(F.sum("w").alias("n"), *(F.sum(F.col("w") * F.col("x")[i]).alias(f"a{i}") for i in range(d)), *(F.sum(F.col("w") * F.col("x")[i] * F.col("x")[i]).alias(f"b{i}") for i in range(d))).first()
        mean = np.array([m[f"a{i}"] for i in range(d)]) / m.n
        var = np.array([m[f"b{i}"] for i in range(d)]) / m.n - mean**2
        model = Softmax(mean, np.where(var > 1e-24, np.sqrt(np.maximum(var, 0)), 1.0), np.zeros((k, d + 1)))
        size = k * (d + 1)
        penalty = np.tile(np.r_[0.0, np.full(d, l2)], k)

        def sums(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            now = Softmax(model.mean, model.sd, weights)

            def one(pdf) -> np.ndarray:
                x, y, w = np.vstack(pdf.x.to_numpy()), pdf.y.to_numpy().astype(int), pdf.w.to_numpy()
                p = now.probabilities(x)
                z = np.hstack([np.ones((len(x), 1)), (x - now.mean) / now.sd])
                miss = (p - np.eye(k)[y]) * w[:, None]
                hess = np.zeros((k, d + 1, k, d + 1))
                for a in range(k):
                    for b in range(k):
                        c = w * p[:, a] * ((a == b) - p[:, b])
                        hess[a, :, b, :] = (z * c[:, None]).T @ z
                return np.r_[-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum(), (miss.T @ z).ravel(), hess.ravel()]

            s = _summed(df, one) / m.n
            flat = weights.ravel()
            return s[0] + (penalty * flat**2).sum() / 2 / m.n, s[1 : size + 1] + penalty * flat / m.n, s[size + 1 :].reshape(size, size) + np.diag(penalty) / m.n

        loss, grad, hess = sums(model.weights)
        for _ in range(rounds):
            step = np.linalg.lstsq(hess + 1e-10 * np.eye(size), grad, rcond=None)[0].reshape(k, d + 1)
            scale = 1.0
            while True:
                trial = sums(model.weights - scale * step)
                if trial[0] <= loss or scale < 1e-4:
                    break
                scale /= 2
            done = loss - trial[0] < tolerance
            if trial[0] <= loss:
                model.weights, (loss, grad, hess) = model.weights - scale * step, trial
            if done:
                return model
        return model
    finally:
        df.unpersist()


#: x from, x to, sum of w * y, sum of w.
Block = tuple[float, float, float, float]


def _pooled(blocks: list[Block], new: Block) -> None:
    """Put a block behind those that rise already, and pool it with those before while they are not below it."""
    while blocks and blocks[-1][2] * new[3] >= new[2] * blocks[-1][3]:
        x = blocks.pop()
        new = (x[0], new[1], x[2] + new[2], x[3] + new[3])
    blocks.append(new)


def isotonic(df: DataFrame) -> list[Block]:
    """The rising function from ``p`` to ``y`` (weights ``w``) of least squares, exactly: by pooling adjacent violators.

    Rows are dealt to ranges of p and each task pools its own; what is pooled within a range is pooled in the whole too, so pooling the blocks that are
    left gives the same as pooling all rows. Blocks rise strictly, so of a yes-or-no outcome there are far fewer of them than rows.
    """

    def pool(batches: Iterator) -> Iterator:
        import pandas as pd

        blocks: list[Block] = []
        for pdf in batches:
            for p, s, w in pdf[["p", "s", "w"]].itertuples(index=False):
                _pooled(blocks, (p, p, s, w))
        yield pd.DataFrame(blocks, columns=["a", "b", "s", "w"])

    ties = df.groupBy("p").agg(F.sum(F.col("w") * F.col("y")).alias("s"), F.sum("w").alias("w"))
    local = ties.repartitionByRange("p").sortWithinPartitions("p").mapInPandas(pool, "a double, b double, s double, w double")
    blocks: list[Block] = []
    for r in local.orderBy("a").collect():
        _pooled(blocks, (r.a, r.b, r.s, r.w))
    return blocks


def calibrated(df: DataFrame, blocks: list[Block], column: str = "p", name: str = "calibrated") -> DataFrame:
    """``df`` with the mean of the block that ``column`` falls into; between blocks on the line from one to the next, clamped at the ends."""
    xs = [x for b in blocks for x in b[:2]]
    ys = [b[2] / b[3] for b in blocks for _ in (0, 1)]

    @F.pandas_udf("double")
    def at(p):
        import pandas as pd

        return pd.Series(np.interp(p.to_numpy(), xs, ys) if xs else np.full(len(p), np.nan))

    return df.withColumn(name, at(F.col(column).cast("double")))


def random_baseline(rows: DataFrame, k: int, width: int, seeds: list[int], rounds: int = 5, l2: float = 1.0) -> DataFrame:
    """``seed`` and ``value``: the skill of features that carry nothing, of the ``width`` of the real ones, for each seed.

    ``rows`` are ``id``, ``y`` (0 to k - 1), ``w`` and ``test``. A row's features are Gaussian numbers made of its id and the seed in the task that has the row.
    All seeds are fitted together, by Newton steps whose sums come from the tasks, and judged on all test rows against the base rates of the others.
    """
    size, d = k * (width + 1), width + 1
    penalty = np.tile(np.r_[0.0, np.full(width, l2)], k)
    rows = rows.select("id", "y", "w", "test").persist()

    def features(ids: np.ndarray, seed: int) -> np.ndarray:
        return np.hstack([np.ones((len(ids), 1)), gaussians(ids, seed, width)])

    def probabilities(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
        e = np.exp(z @ weights.T - (z @ weights.T).max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def step(weights: np.ndarray):
        def one(pdf) -> np.ndarray:
            ids, y, w = pdf.id.to_numpy().astype(np.int64), pdf.y.to_numpy().astype(int), pdf.w.to_numpy().astype(float)
            out = []
            for seed, now in zip(seeds, weights):
                z = features(ids, seed)
                p = probabilities(z, now)
                hess = np.empty((k, d, k, d))
                for i in range(k):
                    for j in range(k):
                        hess[i, :, j, :] = (z * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ z
                out += [((p - np.eye(k)[y]) * w[:, None]).T @ z, hess]
            return np.concatenate([x.ravel() for x in out])

        return one

    def judged(weights: np.ndarray, rates: np.ndarray):
        def one(pdf) -> np.ndarray:
            ids, truth, w = pdf.id.to_numpy().astype(np.int64), np.eye(k)[pdf.y.to_numpy().astype(int)], pdf.w.to_numpy().astype(float)
            brier = [(w * ((probabilities(features(ids, seed), now) - truth) ** 2).sum(axis=1)).sum() for seed, now in zip(seeds, weights)]
            return np.r_[brier, (w * ((rates - truth) ** 2).sum(axis=1)).sum()]

        return one

    try:
        train, test = rows.where("not test"), rows.where("test")
        rates = np.zeros(k)
        for r in train.groupBy("y").agg(F.sum("w").alias("w")).collect():
            rates[int(r.y)] = r.w
        weights = np.zeros((len(seeds), k, d))
        for _ in range(rounds):
            sums = _summed(train, step(weights)).reshape(len(seeds), size + size * size)
            for now, x in zip(weights, sums):
                grad, hess = x[:size] + penalty * now.ravel(), x[size:].reshape(size, size) + np.diag(penalty)
                now -= np.linalg.lstsq(hess + 1e-9 * np.eye(size), grad, rcond=None)[0].reshape(k, d)
        total = _summed(test, judged(weights, rates / rates.sum()))
    finally:
        rows.unpersist()
    return rows.sparkSession.createDataFrame([(s, float(1 - b / total[-1])) for s, b in zip(seeds, total)], "seed long, value double")


def gaussians(ids: np.ndarray, seed: int, width: int) -> np.ndarray:
    """Gaussian numbers of (id, seed, column): two hashed uniforms each, so that a row has the same ones wherever it is computed."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(2 * width, dtype=np.uint64) + np.uint64(1) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0xD1342543DE82EF95)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        u = ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.sqrt(-2 * np.log(np.maximum(u[:, :width], 1e-300))) * np.cos(2 * np.pi * u[:, width:])


def lift_draws(rows: DataFrame, draws: int, seed: int = 21, parts: int | None = None) -> tuple[tuple[float, float], list[tuple[float, float]]]:
    """(lift of all rows, lifts of draws): how far the rate of ``hit`` in the top tenth by ``p`` is above that of all, and above that of the bottom tenth.

    ``rows`` are ``id, p, hit`` (0 or 1), ``w`` and ``day``. Each draw takes whole days with replacement and sorts what it has anew. That needs no sort:
    rows are in ranges of p once, and of each range and day the counts are known, so a draw knows in which range its tenths end; only that range is walked,
    by the task that has it, for all draws that end there. The driver holds sums by range and day, and how often each draw has a day.
    """
    from .scale import by_ranges, checkpointed

    order = [F.col("p").desc(), F.col("id")]
    ranged = checkpointed(by_ranges(rows.select("id", "p", "hit", "w", "day"), parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part", "day").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("hit")).alias("h")).collect()
    days = sorted({r.day for r in sums})
    at, which = {day: i for i, day in enumerate(days)}, sorted({r.part for r in sums})
    table = np.zeros((len(which), len(days), 3))
    for r in sums:
        table[which.index(r.part), at[r.day]] = r.n, r.w, r.h
    g = Mulberry32(seed)
    times = np.array([np.ones(len(days), int)] + [np.bincount([int(g.uniform() * len(days)) for _ in days], minlength=len(days)) for _ in range(draws)])
    by_part = np.einsum("td,pdk->tpk", times, table)  # by draw and range: rows, weight, hits
    total = by_part.sum(axis=1)
    tenth = np.floor(total[:, 0] / 10).astype(int)
    jobs: dict[int, list[tuple[int, int, int]]] = {}
    sides = np.zeros((len(times), 2, 2))  # weight and hits of the top and the bottom
    for t in range(len(times)):
        for side in (0, 1):
            left = tenth[t]
            for q in range(len(which)) if side == 0 else reversed(range(len(which))):
                if left <= 0:
                    break
                n = int(by_part[t, q, 0])
                if n <= left:
                    sides[t, side] += by_part[t, q, 1:]
                else:
                    jobs.setdefault(which[q], []).append((t, side, int(left)))
                left -= n

    held = {q: by_part[:, i, 0] for i, q in enumerate(which)}

    def walk(batches: Iterator) -> Iterator:
        import pandas as pd

        got: dict[tuple[int, int], np.ndarray] = {}
        seen, part = np.zeros(len(times)), None  # of each draw, the rows of this range so far
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf.part.iloc[0])
            day, w = pdf.day.map(at).to_numpy(), pdf.w.to_numpy()
            h = w * pdf.hit.to_numpy()
            for t, side, need in jobs.get(part, []):
                m = times[t][day]
                upto = seen[t] + np.cumsum(m)
                # the first ``need`` rows of the range, or the last
                used = np.clip(need - (upto - m), 0, m) if side == 0 else np.clip(upto - (held[part][t] - need), 0, m)
                got[t, side] = got.get((t, side), np.zeros(2)) + [(used * w).sum(), (used * h).sum()]
            for t in {t for t, _, _ in jobs.get(part, [])}:
                seen[t] += times[t][day].sum()
        yield pd.DataFrame([(t, side, *v) for (t, side), v in got.items()], columns=["t", "side", "w", "h"])

    if jobs:
        for r in ranged.mapInPandas(walk, "t long, side long, w double, h double").collect():  # a row for each tenth
            sides[r.t, r.side] += r.w, r.h
    lifts = []
    for t in range(len(times)):
        (tw, th), (bw, bh) = sides[t]
        if tw > 0 and bw > 0:
            lifts.append((th / tw - total[t, 2] / total[t, 1], th / tw - bh / bw))
        elif t == 0:
            lifts.append((float("nan"), float("nan")))
    return lifts[0], lifts[1:]


def interval(values: list[float], low: float = 0.025, high: float = 0.975) -> tuple[float | None, float | None]:
    """The values at floor(q * n) of the sorted ones."""
    v = sorted(values)
    at = lambda q: v[min(len(v) - 1, max(0, int(q * len(v))))] if v else None
    return at(low), at(high)


def block_shifted(samples: DataFrame, seed: int) -> DataFrame:
    """``samples`` (``group, time, y``) with ``shifted``: the label of the same group a quarter to three quarters of its length later, cyclically.

    Groups of fewer than eight keep theirs. Offsets are hashes of (group, seed).
    """
    from .ranking import keyed_rank

    # positions by ranges of (group, time), so that no task holds a whole group
    x = keyed_rank(samples, "group", [F.col("time"), F.xxhash64(*samples.columns)], "_i").withColumn("_i", F.col("_i") - 1)
    x = x.join(x.groupBy("group").agg(F.count("*").alias("_n")), "group")
    u = F.pmod(F.xxhash64("group", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    x = x.withColumn("_from", F.when(F.col("_n") < 8, F.col("_i")).otherwise((F.col("_i") + F.floor(F.col("_n") / 4 + u * F.col("_n") / 2)) % F.col("_n")))
    source = x.select("group", F.col("_i").alias("_from"), F.col("y").alias("shifted"))
    return x.join(source, ["group", "_from"]).drop("_i", "_n", "_from")


def day_map(days: list[int], block: int, seed: int) -> dict[int, int]:
    """Each day's source day: blocks of consecutive days, shuffled by the seed."""
    days = sorted(days)
    blocks = [days[i : i + block] for i in range(0, len(days), block)]
    return dict(zip(days, [d for b in Mulberry32(seed).shuffled(blocks) for d in b]))


def day_permuted(spark: SparkSession, samples: DataFrame, block: int, seed: int) -> DataFrame:
    """``samples`` (``group, day, y``) with ``permuted``: the group's label of the day's source day, -1 without one. One map for all groups."""
    days = [r.day for r in samples.select("day").distinct().collect()]  # as many as days
    mapping = spark.createDataFrame(list(day_map(days, block, seed).items()), "day long, source long")
    by_day = samples.groupBy("group", F.col("day").alias("source")).agg(F.max("y").alias("permuted"))
    return samples.join(F.broadcast(mapping), "day").join(by_day, ["group", "source"], "left").withColumn("permuted", F.coalesce("permuted", F.lit(-1))).drop("source")


def per_seed(spark: SparkSession, seeds: list[int], draw) -> DataFrame:
    """``seed`` and ``value``: what ``draw`` gives for each seed, seeds spread over tasks."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(value=[draw(int(s)) for s in pdf.seed])

    return spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(min(len(seeds), 32), "seed").mapInPandas(run, "seed long, value double")


def bootstrap_skill(spark: SparkSession, days: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """Draws of the pooled skill from sums by day (``fold, day, model, base``), days resampled within their fold."""
    rows = days.orderBy("fold", "day").collect()  # as many as days
    folds: dict[int, list[tuple[float, float]]] = {}
    for x in rows:
        folds.setdefault(x.fold, []).append((x.model, x.base))

    def draw(s: int) -> float:
        g, total, n = Mulberry32(s), 0.0, 0
        for of in folds.values():
            picked = [of[int(g.uniform() * len(of))] for _ in of]
            total += (1 - sum(m for m, _ in picked) / sum(b for _, b in picked)) * len(of)
            n += len(of)
        return total / n

    return per_seed(spark, list(range(seed, seed + draws)), draw)


def missing_draws(done: DataFrame, seeds: DataFrame, settings: dict[str, int]) -> DataFrame:
    """The seeds that a run with these settings has not drawn yet; draws of other settings don't count."""
    same = F.lit(True)
    for k, v in settings.items():
        same = same & (F.col(k) == v)
    return seeds.join(done.where(same).select("seed"), "seed", "left_anti")
