"""Streams with state: late and repeated rows, restarts, expiry, and sliding days of posts against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions.structure import Zigzag
from tidewater.operators import dedup
from tidewater.streaming import jobs, posts
from tidewater.streaming import stateful as st

HOUR, DAY = 3_600_000, 86_400_000
BARS = "symbol string, t long, h double, l double"


def run(stream, folder, out):
    """To the end of what is there, from the checkpoint of the run before."""
    with st.state_in_rocksdb(stream.sparkSession):
        q = stream.writeStream.foreachBatch(lambda batch, _: out.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def walk(seed, n, start=0):
    rng, p, out = random.Random(seed), 100.0, []
    for i in range(n):
        p += rng.gauss(0, 1)
        out.append((start + i * HOUR, p + 0.5, p - 0.5))
    return out


def swings_by_hand(bars, threshold):
    z = Zigzag(1.0)
    for t, h, l in bars:
        z.n = t
        z.feed(h, l, threshold)
    return z.swings


def test_bars_that_come_late_and_twice(spark, tmp_path):
    """Bars arrive in pieces, out of order across batches and some twice; the stream is stopped and started after each piece."""
    bars = walk(4, 150)
    order = sorted(range(150), key=lambda i: i + random.Random(i).randrange(-4, 5))  # at most eight hours late
    out, folder = [], str(tmp_path)
    for a, z in ((0, 40), (40, 41), (41, 100), (100, 150)):
        some = [("X", *bars[i]) for i in order[a:z]] + [("X", *bars[i]) for i in order[max(0, a - 3) : a]]
        spark.createDataFrame(some, BARS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(st.swings(spark.readStream.schema(BARS).parquet(f"{folder}/in"), 3.0, late="10 hours"), folder, out)
    safe = bars[-1][0] - 10 * HOUR  # what the watermark has passed
    want = swings_by_hand([b for b in bars if b[0] <= safe], 3.0)
    assert want and sorted(x[1:] for x in out) == sorted(want)


def test_state_of_idle_symbols_goes(spark, tmp_path):
    """A symbol that comes back after its state has gone begins anew."""
    first, second = walk(5, 60), walk(6, 60, start=40 * DAY)
    out, folder = [], str(tmp_path)
    tick = lambda at: [("clock", at, 1.0, 1.0)]
    for rows in ([("X", *b) for b in first], tick(30 * DAY), tick(31 * DAY), [("X", *b) for b in second], tick(60 * DAY), tick(61 * DAY)):
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(st.swings(spark.readStream.schema(BARS).parquet(f"{folder}/in"), 3.0, idle_ms=5 * DAY, late="1 hour"), folder, out)
    want = swings_by_hand(first, 3.0) + swings_by_hand(second, 3.0)
    assert sorted(x[1:] for x in out if x[0] == "X") == sorted(want)


def test_positions_in_order_close_and_expire(spark, tmp_path):
    def tick(i, at, user, value, k):
        return (i, 10**12 + at, user, "view", value, f'{{"k": {k}}}')

    batches = [
        # the third tick of user 1 arrives before the second
        [tick(1, 0, 1, 10.0, 60), tick(3, 20, 1, 9.0, 60), tick(2, 10, 1, 20.0, 60), tick(4, 15, 2, 5.0, 60)],
        [tick(1, 0, 1, 10.0, 60), tick(5, DAY, 1, 0.0, 60), tick(6, DAY + 1, 3, 1.0, 10)],
        [tick(7, 5 * DAY, 3, 1.0, 90)], [tick(8, 6 * DAY, 3, 2.0, 90)], [tick(9, 7 * DAY, 4, 1.0, 90)],
    ]
    out, folder = [], str(tmp_path)
    for rows in batches:
        x = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_millis("at").cast("timestamp_ntz"))
        x.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(st.position_changes(jobs.ticks(spark, f"{folder}/in"), idle_ms=2 * DAY), folder, out)
    of = lambda user: [x[2] for x in sorted(out, key=lambda x: x[3]) if x[0] == user]
    assert of(1) == ["opened", "increased", "reduced", "closed"] and of(2) == ["opened", "expired"]
    # user 3 was idle for four days: expired, and open again with the next tick
    assert of(3) == ["opened", "expired", "opened", "increased"]


def test_positions_in_shards_are_those_of_a_walk(spark, tmp_path):
    """Many keys in a few shards, some keys null, ticks without a value, ties in time, pauses, ticks that wait for the watermark of the next batch."""
    rng, idle, late = random.Random(7), 2 * DAY, 600_000
    ticks, at = [], 10**12
    for i in range(1500):
        at += rng.choice([0, 1, 60_000, 300_000, 3 * HOUR // 2])
        ticks.append((i, at, rng.choice([None, 0, *range(1, 25)]), rng.choice([None, "", "view", "click"]), rng.choice([None, -1.0, 0.0, 10.0, 11.0, 14.0, 20.0]), rng.choice(["{}", '{"k": 60}', '{"k": 10}'])))
    cut = next(i for i in range(800, 1500) if ticks[i][1] > ticks[i - 1][1])
    early = [x for x in ticks[:cut] if x[1] > ticks[cut - 1][1] - late + 1_000][::2]  # come with the next file
    for n, some in enumerate(([x for x in ticks[:cut] if x not in early], [*ticks[cut:], *early, ticks[-1]])):
        rng.shuffle(some)
        x = spark.createDataFrame(some, "event_id long, at long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_millis("at").cast("timestamp_ntz"))
        x.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    out = []
    stream = st.position_changes(jobs.ticks(spark, f"{tmp_path}/in/*"), idle_ms=idle, shards=3)
    run(stream, str(tmp_path), out)
    safe, want, open_ = at - late, [], {}
    for i, t, user, symbol, value, props in sorted(ticks, key=lambda x: (x[1], x[0])):
        if t > safe:
            continue
        key, side, was = (user, symbol), "60" in props, open_.pop((user, symbol), None)
        if was and t - was[2] >= idle:
            want.append((*key, "expired", was[2]))
            was = None
        if value is None or value <= 0:
            want += [(*key, "closed", t)] if was else []
            continue
        open_[key] = (side, value, t)
        if was is None or was[0] != side:
            want.append((*key, "reversed" if was else "opened", t))
        elif abs(value - was[1]) / was[1] >= 0.3:
            want.append((*key, "increased" if value > was[1] else "reduced", t))
    later = {x[2:4] for x in ticks if x[1] > safe}
    want += [(*key, "expired", was[2]) for key, was in open_.items() if was[2] + idle <= safe and key not in later]
    assert early and {x[2] for x in want} == {"opened", "closed", "reversed", "increased", "reduced", "expired"}
    assert sorted(out, key=str) == sorted(want, key=str)


POSTS = "ordinal long, id long, author string, symbol string, text string, at timestamp, duplicate_of int"


def posts_of(spark, n=160):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        at = 1_700_000_000_000 + i * 20 * 60_000 + rng.randrange(60_000)
        rows.append((i, rng.choice([i, i, max(0, i - 3)]), rng.choice(["a", "b", None]), rng.choice(["X", None]), rng.choice(["same  text", "Same text ", f"own {i}", "", None]), at, rng.choice([None, None, None, 1])))
    return spark.createDataFrame(rows, POSTS.replace("timestamp", "long"))


def test_clean_posts_at_each_cutoff(spark, tmp_path):
    df = posts_of(spark)
    for i, (a, z) in enumerate(((0, 70), (70, 71), (71, 160))):
        df.where(F.col("ordinal").between(a, z - 1)).withColumn("at", F.timestamp_millis("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = []
    stream = posts.clean_posts(spark.readStream.schema(POSTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), late="30 minutes")
    run(stream, str(tmp_path), out)
    last = df.agg(F.max("at")).first()[0] - 30 * 60_000
    cutoffs = sorted({x[0] for x in out})
    first = df.agg(F.min("at")).first()[0]
    assert cutoffs == list(range((first // HOUR + 1) * HOUR, last + 1, HOUR))
    for cutoff in cutoffs[:: len(cutoffs) // 6]:
        want = {r.ordinal for r in dedup.clean_posts(df, cutoff - 1, DAY - 1).collect()}
        assert {x[1] for x in out if x[0] == cutoff} == want and want


@pytest.mark.parametrize("pieces", [1, 3])
def test_posts_meet_their_evidence(spark, tmp_path, pieces):
    rng = random.Random(3)
    p = [(i, rng.choice("ab"), rng.choice(["X", None]), 1_700_000_000 + i * 3_600) for i in range(60)]
    e = [(rng.choice("ab"), rng.choice(["X", "Y", None]), 1_700_000_000 + rng.randrange(60) * 3_600, f"e{i}") for i in range(40)]
    ps, es = "ordinal long, author string, symbol string, at timestamp", "author string, symbol string, at timestamp, evidence string"
    out = []
    for k in range(pieces):
        lo, hi = (1_700_000_000 + 60 * 3_600 * j // pieces for j in (k, k + 1))
        for rows, schema, name, at in ((p, ps, "p", 3), (e, es, "e", 2)):
            some = [r for r in rows if lo <= r[at] < hi]
            spark.createDataFrame(some, schema.replace("timestamp", "long")).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = posts.with_evidence(spark.readStream.schema(ps).parquet(f"{tmp_path}/p"), spark.readStream.schema(es).parquet(f"{tmp_path}/e"))
        run(stream.select("ordinal", "evidence"), str(tmp_path), out)
    want = {(i, x) for i, a, s, t in p for b, y, u, x in e if a == b and s == y and s and t - DAY // 1000 <= u <= t}
    assert set(out) == want and len(out) == len(want) and want
