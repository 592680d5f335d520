"""Processors with state of their own: rows of a key in order of their time, timers, and state that goes when its key is idle.

Rows are held until the watermark has passed them, so that those of a key are taken in order however they arrived; rows that are later than the watermark are dropped by
Spark. Timers wake a key when rows that it holds have become safe, or when nothing has come for long enough to forget it. State is kept in RocksDB, which these processors need.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.structure import Zigzag

DAY_MS = 86_400_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class InOrder(StatefulProcessor):
    """Rows of a key, the time in milliseconds first, in order; subclasses say what one does to the state.

    Rows are the fields ``columns`` (of the types in ``row``); ``state`` is a schema whose last field is the time of the row that came last. A row that comes twice counts once.
    A key whose next row comes ``idle_ms`` or more after its last, or has not come when the watermark is that far, is expired and forgotten.
    """

    columns: list[str]
    row: str
    state: str
    out: list[str]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.row)
        self.now = handle.getValueState("now", self.state)

    def step(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def expired(self, key: tuple, state: tuple) -> list[tuple]:
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        new = [tuple(v.item() if hasattr(v, "item") else v for v in r) for pdf in rows for r in pdf[self.columns].itertuples(index=False, name=None)]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, new: list[tuple], watermark: int) -> Iterator:
        import pandas as pd

        rows = sorted({*(tuple(r) for r in self.held.get()), *new}) if self.held.exists() else sorted(set(new))
        safe = [r for r in rows if r[0] <= watermark]
        rest = rows[len(safe) :]
        state = tuple(self.now.get()) if self.now.exists() else None
        out = []
        for r in safe:
            if state is not None and r[0] - state[-1] >= self.idle_ms:
                out += self.expired(key, state)
                state = None
            state, found = self.step(key, state, r)
            out += found
        if state is not None and not rest and state[-1] + self.idle_ms <= watermark:
            out += self.expired(key, state)
            state = None
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(rest[0][0])
        elif self.held.exists():
            self.held.clear()
        if state is not None:
            self.now.update(state)
            self.handle.registerTimer(state[-1] + self.idle_ms)
        elif self.now.exists():
            self.now.clear()
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


class Positions(StatefulProcessor):
    """Changes of users' positions in symbols between one tick and the next, for a shard of the keys at once.

    A tick is compared with the one before it, so a shard's ticks are sorted and compared as columns. What a shard holds is two tables, as bytes of Arrow: ticks that the watermark hasn't passed, and
    the last tick of each open position. A call for each key would cost some milliseconds, most of them for asking for its state.
    """

    key, tick = ["missing", "user", "name"], ["at", "event_id", "value", "long"]

    def __init__(self, idle_ms: int, threshold: float):
        self.idle_ms, self.threshold = idle_ms, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")
        self.now = handle.getValueState("now", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        yield self._advance([pdf[self.key + self.tick] for pdf in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield self._advance([], timerValues.getCurrentWatermarkInMs())

    def _advance(self, new: list, watermark: int):
        import pandas as pd

        rows = [*self._read(self.held), *new]
        if rows:
            rows = pd.concat(rows, ignore_index=True).drop_duplicates()
            safe, rest = rows[rows["at"] <= watermark], rows[rows["at"] > watermark]
        else:
            safe = rest = pd.DataFrame(columns=self.key + self.tick)
        before = self._read(self.now)
        states, found = self._compared(before[0] if before else None, safe)
        if len(states):  # a position without a tick that waits ends when it is idle
            waiting = pd.MultiIndex.from_frame(states[self.key]).isin(pd.MultiIndex.from_frame(rest[self.key]))
            idle = ~waiting & (states["at"].to_numpy() + self.idle_ms <= watermark)
            found.append(states[idle].assign(type="expired", order=len(rows)))
            states, waiting = states[~idle], waiting[~idle]
        ends = [int(rest["at"].min())] if len(rest) else []
        if len(states) and not waiting.all():
            ends.append(int(states["at"][~waiting].min()) + self.idle_ms)
        self._write(self.held, rest)
        self._write(self.now, states)
        self._wake(min(ends, default=None))
        out = pd.concat([x[[*self.key, "type", "at", "order"]] for x in found], ignore_index=True) if found else pd.DataFrame(columns=[*self.key, "type", "at", "order"])
        out = out.sort_values("order", kind="stable")
        user = out["user"].astype("Int64").mask((out["missing"].astype("int64") & 1) > 0)
        name = out["name"].astype(object).mask((out["missing"].astype("int64") & 2) > 0, None)
        return pd.DataFrame({"user_id": user, "symbol": name, "type": out["type"], "at": out["at"].astype("int64")})

    def _compared(self, before, safe):
        """The last tick of each open position, and tables of changes, with their ``order``."""
        import numpy as np
        import pandas as pd

        if not len(safe):
            return (safe if before is None else before), []
        x = safe.assign(old=False).sort_values([*self.key, *self.tick], kind="stable")
        x = x if before is None else pd.concat([before.assign(old=True), x], ignore_index=True).sort_values(self.key, kind="stable")  # a key's state comes first
        x = x.reset_index(drop=True).assign(order=lambda x: np.arange(len(x)))
        by = x.groupby(self.key, sort=False)
        at, value, side, old = (x[c].to_numpy() for c in ("at", "value", "long", "old"))
        first = by.cumcount().to_numpy() == 0
        back = np.maximum(np.arange(len(x)) - 1, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            is_open = value > 0
            had = ~first & is_open[back]
            gone = had & (at - at[back] >= self.idle_ms)
            had &= ~gone
            far = np.abs(value - value[back]) / value[back] >= self.threshold
        same = had & is_open & (side == side[back])
        kind = np.select([had & ~is_open, is_open & ~had & ~old, had & is_open & (side != side[back]), same & far & (value > value[back]), same & far], ["closed", "opened", "reversed", "increased", "reduced"], "")
        expired = x[gone].assign(type="expired", at=at[back][gone])
        found = [expired, x.assign(type=kind)[kind != ""]]
        last = np.append(first[1:], True)
        return x.loc[last & is_open, self.key + self.tick], found

    def _read(self, state) -> list:
        import pyarrow as pa

        return [pa.ipc.open_stream(state.get()[0]).read_pandas()] if state.exists() else []

    def _write(self, state, table) -> None:
        import pyarrow as pa

        if len(table):
            arrow, sink = pa.Table.from_pandas(table, preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, arrow.schema) as out:
                out.write_table(arrow)
            state.update((sink.getvalue().to_pybytes(),))
        elif state.exists():
            state.clear()

    def _wake(self, at: int | None) -> None:
        """One timer, for what is to be done first."""
        timers = set(self.handle.listTimers())
        for t in timers - {at}:
            self.handle.deleteTimer(t)
        if at is not None and at not in timers:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Swings(InOrder):
    """Zigzag swings of a symbol's bars as they are confirmed."""

    columns, row = ["t", "h", "l"], "t long, h double, l double"
    state = "direction int, hi long, high double, lo long, low double, at long"
    out = ["symbol", "t", "price", "type", "confirmed"]

    def __init__(self, idle_ms: int, threshold: float):
        super().__init__(idle_ms)
        self.threshold = threshold

    def step(self, key, state, row):
        t, h, l = row
        if state is not None and t <= state[5]:  # another version of a bar that is through
            return state, []
        z = Zigzag(1.0)
        if state is not None and state[2] is not None:
            z.direction, hi, high, lo, low, _ = state
            z.high, z.low = (hi, high), (lo, low)
        z.n = t
        swing = z.feed(h, l, self.threshold)
        now = (z.direction, *(z.high or (None, None)), *(z.low or (None, None)), t)
        return now, [(key[0], swing[0], swing[1], swing[2], t)] if swing else []


def _timed(df: DataFrame, at: str, late: str) -> DataFrame:
    return df.withWatermark(at, late)


def position_changes(events: DataFrame, threshold: float = 0.3, idle_ms: int = 30 * DAY_MS, late: str = "10 minutes", shards: int = 1024) -> DataFrame:
    """``user_id, symbol, type, at`` (ms): changes of each user's position in each symbol, ticks in order of (time, event_id).

    A tick of value 0 or less, or without one, closes the position; a position that no tick has touched for ``idle_ms`` of event time is given out as "expired" and forgotten.
    Users' symbols are dealt to ``shards``, whose number a checkpoint keeps. To be started within ``state_in_rocksdb``.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    missing = F.when(F.col("user_id").isNull(), 1).otherwise(0) + F.when(F.col("event_type").isNull(), 2).otherwise(0)
    x = _timed(events, "ts", late).select(
        F.pmod(F.xxhash64("user_id", "event_type"), F.lit(shards)).cast("int").alias("shard"), missing.alias("missing"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user"), F.coalesce("event_type", F.lit("")).alias("name"),
        "ts", F.unix_millis("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"), F.coalesce(k >= 50, F.lit(False)).alias("long"),
    )
    return x.groupBy("shard").transformWithStateInPandas(Positions(idle_ms, threshold), "user_id long, symbol string, type string, at long", "append", "EventTime")


def swings(bars: DataFrame, threshold: float, idle_ms: int = 30 * DAY_MS, late: str = "10 minutes") -> DataFrame:
    """``symbol, t, price, type, confirmed`` of each symbol's bars (``symbol, t, h, l``; t in ms), bars in order of time, each once.

    A bar counts once the watermark, ``late`` behind the newest bar, has passed its time. A symbol without a bar for ``idle_ms`` is forgotten. To be started within ``state_in_rocksdb``.
    """
    x = _timed(bars.withColumn("ts", F.timestamp_millis("t")), "ts", late)
    return x.groupBy("symbol").transformWithStateInPandas(Swings(idle_ms, threshold), "symbol string, t long, price double, type string, confirmed long", "append", "EventTime")
