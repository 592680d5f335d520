"""Registration of queries, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query of ``Tables`` under a name, with its SQL where SQL can express it."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r(expr: str, digits: int = 6) -> str:
    """SQL that rounds as ``functions.scalars.round_half_up`` does."""
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"


K = "CAST(regexp_extract(props, '[0-9]+') AS INT)"


def bars_sql(step_ms: int, every: bool = False, name: str = "bars", market: bool = False) -> str:
    """A common table expression with the bars that ``operators.bars.from_events`` makes: by event type, or of all (``every``), or both (``market``)."""
    symbol = "'ALL'" if every else "event_type"
    source = "(SELECT * FROM events UNION ALL SELECT * REPLACE ('ALL' AS event_type) FROM events)" if market else "events"
    return f"""{name} AS (
      SELECT {symbol} AS symbol, (epoch_us(ts) // 1000) // {step_ms} * {step_ms} AS t, first(value ORDER BY ts, event_id) AS o, max(value) AS h, min(value) AS l,
             last(value ORDER BY ts, event_id) AS c, sum(value) AS v, sum(CASE WHEN {K} >= 50 THEN value ELSE 0 END) AS tb, count(*) AS trades
      FROM {source} GROUP BY 1, 2)"""
