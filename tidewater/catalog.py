"""All queries of the market operators, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import aggregates, dedup, joins, modelling, ranking, rules, scalars, sequences, sources, streams, traders, windows
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "aggregates", "dedup", "joins", "modelling", "ranking", "rules", "scalars", "sequences", "sources", "streams", "traders", "windows"]

FLAGSHIP = "rnk_1_squeeze_ranking"
