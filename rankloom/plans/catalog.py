"""All queries of the engine and their oracle SQL."""

from __future__ import annotations

from rankloom.plans import io_queries, retrieval_queries, scoring_queries, text_queries
from rankloom.plans.registry import Query

_PARTS = (retrieval_queries.R, text_queries.R, scoring_queries.R, io_queries.R)


def queries() -> dict[str, Query]:
    return {name: q for part in _PARTS for name, q in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}
