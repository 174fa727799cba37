"""A registry of named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tok(x: str) -> str:
    """SQL of functions.text.tokens()."""
    return f"list_filter(string_split_regex(replace(lower(coalesce({x}, '')), '-', ' '), '\\s+'), lambda w: w <> '')"


def norm(x: str) -> str:
    """SQL of functions.text.normalized()."""
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
