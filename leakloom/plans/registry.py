"""Registered queries and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from leakloom.plans.fixtures import duck_sql, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register a query function; `views` are put in front of the twin as CTEs."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(list(views), sql) if views else duck_sql(sql)
        return function
    return register


def sql_list(values) -> str:
    return ", ".join(sql_text(v) for v in values)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
