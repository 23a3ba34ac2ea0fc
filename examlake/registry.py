"""Registered queries and their DuckDB SQL; modules of ``examlake.queries`` fill both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def load() -> None:
    """Import every module that registers queries."""
    from examlake.queries import assembly, content, ingest, layout, papers, parsed, patterns, questions, queue, replies, scalars, warehouse  # noqa: F401
