"""Queries of this subpackage by name, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def load() -> None:
    """Import all query modules of this subpackage."""
    from articleflow.llm import (  # noqa: F401
        queries_filters,
        queries_native,
        queries_search,
        queries_tokens,
    )
