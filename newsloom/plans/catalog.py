"""Registry of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans.tables import Tables
from newsloom.session import configure

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the tables under a name, with the SQL that must agree."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = build
        if sql is not None:
            _ORACLES[name] = sql
        return build

    return register


def _load() -> None:
    from newsloom.plans import (board_queries, event_queries, graph_queries,  # noqa: F401
                                input_queries, series_queries, stream_queries, text_queries,
                                vector_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def runner(build):
        return lambda spark, folder: build(Tables(configure(spark), folder))

    return {name: runner(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
