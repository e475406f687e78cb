"""The registry of named queries and of the SQL that states the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules whose import registers queries.
MODULES = tuple(f"sluice.plans.{m}" for m in ("flagship", "batch_queries", "numeric_queries", "text_queries", "metric_queries", "data_queries", "config_queries"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its DuckDB SQL if there is any."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(module)


def queries() -> dict[str, Query]:
    """All queries of the library's own operators."""
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    """The SQL of those queries that have one."""
    _load()
    return _ORACLES
