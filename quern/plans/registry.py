"""All registered queries of the key-value operators, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("keyspace", "strings", "bits", "collections", "zsets", "sketches", "series", "places", "documents", "streams", "events")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    """Register a query with the SQL that must agree with it, if SQL can say it."""
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"quern.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
