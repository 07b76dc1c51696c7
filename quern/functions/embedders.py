"""Registry of functions that turn a payload into a vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REGISTRY: dict[str, Callable[[Column], Column]] = {}


def register(name: str, make: Callable[[Column], Column]) -> None:
    """``make`` maps a payload column to an ``array<double>`` column: an expression, or a pandas UDF."""
    _REGISTRY[name.lower()] = make


def names() -> list[str]:
    return sorted(_REGISTRY)


def from_json(payload: Column) -> Column:
    """An array of numbers, or an object with such an array as ``vector``."""
    return F.coalesce(F.from_json(payload, "array<double>"), F.from_json(payload, "struct<vector:array<double>>")["vector"])


def embed(rows: DataFrame, provider: str, payload: str = "payload") -> DataFrame:
    """``rows`` with ``embedding``."""
    if provider.lower() not in _REGISTRY:
        raise ValueError(f"no embedder {provider}")
    return rows.withColumn("embedding", _REGISTRY[provider.lower()](F.col(payload)))


register("json", from_json)
