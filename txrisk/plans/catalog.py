"""Registry of named queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load() -> None:
    """Import every module that registers queries."""
    from txrisk.plans import (  # noqa: F401
        catalog_features,
        catalog_history,
        catalog_learning,
        catalog_monitoring,
        catalog_profiles,
        catalog_scores,
        catalog_sources,
        catalog_streams,
        catalog_texts,
    )
