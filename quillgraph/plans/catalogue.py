"""All registered queries of the engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans import adjudicate, evaluation, evaluations, lookups, maintenance, registry, retrieval, roundtrips, structure, upkeep, walks  # noqa: F401  (they register)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name of query."""
    return registry.ORACLE
