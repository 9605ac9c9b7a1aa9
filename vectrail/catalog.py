"""All registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("plans.retrieval", "plans.upkeep", "plans.route", "plans.tracks", "plans.splits", "plans.service", "plans.artifacts", "plans.journeys", "plans.records")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return {k: f for m in MODULES for k, f in import_module(f"vectrail.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {k: s for m in MODULES for k, s in import_module(f"vectrail.{m}").ORACLES.items()}
