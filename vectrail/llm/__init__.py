"""Training-data operators: deduplication, filtering, extraction, mixing and scoring.

Each module holds one operator with its query (``QUERIES``) and, where DuckDB can express
it, its SQL (``ORACLES``).
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "simhash",
    "suffix_dedup",
    "substring_dedup",
    "decontaminate",
    "quality",
    "html_text",
    "mixing",
    "pii",
    "toxicity",
    "lm_score",
    "whitening",
    "collocations",
    "token_counts",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").ORACLES.items()}
