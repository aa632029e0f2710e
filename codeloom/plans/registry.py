"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import code, integrity, relational

MODULES = (integrity, relational, code)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a callable of (session, data directory)."""
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to the SQL that must give the same rows."""
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
