"""All named queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from winnower.plans import analysis, choosing, further, measuring, screening, studies

_MODULES = (screening, analysis, choosing, measuring, studies, further)
flagship = screening.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query over a folder of tables."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL with the same result."""
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
