"""Names of all queries of the library, with the SQL that must give the same rows.

Modules of ``plans`` bind operators to tables and register them with ``@query(sql)``.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "w3_top_incomes"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its own name; sql: what DuckDB runs for the same rows."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _load() -> None:
    from assetlens import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"assetlens.plans.{module.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
