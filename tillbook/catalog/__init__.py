"""Registry of runnable queries and their DuckDB oracle twins.

Each catalog module registers ``name -> fn(retail) -> DataFrame`` and, where
the semantics are SQL-expressible, the equivalent DuckDB SQL over the raw
driver tables.  ``__spark_entry__`` exposes both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillbook.catalog.oracle_views import with_views
from tillbook.sources.fixtures import Retail

_QUERIES: dict[str, Callable[[Retail], DataFrame]] = {}
_ORACLE: dict[str, str] = {}
_LOADED = False


def register(name: str, sql: str | None = None, extra_ctes: dict | None = None):
    """Decorator: register a query and (optionally) its oracle SQL body."""
    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = with_views(sql, extra_ctes)
        return fn
    return deco


def _load():
    global _LOADED
    if not _LOADED:
        from tillbook.catalog import (documents, layouts, ledger, loads, quality, references,  # noqa: F401
                                      reports, rules, sources, stock, streams)
        _LOADED = True


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Retail(spark, sf_dir))
    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
