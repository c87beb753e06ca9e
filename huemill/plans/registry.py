"""Every registered query of the catalogue engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from huemill.session import reachable

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under a name; sql is what DuckDB runs on the same tables."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from huemill.plans import catalogue_queries, chart_queries, composite_queries, file_queries, page_queries, raster_queries, table_queries  # noqa: F401  register on import

    return {name: (lambda spark, sf_dir, f=f: f(reachable(spark), sf_dir)) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
