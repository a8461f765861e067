"""Every query of the engine with its DuckDB twin, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from skein import plans  # noqa: F401  registers

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from skein import plans  # noqa: F401  registers

    return dict(_SQL)


def entry(spark: SparkSession) -> DataFrame:
    return queries()["hybrid_search"](spark, "/root/testdata/sf0.001")
