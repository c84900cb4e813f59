"""Registry of the queries over the driver's tables and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clusterlens.plans.oracle import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may name the views of `oracle.VIEWS`."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def load() -> None:
    from clusterlens.plans import (  # noqa: F401
        queries_cells,
        queries_models,
        queries_records,
        queries_scalars,
    )
