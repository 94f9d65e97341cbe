"""Registry of the queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from rollbook.plans.bindings import Tables, with_views

Query = Callable[[Tables], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle over the named views."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return function

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from rollbook.plans import catalog_jobs, catalog_match, catalog_merge, catalog_read, catalog_stored, catalog_text  # noqa: F401
