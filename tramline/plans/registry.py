"""Registered queries of the transit operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tramline.plans.fixtures import Views, with_views

Query = Callable[[SparkSession, str], DataFrame]

#: Modules with queries; each registers its own when it's imported.
MODULES = ("timetable", "routing", "live", "policies")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: str = "", raw: bool = False):
    """Register a function of Views. sql is checked against it, after the relations it names; raw: as it is."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _queries[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _sql[name] = sql if raw else with_views(sql, extra)
        return f

    return register


def _load() -> None:
    for module in MODULES:
        import_module(f"tramline.plans.queries_{module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _queries["r1_earliest_arrival" if "r1_earliest_arrival" in _queries else "w1_connections"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
