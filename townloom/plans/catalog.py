"""Registry of runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from townloom.plans.fixtures import Layers, duck_sql, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = "", extra: dict | None = None):
    """Register a function of the district layers, with reference SQL where SQL can say it."""

    def add(fn: Callable[[Layers], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Layers(spark, sf_dir)))

        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = duck_sql(sql, doubles, extra)
        return fn

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for module in ("classification", "geometry", "joins", "aggregates", "rankings", "panels",
                   "transit", "rasters", "graphs", "similarity", "anchors", "bands", "sources"):
        importlib.import_module(f"townloom.plans.{module}")
