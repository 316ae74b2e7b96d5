"""Queries by name, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from ..sources.views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Gives a view or table by name.
Views = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None, python: bool = False):
    """Registers a function of views. ``sql`` is over the same views, in DuckDB's dialect."""

    def wrap(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if python:
                ship(spark)
            return f(lambda v: view(spark, sf_dir, v))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return wrap
