"""Registered queries with their operator ids and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    run: Run
    operators: str
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Run) -> Run:
        QUERIES[f.__name__] = Query(f, operators, sql)
        return f

    return add
