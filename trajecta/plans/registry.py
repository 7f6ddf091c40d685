"""Query registration: a Spark callable and, where SQL can state it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, with a negative zero made plain."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def sq(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0::DOUBLE)"
