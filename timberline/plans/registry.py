"""Registered queries and the SQL their results are held to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, as_: str | None = None) -> Column:
    """Rounded to six decimals, without a negative zero."""
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column, 6) + F.lit(0.0)).alias(as_ or c)
