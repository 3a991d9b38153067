"""Queries by name, each with SQL that says the same independently.

A query declares its columns once, as "name:kind" with kind i (bigint), d (double to six places), s (text), b (boolean); both
sides are brought to those types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _spark(df: DataFrame, columns: str) -> DataFrame:
    cast = {"i": lambda c: c.cast("long"), "d": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}
    return df.select(*(cast[k](F.col(n)).alias(n) for n, k in (x.split(":") for x in columns.split())))


def _sql(text: str, columns: str) -> str:
    cast = {"i": "CAST({0} AS BIGINT) AS {0}", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0 AS {0}", "s": "CAST({0} AS VARCHAR) AS {0}", "b": "CAST({0} AS BOOLEAN) AS {0}"}
    own, _, body = text.strip().rpartition("\n--\n")
    views = ", ".join([VIEWS, own.strip()]) if own.strip() else VIEWS
    return f"WITH {views} SELECT {', '.join(cast[k].format(n) for n, k in (x.split(':') for x in columns.split()))} FROM ({body}) AS q"


def add(name: str, columns: str, make: Callable[[Views], DataFrame], sql: str | None) -> None:
    """sql: a select, with further common table expressions before a line of -- if it needs them; None if SQL can't say it."""
    if name in QUERIES:
        raise ValueError(f"two queries {name}")
    QUERIES[name] = lambda spark, sf_dir: _spark(make(Views(spark, sf_dir)), columns)
    if sql is not None:
        SQL[name] = _sql(sql, columns)


def query(columns: str, sql: str | None) -> Callable:
    def register(make: Callable[[Views], DataFrame]) -> Callable:
        add(make.__name__, columns, make, sql)
        return make

    return register
