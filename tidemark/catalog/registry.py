"""Registry of named queries: a Spark callable and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.bindings.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register `fn(views) -> DataFrame` under `name`."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(views, sql)
        return fn

    return wrap


def r6(*cols: str) -> list[Column]:
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def text(*cols: str) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in cols]


def rd(*cols: str, n: int = 6) -> list[Column]:
    """Round through a 9-digit decimal, so that last-bit noise cannot flip an exact tie."""
    return [F.round(F.col(c).cast("decimal(30,9)"), n).cast("double").alias(c) for c in cols]


def rd_sql(expr: str, n: int = 6) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(30,9)), {n}) AS DOUBLE)"


def round_printed_sql(expr: str, n: int) -> str:
    """Half-up on the shortest printed digits of a double, which is what F.round does."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(36,17)), {n}) AS DOUBLE)"
