"""The table of registered queries, and what their definitions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c, places: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# Wilson's interval over columns k and n; s: which end.
WILSON = """(k / n::DOUBLE + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)"""
