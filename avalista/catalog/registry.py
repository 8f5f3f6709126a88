"""Registration of checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from avalista.catalog.loan_view import VIEWS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the views loans, dirty, scored, applications."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = f"WITH {VIEWS_SQL}\n{sql}"
        return fn

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns, keeping column order."""
    return df.withColumns({name: F.round(F.col(name), d) for name, d in digits.items()})
