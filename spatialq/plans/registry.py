"""All registered queries with their SQL checks."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("selection", "transforms", "spatial", "statistics", "nulls", "models", "studies", "more", "surrogates", "tests")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name. Doubles are rounded to six digits, as in its SQL."""

    def wrap(f: Query) -> Query:
        _queries[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def near(columns: str, sql: str) -> str:
    """sql with the listed columns rounded to six digits, and without negative zeros."""
    return "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in columns.split()) + f") FROM ({sql})"


def oracle_of(name: str) -> str:
    """The SQL of a query whose module is loaded already."""
    return _sql[name]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"spatialq.plans.{m}")


def queries() -> dict[str, Query]:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_sql)
