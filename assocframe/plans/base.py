"""How queries are registered: by name, with SQL where SQL has a form of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from assocframe.plans.views import sql as expand

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query of (spark, sf_dir)."""

    def wrap(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = expand(sql)
        return f

    return wrap


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded for comparison between engines, which sum in another order."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
