"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query. sql may leave out the word WITH: inputs are given as common table expressions."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def r(x: Column, digits: int = 6) -> Column:
    """Rounded, NaN as null, minus zero as zero."""
    return F.when(~F.isnan(x), F.round(x, digits) + F.lit(0.0))


def out(df: DataFrame, *columns: str, digits: int = 6, **values: Column) -> DataFrame:
    """columns as they are, values rounded."""
    return df.select(*columns, *(r(v, digits).alias(k) for k, v in values.items()))
