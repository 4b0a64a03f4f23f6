"""Registered queries: a name, a DataFrame and, where DuckDB can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, signed: bool = False) -> DataFrame:
    """Doubles (and arrays of them) rounded, since sums depend on their order; ``signed``: what rounds to 0 keeps its sign, as by SQL's round."""
    def one(x: Column) -> Column:
        return F.round(F.abs(x), digits) * F.signum(x) if signed else F.round(x, digits) + F.lit(0.0)
    def of(name: str, kind: str) -> Column:
        if kind == "double":
            return one(F.col(name)).alias(name)
        if kind == "array<double>":
            return F.transform(name, one).alias(name)
        return F.col(name)
    return df.select(*[of(n, k) for n, k in df.dtypes])
