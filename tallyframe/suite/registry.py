"""Registered queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 2, *cols: str) -> DataFrame:
    """Float results rounded, since the order of a distributed sum is not fixed."""
    wanted = cols or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in wanted})


__all__ = ["ORACLES", "QUERIES", "load", "query", "rounded"]
