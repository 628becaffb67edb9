"""Duplicates: report, keep the first, and inserts that can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def find_duplicates(df: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """Key sets held by more than one row, with their count (and newest ``latest``)."""
    aggs = [F.count(F.lit(1)).alias("count")]
    if latest:
        aggs.append(F.max(latest).alias("last_updated"))
    return df.groupBy(*keys).agg(*aggs).filter(F.col("count") > 1)


def dedupe_keep_first(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """First row per key by ``order``.

    Spark applies the rank limit in every map task before the shuffle, so a key
    that holds a large share of all rows sends one row per task.
    """
    order = F.col(order) if isinstance(order, str) else order
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def insert_idempotent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one per key."""
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def backfill_defaults(df: DataFrame, defaults: dict[str, object], when_missing: list[str] | None = None) -> DataFrame:
    """Fill columns of rows that lack one of ``when_missing`` (default: of any of them).

    Rows that have all of those keep what they hold.
    """
    lacking = F.lit(False)
    for c in when_missing or list(defaults):
        lacking = lacking | (F.col(c).isNull() if c in df.columns else F.lit(True))
    filled = {n: F.when(lacking, F.lit(v)).otherwise(F.col(n) if n in df.columns else F.lit(None))
              for n, v in defaults.items()}
    return df.withColumns(filled)
