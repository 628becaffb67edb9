"""Columnar tables as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet files."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
