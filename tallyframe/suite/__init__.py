"""Queries over the driver tables, one or more per operator."""

from . import (  # noqa: F401
    chart_queries, cleaning_queries, engine_queries, ingest_queries, profile_queries, quarantine_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
