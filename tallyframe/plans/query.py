"""Query spec -> DataFrame."""

from __future__ import annotations

import io
import time
from contextlib import redirect_stdout
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.timebucket import time_bucket
from .predicates import SchemaMap, apply_filters
from .spec import Measure, QuerySpec

_ROWS = "__rows"


def as_spec(spec: QuerySpec | dict) -> QuerySpec:
    return spec if isinstance(spec, QuerySpec) else QuerySpec.from_dict(spec)


def measure_column(m: Measure, schema: SchemaMap) -> Column:
    """Aggregate of a measure. Text and flags carry no numbers: sum 0, average null."""
    if m.counts_rows:
        return F.count(F.lit(1))
    c, dtype = schema.lookup(m.field)
    if m.aggregation == "MIN":
        return F.min(c)
    if m.aggregation == "MAX":
        return F.max(c)
    numeric = isinstance(dtype, T.NumericType)
    if m.aggregation == "AVG":
        return F.avg(c) if numeric else F.max(F.lit(None).cast("double"))
    if isinstance(dtype, T.IntegralType):
        # Sums may pass the range of a long: add exactly, then take the nearest double.
        return F.coalesce(F.sum(c.cast("decimal(20,0)")).cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(c), F.lit(0)) if numeric else F.max(F.lit(0.0))


def _contribution(df: DataFrame, keys: list[str]) -> DataFrame:
    """Measures as percent of their total over the returned (limited) rows. The totals are one row, added up
    in the map tasks and read as scalars."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    measures = [n for n in df.columns if n in keys and n in numeric]
    if not measures:
        return df
    value = {n: F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in measures}
    totals = df.agg(*(F.sum(value[n]).alias(f"t{i}") for i, n in enumerate(measures)))
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in value:
            total = totals.select(f"t{measures.index(name)}").scalar()
            share = F.round(value[name] / F.nullif(total, F.lit(0.0)) * 100, 2)
            c = F.when(total != 0, share).otherwise(c.cast("double"))
        out.append(c.alias(name))
    return df.select(*out)


def _raw(df: DataFrame, spec: QuerySpec, schema: SchemaMap) -> DataFrame:
    names = [d.field for d in spec.dimensions] + [m.field for m in spec.measures if m.field != "*"]
    return df.select(*(schema.lookup(n)[0].alias(n) for n in dict.fromkeys(names)))


def _grouped(df: DataFrame, spec: QuerySpec, schema: SchemaMap) -> tuple[DataFrame, list[str], list[str]]:
    dims: dict[str, Column] = {}
    for d in spec.dimensions:
        c, dtype = schema.lookup(d.field)
        dims[d.field] = time_bucket(c, d.time_bucket, d.timezone, dtype) if d.time_bucket else c
    aggs = {m.output: measure_column(m, schema) for m in spec.measures}
    if not dims and not aggs:
        aggs = {"count": F.count(F.lit(1))}
    keys = {name: f"__d{i}" for i, name in enumerate(dims)}
    dim_cols = [c.alias(keys[name]) for name, c in dims.items()]
    shown = [F.col(keys[n]).alias(n) for n in dims if n not in aggs]
    if not aggs:
        grouped = df.select(*dim_cols).distinct().select(*shown)
    else:
        totals = [c.alias(name) for name, c in aggs.items()]
        picked = shown + [F.col(f"`{name}`") for name in aggs]
        if dims:
            grouped = df.groupBy(*dim_cols).agg(*totals).select(*picked)
        else:  # no input rows -> no result row
            grouped = df.agg(*totals, F.count(F.lit(1)).alias(_ROWS)).filter(F.col(_ROWS) > 0).select(*picked)
    return grouped, [n for n in dims if n not in aggs], list(aggs)


def _limited(df: DataFrame, spec: QuerySpec) -> DataFrame:
    return df if spec.limit is None else df.limit(spec.limit)


def run_query(df: DataFrame, spec: QuerySpec | dict, strict: bool = False) -> DataFrame:
    """Filters, then raw rows or groups, then sort, limit and percent of total.

    Columns the frame does not have read as null, unless ``strict``. Grouped
    results are ordered by the requested sort and then by the dimensions, so a
    limit always cuts at the same place.
    """
    spec = as_spec(spec)
    df = apply_filters(df, spec.filters, strict)
    schema = SchemaMap(df, strict)
    if spec.raw:
        return _limited(_raw(df, spec, schema), spec)
    out, dims, measures = _grouped(df, spec, schema)
    if dims:
        order = {s.field: s.descending for s in spec.sorts if s.field in out.columns}
        order |= {d: False for d in dims if d not in order}
        out = out.orderBy(*(F.col(f"`{n}`").desc() if down else F.col(f"`{n}`").asc()
                            for n, down in order.items()))
    out = _limited(out, spec)
    return _contribution(out, measures) if spec.contribution_mode == "row" else out


def export_columns(spec: QuerySpec | dict, df: DataFrame | None = None) -> list[str]:
    """Column order of a query's export; the frame's own when the spec names none."""
    spec = as_spec(spec)
    names = [d.field for d in spec.dimensions]
    names += [m.field for m in spec.measures if m.field != "*"] if spec.raw else [m.output for m in spec.measures]
    return list(dict.fromkeys(names)) or (df.columns if df is not None else [])


def explain_spec(df: DataFrame, spec: QuerySpec | dict, mode: str = "formatted") -> str:
    """Plan of a query as text; nothing runs."""
    out = io.StringIO()
    with redirect_stdout(out):
        run_query(df, spec).explain(mode=mode)
    return out.getvalue()


def preview(df: DataFrame, limit: int = 25, offset: int = 0, order: str = "_row_number") -> DataFrame:
    """One page of rows in source order; equal places are ordered by a hash of the row."""
    ties = F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))))
    return df.orderBy(order, ties).offset(max(offset, 0)).limit(limit or 25)


@dataclass
class QueryResult:
    """Rows of a limited result with their count and the time they took."""

    rows: list[dict]
    row_count: int
    execution_time_ms: int
    spec: QuerySpec

    @classmethod
    def run(cls, df: DataFrame, spec: QuerySpec | dict) -> QueryResult:
        spec, start = as_spec(spec), time.monotonic()
        rows = [r.asDict(recursive=True) for r in run_query(df, spec).collect()]  # as many as the spec's limit allows
        return cls(rows, len(rows), int((time.monotonic() - start) * 1000), spec)
