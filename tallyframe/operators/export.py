"""Export sinks: flattening, CSV and Parquet files, the export log."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.predicates import apply_filters
from ..plans.query import as_spec, export_columns, run_query
from ..plans.spec import QuerySpec, merge_filters
from .charts import histogram
from .columns import ColumnMeta

# --- fixed values -----------------------------------------------------------
EXPORT_FORMATS = ("csv", "excel", "xlsx")
LOG_ROWS = 50
STALE_REASON = "Server restart or unexpected termination."
# ----------------------------------------------------------------------------


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns; arrays and maps as JSON text."""
    out: list[Column] = []

    def walk(c: Column, name: str, dtype: T.DataType) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(c.getField(f.name), f"{name}.{f.name}", f.dataType)
        else:
            out.append((F.to_json(c) if isinstance(dtype, (T.ArrayType, T.MapType)) else c).alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.name, f.dataType)
    return df.select(*out)


def export_fields(frames: list[DataFrame], schema: list[ColumnMeta] | None = None) -> list[str]:
    """Columns in schema order, else all columns seen."""
    if schema:
        return [c.name for c in schema]
    return list(dict.fromkeys(n for df in frames for n in df.columns))


def union_records(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames over the union of their columns."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def export_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Flat rows in column order; a column the rows do not have is empty."""
    flat = flatten(df)
    if not columns:
        return flat
    return flat.select(*((F.col(f"`{n}`") if n in flat.columns else F.lit("")).alias(n) for n in columns))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Header and rows; null cells are empty. Parts are written in parallel unless
    one file is asked for, which only a limited result should be."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "")
     .option("escape", '"').csv(path))


def spec_from_export(context: dict[str, Any] | None) -> QuerySpec:
    """Query of an export request, with the dashboard's filters added.

    All rows are exported unless the request has a limit.
    """
    context = context or {}
    query = context.get("query")
    if isinstance(query, dict):
        query = {**query, "filters": merge_filters(query.get("filters"), context.get("dashboardFilters"))}
    else:
        def chosen(key: str) -> list:
            return context[key] if isinstance(context.get(key), list) else []
        query = {
            "dimensions": [{"field": f} for f in chosen("selectedDimensions")],
            "measures": [{"field": f, "aggregation": "SUM", "label": f} for f in chosen("selectedMeasures")],
            "filters": merge_filters(context.get("filters"), context.get("dashboardFilters")),
            "orderBy": chosen("sort") or chosen("orderBy"),
        } | {k: context.get(k) for k in ("raw", "rowLimit", "seriesLimit", "contributionMode")}
    return QuerySpec.from_dict(query)


def histogram_table(df: DataFrame, spec: QuerySpec | dict) -> DataFrame:
    """Histogram as an export table: Bin, Start, End and one count column per measure."""
    spec = as_spec(spec)
    cols = {m.label or m.field: m.field for m in spec.measures if m.field != "*"}
    size = max(float(_number_or(spec.bin_size, 10.0)), 1.0)
    long = histogram(df, cols, size)
    counts = [F.coalesce(F.max(F.when(F.col("measure") == label, F.col("count"))), F.lit(0)).alias(f"{label} Count")
              for label in cols]
    wide = long.groupBy("bin", "bin_start", "bin_end").agg(*counts)

    def text(c: str) -> Column:  # whole numbers without a fraction
        return F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))

    return wide.orderBy("bin").select(F.concat(text("bin_start"), F.lit(" - "), text("bin_end")).alias("Bin"),
                                      F.col("bin_start").alias("Start"), F.col("bin_end").alias("End"),
                                      *(F.col(f"`{label} Count`") for label in cols))


def _number_or(x: Any, default: float) -> float:
    try:
        return float(x) or default
    except (TypeError, ValueError):
        return default


def export_frame(df: DataFrame, context: dict) -> DataFrame:
    """Rows of an export request: a histogram table, or the flat query result."""
    spec = spec_from_export(context)
    if (spec.chart_type or "").lower() == "histogram" and any(m.field != "*" for m in spec.measures):
        return histogram_table(apply_filters(df, spec.filters), spec)
    out = run_query(df, spec)
    return export_rows(out, export_columns(spec, out))


def export_csv(df: DataFrame, path: str, context: dict | None = None, single_file: bool = False) -> DataFrame:
    """Write an export request's rows as CSV with headers, in parallel parts unless one file is asked for."""
    out = export_frame(df, context) if context else flatten(df)
    write_csv(out, path, single_file=single_file)
    return out


def export_histogram(df: DataFrame, path: str, cols: list[str] | dict[str, str], bin_size: float = 10.0) -> None:
    measures = [{"field": f, "label": n} for n, f in (cols.items() if isinstance(cols, dict) else zip(cols, cols))]
    write_csv(histogram_table(df, {"measures": measures, "binSize": bin_size}), path)


def export_dataset(df: DataFrame, path: str, schema: list[ColumnMeta] | None = None, fmt: str = "csv") -> None:
    """Write a whole dataset, in parallel parts, by its schema's columns."""
    rows = export_rows(df, export_fields([df], schema))
    if fmt == "parquet":
        rows.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        write_csv(rows, path)
    else:
        raise ValueError("format must be csv or parquet")


def validate_export(request: dict | None) -> bool:
    """Check an export request; raises ValueError with the reason."""
    request = request or {}
    context = request.get("context")
    if not request.get("datasetId"):
        raise ValueError("datasetId is required")
    if str(request.get("format") or "").lower() not in EXPORT_FORMATS:
        raise ValueError("format must be CSV or Excel")
    if not isinstance(context, dict):
        raise ValueError("an export context is required")
    query = context.get("query")
    picked = [context.get(k) for k in ("selectedDimensions", "selectedMeasures")]
    if isinstance(query, dict):
        for key in ("dimensions", "measures", "filters"):
            if key in query and not isinstance(query[key], list):
                raise ValueError(f"query.{key} must be a list")
    elif not any(isinstance(p, list) for p in picked):
        raise ValueError("the context needs a query, or selected dimensions or measures")
    if any(isinstance(p, list) for p in picked):
        if any(p is not None and not isinstance(p, list) for p in picked):
            raise ValueError("selected dimensions and measures must be lists")
        if not isinstance(query, dict) and not any(picked):
            raise ValueError("select at least one dimension or measure")
    if "dashboardFilters" in context and not isinstance(context["dashboardFilters"], (list, dict)):
        raise ValueError("dashboardFilters must be a list or a map")
    return True


# --- export log --------------------------------------------------------------

def export_log(log: DataFrame, value: str, key: str = "dataset", n: int = LOG_ROWS) -> DataFrame:
    """Newest exports of one dataset or dashboard; equal times follow the other columns."""
    simple = [f.name for f in log.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in ("exported_at", key)]
    return log.filter(F.col(key) == value).orderBy(F.desc("exported_at"), *(F.col(f"`{c}`") for c in simple)).limit(n)


def sweep_stale(log: DataFrame) -> DataFrame:
    """Exports still marked as processing count as failed."""
    stale = F.col("status") == "processing"
    reason = F.col("failure_reason") if "failure_reason" in log.columns else F.lit(None).cast("string")
    return log.withColumns({"failure_reason": F.when(stale, STALE_REASON).otherwise(reason),
                            "status": F.when(stale, "failed").otherwise(F.col("status"))})
