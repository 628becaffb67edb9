"""Charts and dashboards as query specs."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame

from ..operators.charts import boxplot, histogram, scatter, series_by_x
from ..operators.columns import ColumnMeta, classify_columns
from .predicates import apply_filters
from .query import run_query
from .spec import QuerySpec, merge_filters

# --- fixed values -----------------------------------------------------------
ANY = ("categorical", "numeric", None)
AXIS_RULES = {  # chart type: (allowed X, allowed Y)
    "bar": (("categorical",), ("numeric",)),
    "line": (("categorical", "numeric"), ("numeric",)),
    "area": (("categorical", "numeric"), ("numeric",)),
    "scatter": (("numeric",), ("numeric",)),
    "pie": (("categorical",), ("numeric",)),
    "boxplot": (("categorical", "numeric"), ("numeric",)),
    "histogram": (("categorical", "numeric"), ("numeric",)),
    "kpi": (ANY, ("numeric",)),
    "table": (ANY, ANY),
}
AXIS_FREE = ("kpi", "table")
DISTRIBUTIONS = ("boxplot", "histogram")
DEFAULT_PALETTE = ["#5470C6"]
# ----------------------------------------------------------------------------


class ChartError(ValueError):
    """A chart that its dataset cannot draw."""


def _field(x: Any) -> Any:
    return x.get("field") if isinstance(x, dict) else x


def _first(items: Any) -> Any:
    return items[0] if isinstance(items, (list, tuple)) and items else None


def chart_type(chart: dict) -> str | None:
    return chart.get("type") or (chart.get("visualization") or {}).get("type")


def chart_dataset(chart: dict) -> str:
    return chart.get("datasetId") or (chart.get("dataSource") or {}).get("datasetId") or ""


def validate_chart(chart: dict, schema: list[ColumnMeta] | None) -> bool:
    """Axis rules per chart type; raises ChartError with the reason."""
    kind = chart_type(chart)
    if not kind:
        raise ChartError("a chart type is required")
    if not chart_dataset(chart):
        raise ChartError("a dataset id is required")
    query, viz = chart.get("query") or {}, chart.get("visualization") or {}
    measure = _first(query.get("measures"))
    x = _field(chart.get("x")) or _field(_first(query.get("dimensions"))) or viz.get("xAxis")
    y = _field(chart.get("y")) or _field(measure) or viz.get("yAxis")
    picked = chart.get("y") if isinstance(chart.get("y"), dict) else measure if isinstance(measure, dict) else {}
    counts = y == "*" and str(picked.get("aggregation") or "").upper() == "COUNT"
    if kind not in AXIS_FREE and not (x and y):
        raise ChartError(f"a {kind} chart needs X and Y")
    if schema is None:
        raise ChartError("the dataset is not known")
    roles = {n.lower(): "numeric" if r == "measure" else "categorical" for n, r in classify_columns(schema).items()}
    found = {"X": roles.get(str(x).lower()) if x else None,
             "Y": "numeric" if counts else roles.get(str(y).lower()) if y else None}
    for axis, name in (("X", x), ("Y", y)):
        if kind not in AXIS_FREE and found[axis] is None:
            raise ChartError(f"field {name!r} is not in the dataset")
    for axis, allowed in zip(("X", "Y"), AXIS_RULES.get(kind, (ANY, ANY)), strict=True):
        if found[axis] not in allowed:
            raise ChartError(f"the {axis} axis of a {kind} chart cannot be {found[axis]}")
    return True


def chart_to_stored(config: dict) -> dict:
    """Editor configuration -> stored chart: axes become a query, the rest is kept."""
    query, viz, style = (config.get(k) or {} for k in ("query", "visualization", "style"))

    def axis(side: str, defaults: dict) -> list[dict]:
        given = config.get(side)
        if not given:
            return []
        extra = given if isinstance(given, dict) else {}
        return [{"field": _field(given) or given, **{k: extra.get(k) or v for k, v in defaults.items()},
                 **{k: extra[k] for k in ("label", "format", "meta") if k in extra}}]

    dims, measures = axis("x", {"type": "categorical"}), axis("y", {"aggregation": "sum"})

    def shown(flag: str) -> bool:
        return config[flag] if flag in config else style.get(flag) is not False

    return {
        "chartId": config.get("chartId") or str(uuid.uuid4()),
        "name": config.get("name") or config.get("title") or "Untitled Chart",
        "dataSource": {"datasetId": chart_dataset(config),
                       "table": config.get("table") or (config.get("dataSource") or {}).get("table") or ""},
        "query": {"dimensions": dims or query.get("dimensions") or [],
                  "measures": measures or query.get("measures") or [],
                  **{k: config.get(k) or query.get(k) or [] for k in ("filters", "groupBy", "orderBy")}},
        "visualization": {"type": chart_type(config) or "bar",
                          "xAxis": dims[0]["field"] if dims else viz.get("xAxis") or "",
                          "yAxis": measures[0]["field"] if measures else viz.get("yAxis") or "",
                          "series": {**(config.get("series") or viz.get("series") or {}), "editor": config}},
        "style": {"colorPalette": config.get("colorPalette") or style.get("colorPalette") or DEFAULT_PALETTE,
                  "showLegend": shown("showLegend"), "showGrid": shown("showGrid")},
        "state": {"validation": (config.get("state") or {}).get("validation") or "valid"},
    }


def stored_to_chart(stored: dict | None) -> dict | None:
    """Stored chart -> editor configuration, lossless when the editor's state was kept."""
    if not stored:
        return None
    query, viz, style, source = (stored.get(k) or {} for k in ("query", "visualization", "style", "dataSource"))
    editor = (viz.get("series") or {}).get("editor")
    stamps = {k: stored[k] for k in ("chartId", "createdAt", "updatedAt") if k in stored}
    if editor:
        return {**editor, **stamps}
    x, y = viz.get("xAxis") or "", viz.get("yAxis") or ""

    def axis(items: list, name: str, default: dict) -> dict:
        found = next((i for i in items or [] if i.get("field") == name), {"field": name, **default})
        return {k: found[k] for k in ("field", *default, "label", "format", "meta") if k in found}

    return {
        **stamps, "name": stored.get("name"), "title": stored.get("name"),
        "datasetId": source.get("datasetId") or "", "table": source.get("table") or "",
        "type": viz.get("type") or "bar",
        "x": axis(query.get("dimensions"), x, {"type": "categorical"}),
        "y": axis(query.get("measures"), y, {"aggregation": "sum"}),
        **{k: query.get(k) or [] for k in ("filters", "groupBy", "orderBy")},
        "colorPalette": style.get("colorPalette") or [], "showLegend": style.get("showLegend"),
        "showGrid": style.get("showGrid"), "series": viz.get("series") or {},
        "query": query, "visualization": viz, "style": style, "state": stored.get("state") or {},
    }


def spec_for_chart(chart: dict, filters: Any = ()) -> QuerySpec:
    """Query behind a chart: distributions, scatter and RAW lines read raw rows; others
    group and show the first measure's largest values first."""
    kind = chart_type(chart) or "bar"
    query = dict(chart.get("query") or {})
    if not query.get("dimensions") and not query.get("measures"):
        stored = chart_to_stored(chart)["query"]
        query |= {k: stored[k] for k in ("dimensions", "measures")}
        query.setdefault("filters", stored["filters"])
        query.setdefault("orderBy", stored["orderBy"])
    measures = query.get("measures") or []
    raw_line = kind in ("line", "area") and any(
        isinstance(m, dict) and str(m.get("aggregation") or "").upper() == "RAW" for m in measures)
    raw = bool(query.get("raw")) or kind == "scatter" or kind in DISTRIBUTIONS or raw_line
    if kind == "scatter" or kind in DISTRIBUTIONS:
        query["dimensions"] = []
    if not query.get("sortBy") and not query.get("orderBy") and measures:
        first = QuerySpec.from_dict({"measures": measures[:1]}).measures
        query["orderBy"] = [{"field": m.output, "direction": "desc"} for m in first]
    query |= {"raw": raw, "type": kind, "binSize": query.get("binSize") or chart.get("binSize"),
              "filters": merge_filters(query.get("filters"), filters)}
    return QuerySpec.from_dict(query)


def run_chart(df: DataFrame, chart: dict, filters: Any = ()) -> DataFrame:
    """Drawable rows of a chart.

    Everything is computed over all filtered rows on the cluster; a row limit applies only when the chart
    asks for one.
    """
    spec = spec_for_chart(chart, filters)
    kind = spec.chart_type
    fields = {m.label or m.field: m.field for m in spec.measures if m.field != "*"}
    if kind in DISTRIBUTIONS and fields:
        rows = apply_filters(df, spec.filters)
        if spec.row_limit:
            rows = rows.select(*dict.fromkeys(fields.values())).limit(spec.limit)
        return boxplot(rows, fields) if kind == "boxplot" else histogram(rows, fields, spec.bin_size or 10)
    if kind == "scatter" and len(spec.measures) >= 2:
        rows = run_query(df, spec)
        return scatter(rows, spec.measures[0].field, spec.measures[1].field)
    if kind in ("line", "area") and spec.raw and spec.dimensions and spec.measures:
        rows = run_query(df, spec)
        aggs = [(m.field, None if m.aggregation == "RAW" else m.aggregation) for m in spec.measures]
        return series_by_x(rows, spec.dimensions[0].field, aggs)
    return run_query(df, spec)


def filters_of(filters: Any, dataset: str) -> dict | list:
    """Dashboard filters that belong to a dataset (or to none in particular)."""
    def fits(f: Any) -> bool:
        return not isinstance(f, dict) or f.get("datasetId") in (None, "", dataset)

    if isinstance(filters, dict):
        return {name: f for name, f in filters.items() if fits(f)}
    return [f for f in filters or () if fits(f)]


def run_dashboard(charts: dict[str, dict] | list[dict], frames: dict[str, DataFrame], filters: Any = (),
                  cache: bool = False) -> dict[str, DataFrame]:
    """Result frame per chart id; a chart used twice is planned once.

    ``cache=True`` keeps the columns the charts of one dataset need in memory, or
    on disk, until ``spark.catalog.clearCache``.
    """
    items = charts.items() if isinstance(charts, dict) else ((c.get("chartId"), c) for c in charts)
    wanted = {cid: c for cid, c in items if cid and chart_dataset(c) in frames}
    sources = dict(frames)
    if cache:
        for dataset in {chart_dataset(c) for c in wanted.values()}:
            own = [spec_for_chart(c, filters_of(filters, dataset)) for c in wanted.values() if chart_dataset(c) == dataset]
            used = {x.field for s in own for x in (*s.dimensions, *s.measures, *s.filters)}
            sources[dataset] = frames[dataset].select(*(f"`{n}`" for n in frames[dataset].columns if n in used)).persist()
    return {cid: run_chart(sources[chart_dataset(c)], c, filters_of(filters, chart_dataset(c)))
            for cid, c in wanted.items()}
