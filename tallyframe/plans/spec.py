"""Declarative chart queries: dimensions, measures, filters, sort and limits."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

# --- fixed values -----------------------------------------------------------
DEFAULT_ROW_LIMIT = 10_000
MAX_ROW_LIMIT = 50_000
COUNT_STAR = "COUNT(*)"
# ----------------------------------------------------------------------------


def _text(x: Any) -> str:
    return "" if x is None or x is False else str(x).strip()


def leading_int(x: Any) -> int | None:
    """The whole number a text starts with, as lenient form fields send it."""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return int(x)
    m = re.match(r"\s*([+-]?\d+)", x) if isinstance(x, str) else None
    return int(m.group(1)) if m else None


@dataclass(frozen=True)
class Dimension:
    field: str
    time_bucket: str | None = None
    timezone: str = "UTC"

    @classmethod
    def parse(cls, x: Any) -> Dimension | None:
        if isinstance(x, str):
            x = {"field": x}
        if not isinstance(x, dict) or not _text(x.get("field")):
            return None
        return cls(_text(x["field"]), x.get("timeBucket") or None, x.get("timezone") or "UTC")


@dataclass(frozen=True)
class Measure:
    field: str
    aggregation: str = "SUM"
    label: str | None = None

    @classmethod
    def parse(cls, x: Any) -> Measure | None:
        if isinstance(x, str):
            x = {"field": x}
        if not isinstance(x, dict) or not _text(x.get("field")):
            return None
        return cls(_text(x["field"]), str(x.get("aggregation") or "SUM").upper(), x.get("label") or None)

    @property
    def counts_rows(self) -> bool:
        return self.field == "*" or self.aggregation == "COUNT"

    @property
    def output(self) -> str:
        return self.label or (COUNT_STAR if self.counts_rows else self.field)


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any = None

    @classmethod
    def parse(cls, x: Any) -> Filter | None:
        if isinstance(x, Filter):
            return x
        if not isinstance(x, dict):
            return None
        name, op = _text(x.get("field")), _text(x.get("operator"))
        return cls(name, op, x.get("value")) if name and op else None


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False

    @classmethod
    def parse(cls, x: Any) -> Sort | None:
        if not isinstance(x, dict) or not _text(x.get("field")):
            return None
        return cls(_text(x["field"]), str(x.get("direction") or "asc").lower() == "desc")


def _parse_all(kind, items) -> tuple:
    items = items if isinstance(items, (list, tuple)) else ()
    return tuple(p for p in map(kind.parse, items) if p is not None)


def normalize_filters(filters: Any) -> tuple[Filter, ...]:
    """A list of filters, or a map of field -> value, values or full filter."""
    if isinstance(filters, (list, tuple)):
        return _parse_all(Filter, filters)
    if not isinstance(filters, dict):
        return ()
    out: list[Filter | None] = []
    for name, value in filters.items():
        if not _text(name):
            continue
        if isinstance(value, (list, tuple)):
            out.append(Filter(name, "IN", list(value)))
        elif isinstance(value, dict) and "operator" in value:
            out.append(Filter.parse({**value, "field": value.get("field") or name}))
        else:
            out.append(Filter(name, "=", value))
    return tuple(f for f in out if f is not None)


def merge_filters(*groups: Any) -> tuple[Filter, ...]:
    """All filters of all groups; every one must hold."""
    return tuple(f for g in groups for f in normalize_filters(g))


@dataclass(frozen=True)
class QuerySpec:
    dimensions: tuple[Dimension, ...] = ()
    measures: tuple[Measure, ...] = ()
    filters: tuple[Filter, ...] = ()
    order_by: tuple[Sort, ...] = ()
    sort_by: tuple[Sort, ...] = ()
    raw: bool = False
    row_limit: Any = None
    series_limit: Any = None
    contribution_mode: str = "none"
    chart_type: str | None = None
    bin_size: Any = None

    @classmethod
    def from_dict(cls, d: dict | None) -> QuerySpec:
        d = d or {}
        return cls(
            dimensions=_parse_all(Dimension, d.get("dimensions")),
            measures=_parse_all(Measure, d.get("measures")),
            filters=normalize_filters(d.get("filters")),
            order_by=_parse_all(Sort, d.get("orderBy")),
            sort_by=_parse_all(Sort, d.get("sortBy")),
            raw=bool(d.get("raw")),
            row_limit=d.get("rowLimit"),
            series_limit=d.get("seriesLimit"),
            contribution_mode=d.get("contributionMode") or "none",
            chart_type=d.get("chartType") or d.get("type"),
            bin_size=d.get("binSize"),
        )

    @property
    def sorts(self) -> tuple[Sort, ...]:
        return self.sort_by or self.order_by

    @property
    def limit(self) -> int | None:
        """Series limit (top-N) when set, else the row limit asked for; None without either. The constants above
        are for callers that want a page."""
        series = leading_int(self.series_limit) or 0
        if series > 0 and not self.raw:
            return series
        rows = leading_int(self.row_limit)
        return max(rows, 1) if rows else None
