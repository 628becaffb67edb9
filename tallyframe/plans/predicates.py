"""Filters of a query spec as typed column predicates.

Literals take the type of the column, never the other way round, so Catalyst can
push every predicate into the scan.
"""

from __future__ import annotations

import math
import re
import warnings
from datetime import date, datetime, timezone
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .spec import Filter

ORDER_OPS = (">", ">=", "<", "<=")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_HEX = re.compile(r"0[xX][0-9a-fA-F]+")
_DATE_FORMATS = (
    "%Y/%m/%d", "%Y/%m/%d %H:%M", "%Y/%m/%d %H:%M:%S", "%m/%d/%Y", "%m/%d/%Y %H:%M",
    "%m/%d/%Y %H:%M:%S", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y", "%Y-%m", "%Y",
)

NO_VALUE = object()  # a literal the column's type can never equal


class SchemaMap:
    """Columns of a frame by name: exact, else ignoring case, else a nested path."""

    def __init__(self, df: DataFrame, strict: bool = False):
        self._df, self._strict = df, strict
        self._by_name = {f.name: f for f in df.schema.fields}
        self._by_lower = {f.name.lower(): f for f in df.schema.fields}

    def lookup(self, name: str) -> tuple[Column, T.DataType]:
        f = self._by_name.get(name) or self._by_lower.get(name.lower())
        if f is not None:
            return F.col(f"`{f.name}`"), f.dataType
        head, _, rest = name.partition(".")
        f = self._by_lower.get(head.lower())
        if rest and f is not None and isinstance(f.dataType, T.StructType):
            return F.col(name), self._df.select(F.col(name)).schema[0].dataType
        if self._strict:
            raise ValueError(f"unknown column {name!r}; have {', '.join(self._by_name)}")
        return F.lit(None).cast("string"), T.NullType()


def to_number(v: Any) -> int | float | None:
    """Number a filter value stands for; blank text counts as zero."""
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float, Decimal)):
        return v if math.isfinite(v) else None
    if not isinstance(v, str):
        return None
    s = v.strip()
    if not s:
        return 0
    if _HEX.fullmatch(s):
        return int(s, 16)
    if not _NUMBER.fullmatch(s):
        return None
    if re.fullmatch(r"[+-]?\d+", s):
        return int(s)
    x = float(s)
    return x if math.isfinite(x) else None


def to_datetime(v: Any) -> datetime | None:
    """Instant a filter value stands for, as a naive UTC datetime."""
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return datetime.fromtimestamp(v / 1000, timezone.utc).replace(tzinfo=None)
    if isinstance(v, date) and not isinstance(v, datetime):
        return datetime(v.year, v.month, v.day)
    parsed = v if isinstance(v, datetime) else None
    if isinstance(v, str):
        try:
            parsed = datetime.fromisoformat(v.strip())
        except ValueError:
            for fmt in _DATE_FORMATS:
                try:
                    parsed = datetime.strptime(v.strip(), fmt)
                    break
                except ValueError:
                    continue
    if parsed is not None and parsed.tzinfo is not None:
        parsed = parsed.astimezone(timezone.utc).replace(tzinfo=None)
    return parsed


def coerce_value(value: Any, dtype: T.DataType, op: str = "=") -> Any:
    """Typed Python value for a column, or ``NO_VALUE`` when the types never meet."""
    if value is None:
        return None
    raw = value.strip() if isinstance(value, str) else value
    if isinstance(dtype, T.BooleanType):
        if isinstance(raw, bool):
            return raw
        return {"true": True, "false": False}.get(str(raw).lower(), NO_VALUE)
    if isinstance(dtype, T.NumericType):
        n = to_number(raw)
        return NO_VALUE if n is None else n
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        d = to_datetime(raw)
        return NO_VALUE if d is None else d
    if isinstance(dtype, T.StringType):
        if not isinstance(raw, str):
            return NO_VALUE
        if op in ORDER_OPS and to_number(raw) is not None:
            return NO_VALUE  # a number never compares with text
        return raw
    return NO_VALUE


def typed_literal(v: Any, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DecimalType):
        return F.lit(Decimal(str(v)))
    if isinstance(dtype, T.FractionalType):
        return F.lit(float(v))
    if isinstance(dtype, T.IntegralType):
        return F.lit(int(v)).cast(dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        text = v.isoformat(sep=" ")
        if isinstance(dtype, T.TimestampType):
            return F.lit(text + "+00:00").cast("timestamp")
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(v)


def _integral_bound(op: str, v: Any) -> tuple[str, Any]:
    """Whole-number form of an order comparison, so an integer column is not cast."""
    if v == int(v):
        return op, int(v)
    return (">=", math.ceil(v)) if op in (">", ">=") else ("<=", math.floor(v))


_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _fits(v: Any, dtype: T.DataType) -> bool:
    """Whether a whole number is in the range of an integer type."""
    half = 1 << _BITS[dtype.simpleString()] - 1
    return -half <= v < half


def _one_of(c: Column, dtype: T.DataType, values: list[Any], op: str) -> tuple[Column | None, bool]:
    """(``c`` equals one of the typed values or None if none can, null wanted)."""
    wants_null = any(v is None for v in values)
    typed = [coerce_value(v, dtype, op) for v in values if v is not None]
    if isinstance(dtype, T.StringType):
        typed += [v for v in values if isinstance(v, str)]
    if isinstance(dtype, T.IntegralType):
        typed = [int(v) for v in typed if v is not NO_VALUE and math.isfinite(v) and v == int(v) and _fits(int(v), dtype)]
    if isinstance(dtype, T.DateType):
        typed = [v for v in typed if v is not NO_VALUE and v.time() == datetime.min.time()]
        unique = list(dict.fromkeys(v.date() for v in typed))
        lits = [F.lit(v) for v in unique]
    else:
        unique = list(dict.fromkeys(v for v in typed if v is not NO_VALUE))
        lits = [typed_literal(v, dtype) for v in unique]
    if not lits:
        return None, wants_null
    return (c == lits[0] if len(lits) == 1 else c.isin(lits)), wants_null


def _list_values(value: Any) -> list[Any]:
    if isinstance(value, (list, tuple, set)):
        return list(value)
    return [t.strip() for t in str(value or "").split(",") if t.strip()]


def _order(c: Column, dtype: T.DataType, op: str, value: Any) -> Column:
    if value is None:
        return c.isNull() if op in (">=", "<=") else F.lit(False)
    v = coerce_value(value, dtype, op)
    if v is NO_VALUE or isinstance(dtype, T.NullType):
        return F.lit(False)
    if isinstance(dtype, T.IntegralType):
        if math.isfinite(v):
            op, v = _integral_bound(op, v)
        if not math.isfinite(v) or not _fits(v, dtype):  # beyond the type: all values, or none
            return c.isNotNull() if (v > 0) == (op in ("<", "<=")) else F.lit(False)
    if isinstance(dtype, T.DateType):
        if v.time() != datetime.min.time():  # inside a day: compare with its edge
            op = "<=" if op in ("<", "<=") else ">"
        lit = F.lit(v.date())
    else:
        lit = typed_literal(v, dtype)
    return {">": c > lit, ">=": c >= lit, "<": c < lit, "<=": c <= lit}[op]


def filter_condition(f: Filter, schema: SchemaMap) -> Column | None:
    """Predicate of one filter; None when the filter has no effect."""
    c, dtype = schema.lookup(f.field)
    op = f.operator
    if op in ORDER_OPS:
        return _order(c, dtype, op, f.value)
    if op in ("=", "==", "!="):
        values = [f.value]
    elif op in ("IN", "NOT IN"):
        values = _list_values(f.value)
        if not values:
            return None
    else:
        warnings.warn(f"filter operator {op!r} is unknown; the filter is ignored", stacklevel=2)
        return None
    hit, wants_null = _one_of(c, dtype, values, op)
    if op in ("=", "==", "IN"):
        if hit is None:
            return c.isNull() if wants_null else F.lit(False)
        return hit | c.isNull() if wants_null else hit
    if hit is None:
        return c.isNotNull() if wants_null else None
    return c.isNotNull() & ~hit if wants_null else ~hit | c.isNull()


def apply_filters(df: DataFrame, filters, strict: bool = False) -> DataFrame:
    """Rows for which every filter holds."""
    schema = SchemaMap(df, strict)
    conditions = [c for c in (filter_condition(f, schema) for f in filters) if c is not None]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df
