"""Column metadata of a dataset and the forms it is stored and shown in."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field as dc_field, replace
from typing import Any

from pyspark.sql import types as T

from ..functions.cleaning import BOOLEAN_TYPES, CLEANERS, DATE_TYPES, NUMBER_TYPES

# --- fixed values -----------------------------------------------------------
NUMERIC_TYPE_TOKENS = (
    "int", "float", "number", "decimal", "double", "numeric", "real", "long", "short", "integer", "bigint",
)
JSON_TYPES = {
    "string": "string", "number": "number", "integer": "integer", "boolean": "boolean",
    "date": "string", "object": "object", "array": "array",
}
JSON_SCHEMA_DRAFT = "http://json-schema.org/draft-07/schema#"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnMeta:
    """What is known of one column. Columns are required unless marked nullable."""

    name: str
    type: str = "string"
    role: str | None = None
    nullable: bool = False
    constraints: dict[str, Any] = dc_field(default_factory=dict)
    suggested_aggregation: str | None = None
    sample_values: tuple = ()
    null_count: int = 0
    unique_count: int = 0
    confidence: float | None = None
    #: Values per type, where a profile counted them.
    type_counts: dict[str, int] = dc_field(default_factory=dict)

    @property
    def kind(self) -> str:
        return (self.type or "").lower()


def columns_to_json(schema: list[ColumnMeta]) -> str:
    return json.dumps([asdict(c) for c in schema], default=str)


def columns_from_json(text: str | None) -> list[ColumnMeta]:
    cols = json.loads(text or "[]")
    return [ColumnMeta(**{**c, "sample_values": tuple(c.get("sample_values") or ())}) for c in cols]


def is_numeric_type(name: str) -> bool:
    return any(t in (name or "").lower() for t in NUMERIC_TYPE_TOKENS)


def type_name(dtype: T.DataType) -> str:
    """Engine type name of a Spark type."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.NumericType):
        return "number"
    return "string"


def spark_type(meta: ColumnMeta) -> T.DataType:
    """Spark type of a cleaned column."""
    kind = resolved_kind(meta)
    if kind == "integer":
        return T.LongType()
    if kind in NUMBER_TYPES:
        return T.DoubleType()
    if kind in BOOLEAN_TYPES:
        return T.BooleanType()
    return T.TimestampType() if kind in DATE_TYPES else T.StringType()


def resolved_kind(meta: ColumnMeta) -> str:
    """Type to clean by. A mixed column takes its role's main type, or that of its counted values, or, without
    counts, of its samples."""
    if meta.kind != "mixed":
        return meta.kind
    if (meta.role or "").lower() == "measure":
        return "number"
    if meta.type_counts:
        return max(("string", "number", "date", "boolean"), key=lambda t: meta.type_counts.get(t, 0))
    votes = {"number": 0, "boolean": 0, "string": 0}
    for v in meta.sample_values:
        if isinstance(v, bool):
            votes["boolean"] += 1
        elif isinstance(v, (int, float)) or _reads_as_number(v):
            votes["number"] += 1
        elif isinstance(v, str):
            votes["boolean" if v.lower() in ("true", "false", "yes", "no", "y", "n") else "string"] += 1
    if votes["number"] > max(votes["boolean"], votes["string"]):
        return "number"
    return "boolean" if votes["boolean"] > votes["string"] else "string"


def _reads_as_number(v: Any) -> bool:
    try:
        return float(v) not in (float("inf"), float("-inf")) and "_" not in str(v) and str(v).lower() != "nan"
    except (TypeError, ValueError):
        return False


def resolve_cleaner(meta: ColumnMeta):
    """Column function cleaning a column of this type; None leaves it alone."""
    return CLEANERS.get(resolved_kind(meta))


def columns_of(df, nullable: bool = True) -> list[ColumnMeta]:
    """Metadata of a typed frame by its Spark types alone."""
    return [ColumnMeta(f.name, type_name(f.dataType), nullable=nullable) for f in df.schema.fields]


def classify_columns(schema: list[ColumnMeta]) -> dict[str, str]:
    """dimension or measure per column: the stored role, else by type."""
    return {
        c.name: c.role if c.role in ("dimension", "measure")
        else "measure" if is_numeric_type(c.type or "string") else "dimension"
        for c in schema
    }


def serialize_schema(schema: list[ColumnMeta]) -> str:
    """``name:type;name:type``."""
    return ";".join(f"{c.name}:{c.type or 'string'}" for c in schema)


def deserialize_schema(text: str | None) -> list[ColumnMeta]:
    out = []
    for part in (text or "").split(";"):
        if part.strip():
            name, *rest = part.split(":")
            out.append(ColumnMeta(name.strip(), (rest[0].strip() if rest else "") or "string"))
    return out


def schema_fingerprint(schema: list[ColumnMeta]) -> str:
    return hashlib.sha256(serialize_schema(schema).encode()).hexdigest()


def schemas_equal(a: list[ColumnMeta], b: list[ColumnMeta]) -> bool:
    return schema_fingerprint(a) == schema_fingerprint(b)


def format_schema(schema: list[ColumnMeta]) -> str:
    """Listing for people: one line per column."""
    lines = [f"Schema ({len(schema)} columns):"]
    for c in schema:
        marks = ("" if c.nullable else " (required)") + (f" [{c.role}]" if c.role else "")
        lines.append(f"  {c.name}: {c.type or 'string'}{marks}")
    return "\n".join(lines)


def override_column(schema: list[ColumnMeta], name: str, type: str | None = None,
                    role: str | None = None) -> list[ColumnMeta]:
    """Schema with another type or role for one column."""
    if type is None and role is None:
        raise ValueError("give a type or a role")
    if name not in {c.name for c in schema}:
        raise ValueError(f"column {name!r} is not in the schema")
    change = {k: v for k, v in (("type", type), ("role", role)) if v is not None}
    return [replace(c, **change) if c.name == name else c for c in schema]


def to_json_schema(schema: list[ColumnMeta], strict: bool = False) -> dict:
    """JSON-Schema form. ``strict`` lists required fields and forbids others;
    otherwise nullable columns are unions with null and dates carry a format."""
    props: dict[str, dict] = {}
    for c in schema:
        if strict:
            p: dict[str, Any] = {"type": JSON_TYPES.get(c.type, "string")}
            names = {"min": "minimum", "max": "maximum", "pattern": "pattern", "enum": "enum",
                     "minLength": "minLength", "maxLength": "maxLength"}
            p |= {names[k]: v for k, v in c.constraints.items() if k in names}
        else:
            base = ("number" if c.kind in ("number", "integer", "float", "decimal")
                    else "boolean" if c.kind == "boolean" else "string")
            p = {"type": [base, "null"] if c.nullable else base}
            if c.kind in DATE_TYPES:
                p["format"] = "date-time"
            p |= c.constraints
        props[c.name] = p
    out = {"$schema": JSON_SCHEMA_DRAFT, "type": "object", "properties": props}
    required = [c.name for c in schema if not c.nullable]
    if strict or required:
        out["required"] = required
    return out | {"additionalProperties": not strict}
