"""Row cleaning, validation and the clean / quarantine split.

Everything is one projection over the raw rows: each column contributes a typed
expression and a list of possible errors. No row leaves the JVM and no shuffle
is needed.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.cleaning import (
    BOOLEAN_TYPES, DATE_TYPES, FALSE_WORDS, NUMBER_TYPES, TEXT_TYPES, TRUE_WORDS, clean_boolean, leading_number,
    parse_date, parse_plain_date, stripped, trimmed, unquoted,
)
from ..functions.names import has_name_token
from .columns import ColumnMeta, resolve_cleaner, resolved_kind, spark_type

# --- fixed values -----------------------------------------------------------
NON_NEGATIVE_NAMES = ("price", "amount", "cost", "quantity", "count", "total", "id")
NUMBER_NAMES = ("price", "amount")
WHOLE_NUMBER_NAMES = ("quantity", "count")
NUMERIC_LOOKING_NAMES = ("price", "amount", "cost", "quantity", "count", "id")
BOOLEAN_NAME_TOKENS = ("active", "enabled", "disabled", "flag", "bool", "true", "false", "yes", "no")
BOOLEAN_NAME_PARTS = ("is_", "_flag")
BOOLEAN_NAME_HINTS = ("bool", "active", "enabled", "flag")
STRUCTURAL = {"category": "structural", "severity": "high",
              "suggestion": "Check column alignment and raw file format"}
VALIDATION = {"category": "validation", "severity": "medium",
              "suggestion": "Review typing constraints and nullability rules for affected cells"}
QUARANTINED = "QUARANTINED"
REPORT_ROWS = 100
# ----------------------------------------------------------------------------

ERROR = "struct<field:string,error_type:string,message:string,value:string>"
ERRORS = f"array<{ERROR}>"
HISTORY = "array<struct<action:string,at:timestamp,user:string>>"
CORRUPT = "_corrupt_record"
ROW_NUMBER = "_row_number"
SOURCE_FILE = "_source_file"
SYSTEM_COLUMNS = (ROW_NUMBER, SOURCE_FILE, CORRUPT)


def error(field: str | None, kind: str, message: Column | str, value: Column | None = None) -> Column:
    return F.struct(
        F.lit(field).cast("string").alias("field"),
        F.lit(kind).alias("error_type"),
        (message if isinstance(message, Column) else F.lit(message)).alias("message"),
        (value if value is not None else F.lit(None)).cast("string").alias("value"),
    )


class Check(NamedTuple):
    """A condition that makes a row wrong, and the error it then carries."""

    failed: Column
    error: Column


def any_failed(checks: list[Check]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c.failed, F.lit(False)) for c in checks), F.lit(False))


def failures(checks: list[Check]) -> Column:
    """Array of the errors that occurred; one per message, in check order."""
    if not checks:
        return F.array().cast(ERRORS)
    return F.array_distinct(F.array_compact(F.array(*(F.when(c.failed, c.error) for c in checks)))).cast(ERRORS)


def error_list(checks: list[Check]) -> Column:
    """``failures``, built only for the rows that have one: most rows stop at the conditions."""
    return F.when(any_failed(checks), failures(checks)).otherwise(F.array().cast(ERRORS))


def number_limits(meta: ColumnMeta) -> tuple[float | None, float | None]:
    """Bounds of a numeric column; names of amounts may not be negative."""
    lo, hi = meta.constraints.get("min"), meta.constraints.get("max")
    if lo is None and has_name_token(meta.name, NON_NEGATIVE_NAMES):
        lo = 0
    return lo, hi


def check_required(meta: ColumnMeta, c: Column) -> list[Check]:
    if meta.nullable:
        return []
    return [Check(c.isNull(), error(meta.name, "missing_required_value", f"{meta.name}: a value is required"))]


def check_empty(meta: ColumnMeta, c: Column) -> list[Check]:
    """Empty text where null is meant."""
    kind = "invalid_format" if meta.nullable else "missing_required_value"
    return [Check(c == "", error(meta.name, kind, f"{meta.name}: empty text instead of null", c))]


def check_range(meta: ColumnMeta, c: Column) -> list[Check]:
    lo, hi = number_limits(meta)
    name = meta.name
    out = [Check(F.isnan(c) | (F.abs(c) == float("inf")),
                 error(name, "invalid_format", f"{name}: not a finite number", c))]
    if lo is not None:
        out.append(Check(c < lo, error(name, "constraint_violation", f"{name}: below minimum {lo}", c)))
    if hi is not None:
        out.append(Check(c > hi, error(name, "constraint_violation", f"{name}: above maximum {hi}", c)))
    return out


def check_integer(meta: ColumnMeta, c: Column) -> list[Check]:
    whole = Check(c != F.floor(c), error(meta.name, "invalid_format", f"{meta.name}: must be a whole number", c))
    return [whole, *check_range(meta, c)]


def _bad_word(c: Column) -> Column:
    return ~F.lower(stripped(c)).isin(*TRUE_WORDS, *FALSE_WORDS)


def check_boolean(meta: ColumnMeta, c: Column) -> list[Check]:
    return [Check(_bad_word(c), error(meta.name, "invalid_format", f"{meta.name}: not a true/false word", c))]


def check_date(meta: ColumnMeta, c: Column) -> list[Check]:
    return [Check(c.isNotNull() & parse_date(c).isNull(),
                  error(meta.name, "invalid_format", f"{meta.name}: not a date", c))]


def check_enum(meta: ColumnMeta, c: Column) -> list[Check]:
    allowed = meta.constraints.get("enum")
    if not allowed:
        return []
    return [Check(~c.isin(*allowed), error(meta.name, "constraint_violation",
                                           f"{meta.name}: value is not one of the allowed ones", c))]


def names_a_boolean(name: str) -> bool:
    low = name.lower()
    padded = f"_{low}_"
    return any(p in low for p in BOOLEAN_NAME_PARTS) or any(f"_{t}_" in padded for t in BOOLEAN_NAME_TOKENS)


def check_boolean_by_name(meta: ColumnMeta, c: Column) -> list[Check]:
    """A text column named like a flag must hold true/false words."""
    if meta.kind in BOOLEAN_TYPES or not names_a_boolean(meta.name):
        return []
    return [Check(_bad_word(c), error(meta.name, "invalid_format", f"{meta.name}: looks like a flag", c))]


def check_unusable(cols: list[Column]) -> Column:
    """No column holds a value. Empty text counts as one here; make it null first."""
    return reduce(lambda a, b: a & b, (c.isNull() for c in cols), F.lit(True))


def _mismatch(meta: ColumnMeta, c: Column, wanted: str) -> Check:
    return Check(c.isNotNull(), error(meta.name, "type_mismatch", f"{meta.name}: expected {wanted}", c))


def column_checks(meta: ColumnMeta, c: Column, boolean_names: bool = False) -> list[Check]:
    """Checks of a cleaned column ``c``, whose Spark type follows from ``meta``."""
    kind, cleaned = meta.kind, spark_type(meta)
    numeric = isinstance(cleaned, T.NumericType)
    text = isinstance(cleaned, T.StringType)
    out = check_required(meta, c)
    if kind in ("number", "decimal") or has_name_token(meta.name, NUMBER_NAMES):
        out += check_range(meta, c) if numeric else [_mismatch(meta, c, "a number")]
    if kind == "integer" or has_name_token(meta.name, WHOLE_NUMBER_NAMES):
        out += check_integer(meta, c) if numeric else [_mismatch(meta, c, "a whole number")]
    if kind not in BOOLEAN_TYPES:
        out += check_enum(meta, c)
    if boolean_names and text:
        out += check_boolean_by_name(meta, c)
    return out


def _prepared(meta: ColumnMeta | None, raw: Column) -> Column:
    """Text a cleaner starts from: date texts lose quotes and outer white space once."""
    return unquoted(raw) if meta is not None and resolved_kind(meta) in DATE_TYPES else raw.cast("string")


def _cleaned(meta: ColumnMeta, text: Column) -> Column:
    if resolved_kind(meta) in DATE_TYPES:
        return parse_plain_date(text)
    cleaner = resolve_cleaner(meta)
    return F.nullif(text, F.lit("")) if cleaner is None else cleaner(text)


def _repaired(meta: ColumnMeta, text: Column) -> Column:
    """Lenient cleaning: text keeps its case and a number may be followed by a unit."""
    kind = resolved_kind(meta)
    if kind in NUMBER_TYPES:
        return leading_number(text)
    if kind in BOOLEAN_TYPES:
        return clean_boolean(text)
    return parse_plain_date(text) if kind in DATE_TYPES else trimmed(text)


def _unread(meta: ColumnMeta, text: Column, value: Column) -> list[Check]:
    """Text the repair path could not read is an error of its own, not a missing value."""
    kind = resolved_kind(meta)
    lost = value.isNull() & (stripped(text) != "")
    if kind in NUMBER_TYPES:
        return [Check(lost, error(meta.name, "type_mismatch", f"{meta.name}: expected a number", text))]
    if kind in BOOLEAN_TYPES:
        return [Check(lost, error(meta.name, "invalid_format", f"{meta.name}: not a true/false word", text))]
    return []


def _stored(meta: ColumnMeta, c: Column) -> Column:
    """Cleaned value in the type it is stored with."""
    return c.try_cast("long") if isinstance(spark_type(meta), T.LongType) else c


def annotate(df: DataFrame, schema: list[ColumnMeta], mode: str = "ingest",
             boolean_names: bool = False) -> DataFrame:
    """Typed columns plus ``_valid``, ``_raw`` and ``_errors`` of wrong rows, ``_warnings``, ``_structural``.

    ``df`` holds text columns (and optionally row number, source file and corrupt
    record). ``mode="repair"`` cleans as the quarantine repair does. The steps are
    stacked projections, so each value is cleaned once; error records and raw maps
    are built for wrong rows only.
    """
    by_name = {m.name.lower(): m for m in schema}
    names = [n for n in df.columns if n not in SYSTEM_COLUMNS]
    metas = [by_name.get(n.lower()) for n in names]
    has_corrupt = CORRUPT in df.columns
    system = [F.col(n) for n in SYSTEM_COLUMNS if n in df.columns]
    raws = [F.col(f"__r{i}") for i in range(len(names))]
    texts = [F.col(f"__x{i}") if m is not None and resolved_kind(m) in DATE_TYPES else raws[i]
             for i, m in enumerate(metas)]
    values = [F.col(f"__v{i}") for i in range(len(names))]

    # 1: raw text, and prepared text where it differs
    df = df.select(*system, *(F.col(f"`{n}`").cast("string").alias(f"__r{i}") for i, n in enumerate(names)))
    df = df.select(*system, *raws, *(_prepared(m, raws[i]).alias(f"__x{i}") for i, m in enumerate(metas)
                                     if m is not None and resolved_kind(m) in DATE_TYPES))
    # 2: typed values
    clean = _repaired if mode == "repair" else _cleaned
    df = df.select(*system, *raws, *((texts[i] if m is None else clean(m, texts[i])).alias(f"__v{i}")
                                     for i, m in enumerate(metas)))
    # 3: is the row wrong?
    checks: list[Check] = []
    warnings: list[Check] = []
    for i, m in enumerate(metas):
        if m is None:
            continue
        found = column_checks(m, values[i], boolean_names)
        if mode == "repair" and (unread := _unread(m, raws[i], values[i])):
            found = unread + [Check(c.failed & ~F.coalesce(unread[0].failed, F.lit(False)), c.error) for c in found]
        checks += found
        if m.nullable:
            warnings.append(Check(values[i].isNull() & (raws[i] != ""),
                                  F.concat(F.lit(f"{names[i]}: could not read '"), raws[i], F.lit("'"))))
    structural = F.col(CORRUPT).isNotNull() if has_corrupt else F.lit(False)
    unusable_row = check_unusable([F.nullif(v, F.lit("")) if m is None else v for m, v in zip(metas, values)])
    # The partition id is never negative. As it is not a function of the row, the optimizer leaves
    # a filter on validity above this step. Below, it would clean every value once per check.
    valid = ~(structural | unusable_row | any_failed(checks)) & (F.spark_partition_id() >= 0)
    df = df.select(*system, *raws, *values, structural.alias("_structural"), unusable_row.alias("__unusable"),
                   valid.alias("_valid"), any_failed(warnings).alias("__warned"))
    # 4: what is wrong with it
    wrong = ~F.col("_valid")
    unusable = F.array(error(None, "unusable_row", "no usable value in the row")).cast(ERRORS)
    broken = F.array(error(None, "structural_parse_error", "column count mismatch")).cast(ERRORS)
    errors = (F.when(F.col("_valid"), F.array().cast(ERRORS)).when(F.col("_structural"), broken)
              .when(F.col("__unusable"), unusable).otherwise(failures(checks)))
    cells = F.create_map(*(x for n, r in zip(names, raws) for x in (F.lit(n), r)))
    raw = F.when(F.col("_structural"), F.create_map(F.lit(CORRUPT), F.col(CORRUPT))) if has_corrupt else F.when(F.lit(False), cells)
    said = F.array_compact(F.array(*(F.when(w.failed, w.error) for w in warnings))) if warnings else F.array()
    return df.select(
        *(F.col(n) for n in (ROW_NUMBER, SOURCE_FILE) if n in df.columns),
        *((values[i] if m is None else _stored(m, values[i])).alias(names[i]) for i, m in enumerate(metas)),
        raw.when(wrong, cells).alias("_raw"), errors.alias("_errors"),
        F.when(F.col("__warned"), said.cast("array<string>")).otherwise(F.array().cast("array<string>")).alias("_warnings"),
        "_structural", "_valid")


INTERNAL = ("_raw", "_errors", "_warnings", "_structural", "_valid")


def clean_part(annotated: DataFrame, keep_warnings: bool = False) -> DataFrame:
    """Rows without errors, typed."""
    drop = [c for c in INTERNAL if not (keep_warnings and c == "_warnings")]
    return annotated.filter("_valid").drop(*drop)


def to_quarantine(annotated: DataFrame, dataset: str = "") -> DataFrame:
    """Quarantine records of the rows with errors."""
    def by_cause(key: str) -> Column:
        return F.when(F.col("_structural"), STRUCTURAL[key]).otherwise(VALIDATION[key])

    have = set(annotated.columns)
    number = F.col(ROW_NUMBER).cast("long") if ROW_NUMBER in have else F.lit(None).cast("long")
    source = F.col(SOURCE_FILE) if SOURCE_FILE in have else F.lit(None).cast("string")
    return annotated.filter(~F.col("_valid")).select(
        F.lit(dataset).alias("dataset"), number.alias("row_number"), source.alias("source_file"),
        F.col("_raw").alias("raw"), F.col("_errors").alias("errors"),
        by_cause("category").alias("category"), by_cause("severity").alias("severity"),
        by_cause("suggestion").alias("suggestion"), F.lit(QUARANTINED).alias("status"),
        F.array().cast(HISTORY).alias("history"),
    )


def clean_and_split(df: DataFrame, schema: list[ColumnMeta], dataset: str = "", mode: str = "ingest",
                    boolean_names: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantine records). Every input row is in exactly one of them.

    Both halves come from the same projection. To store both in one pass over the
    source use ``sources.store.write_dataset``.
    """
    annotated = annotate(df, schema, mode, boolean_names)
    return clean_part(annotated), to_quarantine(annotated, dataset)


def split_structural(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, rows whose cell count differs from the header's)."""
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull())


def normalize_dates(df: DataFrame, schema: list[ColumnMeta]) -> DataFrame:
    """Date columns of the schema parsed, all others untouched."""
    dates = {m.name.lower() for m in schema if m.kind in DATE_TYPES}
    return df.select(*(parse_date(F.col(f"`{n}`")).alias(n) if n.lower() in dates else F.col(f"`{n}`")
                       for n in df.columns))


def clean_for_restore(df: DataFrame, schema: list[ColumnMeta] = ()) -> DataFrame:
    """Repair-path cleaning of text columns.

    With a schema: typed columns plus ``_bad``, the columns whose text could not
    be read. Without: types follow from the names (numeric-looking, date or time,
    else text with a capital first letter) and unread text is kept as text.
    """
    by_name = {m.name.lower(): m for m in schema}
    out, bad = [], []
    for n in df.columns:
        raw, low = F.col(f"`{n}`"), n.lower()
        if n in SYSTEM_COLUMNS:
            out.append(raw)
        elif low in by_name:
            meta = by_name[low]
            value = _repaired(meta, _prepared(meta, raw))
            out.append(_stored(meta, value).alias(n))
            bad += [F.when(c.failed, F.lit(n)) for c in _unread(meta, raw, value)]
        elif schema:
            out.append(trimmed(raw).alias(n))
        else:
            text = trimmed(raw)
            if has_name_token(n, NUMERIC_LOOKING_NAMES):
                text = F.coalesce(leading_number(raw).cast("string"), text)
            elif "date" in low or "time" in low:
                text = F.coalesce(F.date_format(parse_date(raw), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), text)
            else:
                text = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))
            out.append(text.alias(n))
    if schema:
        found = F.filter(F.array(*bad), lambda b: b.isNotNull()) if bad else F.array().cast("array<string>")
        out.append(found.alias("_bad"))
    return df.select(*out)


def typed_checks(meta: ColumnMeta, c: Column, dtype: T.DataType, boolean_names: bool = False) -> list[Check]:
    """Checks of a value as it stands, by the type it has."""
    text, numeric, kind = isinstance(dtype, T.StringType), isinstance(dtype, T.NumericType), meta.kind
    filled = (c != "") if text else c.isNotNull()
    out = [Check(c.isNull() | ~filled if text else c.isNull(), check_required(meta, c)[0].error)] if not meta.nullable else (
        check_empty(meta, c) if text else [])

    def when_filled(checks: list[Check]) -> list[Check]:
        return [Check(filled & x.failed, x.error) for x in checks]

    if kind in TEXT_TYPES and not text:
        out.append(_mismatch(meta, c, "text"))
    if kind in ("number", "decimal") or has_name_token(meta.name, NUMBER_NAMES):
        out += check_range(meta, c.cast("double")) if numeric else when_filled([_mismatch(meta, c, "a number")])
    if kind == "integer" or has_name_token(meta.name, WHOLE_NUMBER_NAMES):
        out += check_integer(meta, c.cast("double")) if numeric else when_filled([_mismatch(meta, c, "a whole number")])
    if kind in BOOLEAN_TYPES and not isinstance(dtype, T.BooleanType):
        out += when_filled(check_boolean(meta, c) if text else [_mismatch(meta, c, "true or false")])
    if kind in DATE_TYPES and not isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        out += when_filled(check_date(meta, c) if text else [_mismatch(meta, c, "a date")])
    if kind not in BOOLEAN_TYPES:
        out += when_filled(check_enum(meta, c))
    if boolean_names and text:
        out += when_filled(check_boolean_by_name(meta, c))
    return out


def validate_rows(df: DataFrame, schema: list[ColumnMeta], boolean_names: bool = False, out: str = "errors") -> DataFrame:
    """Errors of rows as they stand, without cleaning them first."""
    fields = {f.name.lower(): f for f in df.schema.fields}
    checks = [x for m in schema if (f := fields.get(m.name.lower())) is not None
              for x in typed_checks(m, F.col(f"`{f.name}`"), f.dataType, boolean_names)]
    return df.withColumn(out, error_list(checks))


def validate_by_name(df: DataFrame, out: str = "errors") -> DataFrame:
    """Errors of text rows by column name alone: numbers, flags, and an all-empty row."""
    checks = []
    for n in df.columns:
        c, low = trimmed(F.col(f"`{n}`")), n.lower()
        if has_name_token(n, NUMERIC_LOOKING_NAMES):
            checks.append(Check(c.isNotNull() & leading_number(c).isNull(),
                                error(n, "type_mismatch", f"{n}: expected a number", c)))
        if any(h in low for h in BOOLEAN_NAME_HINTS):
            checks.append(Check(_bad_word(c), error(n, "invalid_format", f"{n}: not a true/false word", c)))
    empty = F.array(error(None, "unusable_row", "no usable value in the row")).cast(ERRORS)
    unusable = check_unusable([F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in df.columns])
    return df.withColumn(out, F.when(unusable, empty).otherwise(error_list(checks)))


# --- payload validation ------------------------------------------------------

def _matches_type(meta: ColumnMeta, dtype: T.DataType) -> bool:
    if isinstance(dtype, T.NullType):
        return True
    kind = meta.kind
    if kind in ("number", "integer"):
        return isinstance(dtype, T.NumericType)
    if kind == "boolean":
        return isinstance(dtype, T.BooleanType)
    if kind == "object":
        return isinstance(dtype, (T.StructType, T.MapType))
    if kind == "array":
        return isinstance(dtype, T.ArrayType)
    if kind == "date" and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return True
    return isinstance(dtype, T.StringType)


def payload_errors(df: DataFrame, schema: list[ColumnMeta]) -> Column:
    """Errors of typed rows against a schema's types and constraints."""
    fields = {f.name: f.dataType for f in df.schema.fields if f.name not in SYSTEM_COLUMNS}
    checks = []
    for meta in schema:
        n, k = meta.name, meta.constraints
        if n not in fields:
            if not meta.nullable:
                checks.append(Check(F.lit(True), error(n, "required", f"{n}: property is missing")))
            continue
        c, dtype = F.col(f"`{n}`"), fields[n]
        if not meta.nullable:
            checks.append(Check(c.isNull(), error(n, "required", f"{n}: property is missing")))
        if not _matches_type(meta, dtype):
            checks.append(Check(c.isNotNull(), error(n, "type", f"{n}: must be {meta.type}", c)))
            continue
        if meta.kind == "integer" and isinstance(dtype, T.FractionalType):
            checks.append(Check(c != F.floor(c), error(n, "type", f"{n}: must be integer", c)))
        if isinstance(dtype, T.NumericType):
            if k.get("min") is not None:
                checks.append(Check(c < k["min"], error(n, "minimum", f"{n}: must be >= {k['min']}", c)))
            if k.get("max") is not None:
                checks.append(Check(c > k["max"], error(n, "maximum", f"{n}: must be <= {k['max']}", c)))
        if isinstance(dtype, T.StringType):
            if k.get("pattern"):
                checks.append(Check(~c.rlike(k["pattern"]), error(n, "pattern", f"{n}: must match the pattern", c)))
            if k.get("minLength") is not None:
                checks.append(Check(F.length(c) < k["minLength"], error(n, "minLength", f"{n}: is too short", c)))
            if k.get("maxLength") is not None:
                checks.append(Check(F.length(c) > k["maxLength"], error(n, "maxLength", f"{n}: is too long", c)))
        if k.get("enum"):
            checks.append(Check(~c.isin(*k["enum"]), error(n, "enum", f"{n}: must be an allowed value", c)))
    known = {m.name for m in schema}
    for n in fields:
        if n not in known:
            checks.append(Check(F.col(f"`{n}`").isNotNull(),
                                 error(n, "additionalProperties", f"{n}: property is not known")))
    return error_list(checks)


def validate_payload(df: DataFrame, schema: list[ColumnMeta]) -> DataFrame:
    """The rows with an ``errors`` column; a row passes when it is empty."""
    return df.withColumn("errors", payload_errors(df, schema))


def check_cross_columns(validated: DataFrame, schema: list[ColumnMeta], stored: DataFrame | None = None,
                        references: dict[str, DataFrame] | None = None) -> DataFrame:
    """Key constraints of the rows that passed so far, added to their ``errors``.

    ``unique: True`` compares with the ``stored`` rows; ``foreignKey: {"collection",
    "field"}`` looks the value up in ``references``. Nulls pass. Each lookup is a left
    join with distinct values.
    """
    out = validated.withColumn("__ok", F.size("errors") == 0)
    checks = []
    for i, meta in enumerate(schema):
        fk = meta.constraints.get("foreignKey")
        lookups = []
        if meta.constraints.get("unique") and stored is not None:
            lookups.append((stored.select(F.col(meta.name).alias("__key")), True, "unique", "value is already stored"))
        if fk and fk["collection"] in (references or {}):
            keys = references[fk["collection"]].select(F.col(fk["field"]).alias("__key"))
            lookups.append((keys, False, "foreignKey", f"value is not in {fk['collection']}.{fk['field']}"))
        for keys, bad_when_found, kind, message in lookups:
            key, flag = f"__key{i}{kind}", f"__hit{i}{kind}"
            found = keys.filter(F.col("__key").isNotNull()).distinct().select(F.col("__key").alias(key), F.lit(True).alias(flag))
            out = out.join(found, F.col(f"`{meta.name}`") == F.col(key), "left")
            hit = F.col(flag).isNotNull()
            failed = F.col("__ok") & F.col(f"`{meta.name}`").isNotNull() & (hit if bad_when_found else ~hit)
            checks.append(Check(failed, error(meta.name, kind, f"{meta.name}: {message}", F.col(f"`{meta.name}`"))))
    return out.withColumn("errors", F.concat("errors", error_list(checks))).select(*validated.columns)


def payload_summary(validated: DataFrame) -> DataFrame:
    """One row: totals of a validated payload."""
    ok = F.size("errors") == 0
    return validated.agg(F.count(F.lit(1)).alias("total_processed"), F.count_if(ok).alias("valid_count"),
                         F.count_if(~ok).alias("error_count"), F.coalesce(F.every(ok), F.lit(True)).alias("is_valid"))


def payload_report(validated: DataFrame, order: str, n: int = REPORT_ROWS) -> DataFrame:
    """The first failing rows."""
    return validated.filter(F.size("errors") > 0).orderBy(order).limit(n)


def check_unique(df: DataFrame, existing: DataFrame, col: str, within: bool = True) -> DataFrame:
    """Rows whose value is already stored, or (``within``) occurs twice in the rows themselves.

    The stored side is reduced to the values in question before the join; repeats
    inside the batch are found by a count, so a hot value never meets itself.
    """
    key = F.col(col)
    stored = existing.select(key.alias(col)).filter(key.isNotNull()).distinct()
    taken = df.select(key).filter(key.isNotNull())
    if within:
        counts = taken.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
        repeated = counts.filter(F.col("__n") > 1).select(col)
        stored = stored.join(counts.select(col), col, "left_semi").union(repeated).distinct()
    return df.join(stored, col, "left_semi")


def check_foreign_key(df: DataFrame, ref: DataFrame, col: str, ref_col: str) -> DataFrame:
    """Rows whose value the referenced column does not have (nulls pass)."""
    keys = ref.select(F.col(ref_col).alias(col)).filter(F.col(col).isNotNull()).distinct()
    return df.filter(F.col(col).isNotNull()).join(keys, col, "left_anti")
