"""Column profiles: types, roles, distinct counts and inferred constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cleaning import NUMBER_TEXT, SHORT_TEXT, comparison_key, native_date, trimmed
from ..functions.names import has_name_token, plain_name, snake_case, tokenize_name
from .columns import ColumnMeta, resolve_cleaner, spark_type
from .validate import SYSTEM_COLUMNS

# --- fixed values -----------------------------------------------------------
SAMPLE_SIZE = 50
EXAMPLES = 5
MIXED_BELOW = 0.8
TYPE_ORDER = ("string", "number", "date", "boolean")  # earlier wins a tie
DIMENSION_SUFFIXES = ("_id", "_code", "_key", "_no", "_num", "_ref")
DIMENSION_WORDS = (
    "id", "name", "category", "type", "status", "region", "country",
    "city", "state", "province", "department", "group", "class",
    "label", "description", "code", "key", "flag", "gender",
    "product", "brand", "segment", "channel", "source", "medium",
    "year", "month", "quarter", "week", "day", "date",
)
MEASURE_WORDS = (
    "revenue", "sales", "profit", "loss", "amount", "total", "sum",
    "count", "quantity", "units", "price", "cost", "rate", "ratio",
    "percent", "percentage", "score", "rating", "age", "salary",
    "income", "expense", "budget", "forecast", "target", "actual",
    "gross", "net", "margin", "value", "weight", "height", "duration",
    "clicks", "impressions", "conversions", "sessions",
)
AVERAGED_WORDS = ("rate", "percent")
NON_NEGATIVE_WORDS = ("price", "amount", "cost", "quantity", "count", "total")
SIGNED_NAMES = ("base_excess",)
NUMBER_KINDS = ("number", "decimal", "integer", "int", "float", "double")
LOW_CARDINALITY = 15
LOW_RATIO = 0.02
HIGH_RATIO = 0.80
CONFIDENCE = {
    "suffix": 0.97, "text": 0.90, "few": 0.85, "low_ratio": 0.80, "high_ratio": 0.85,
    "dimension_word": 0.78, "measure_words": 0.82, "dimension_words": 0.75, "default": 0.60,
    "mixed": 0.70, "empty": 0.50,
}
# ----------------------------------------------------------------------------

_MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b"


def value_type(c: Column) -> Column:
    """boolean, number, date or string for one text value; null for a missing one."""
    text = trimmed(c)
    low = F.lower(text)
    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
        .when(low.isin("true", "false", "1", "0"), "boolean")
        .when(text.rlike(NUMBER_TEXT), "number")
        .when((text.rlike(r"[-/:\sT]") | text.rlike(_MONTH)) & native_date(text).isNotNull(), "date")
        .otherwise("string")
    )


def dominant_type(counts: dict[str, int]) -> str:
    """Majority type; ``mixed`` when several occur and none reaches 80 %."""
    total = sum(counts.get(t, 0) for t in TYPE_ORDER)
    if total == 0:
        return "empty"
    top = max(TYPE_ORDER, key=lambda t: counts.get(t, 0))
    several = sum(1 for t in TYPE_ORDER if counts.get(t, 0)) > 1
    return "mixed" if several and counts[top] / total < MIXED_BELOW else top


def _profiled(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n not in SYSTEM_COLUMNS]


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value) text pairs: one narrow row per cell."""
    cells = F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value"))
                      for n in columns or _profiled(df)))
    return df.select(F.inline(cells))


def profile(df: DataFrame, exact: bool = False, columns: list[str] | None = None) -> DataFrame:
    """One row per column: rows, nulls, distinct values and values per type.

    exact: cells are counted per (column, value) first, so types are tested once
    per distinct value and a hot value is merged before the shuffle; long texts
    travel as digests. The second aggregate works on partial sums. Otherwise a single pass with a sketch of
    bounded size (relative error 1 %).
    """
    cells = long_form(df, columns)
    long_kind = F.when(F.octet_length("value") > SHORT_TEXT, value_type(F.col("value")))
    cells = cells.select("column", comparison_key(F.col("value")).alias("value"), long_kind.alias("long_kind"))
    if exact:
        cells = cells.groupBy("column", "value", "long_kind").agg(F.count(F.lit(1)).alias("n"))
        distinct = F.count_if(F.col("present"))
    else:
        cells = cells.withColumn("n", F.lit(1))
        distinct = F.approx_count_distinct(F.when(F.col("present"), F.col("value")), 0.01)
    typed = cells.withColumn("kind", F.coalesce("long_kind", value_type(F.col("value")))).withColumn(
        "present", F.col("value").isNotNull() & (F.col("value") != ""))

    def rows(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")

    per_type = [rows(F.col("kind") == t).alias(f"{t}_values") for t in TYPE_ORDER]
    out = typed.groupBy("column").agg(
        F.sum("n").cast("long").alias("row_count"), rows(~F.col("present")).alias("null_count"),
        distinct.cast("long").alias("unique_count"), *per_type)
    known = F.col("row_count") - F.col("null_count")
    return out.withColumn("cardinality_ratio", F.col("unique_count") / F.greatest(known, F.lit(1)))


def infer_types(df: DataFrame, exact: bool = False) -> dict[str, str]:
    """Type per column over all rows (one profile row per column reaches the driver)."""
    rows = profile(df, exact).collect()
    found = {r["column"]: dominant_type({t: r[f"{t}_values"] for t in TYPE_ORDER}) for r in rows}
    return {n: found.get(n, "empty") for n in _profiled(df)}


def infer_constraints(name: str, kind: str) -> dict:
    """Amount-like numeric names are non-negative."""
    if kind in NUMBER_KINDS and plain_name(name) not in SIGNED_NAMES and has_name_token(name, NON_NEGATIVE_WORDS):
        return {"min": 0}
    return {}


def classify_role(name: str, kind: str, unique_count: int, non_null: int) -> tuple[str, float, str | None]:
    """(role, confidence, suggested aggregation) from the name and the profile."""
    words = set(tokenize_name(name))
    dims, measures = len(words.intersection(DIMENSION_WORDS)), len(words.intersection(MEASURE_WORDS))
    ratio = unique_count / max(non_null, 1)
    if snake_case(name).endswith(DIMENSION_SUFFIXES):
        role, why = "dimension", "suffix"
    elif kind == "number":
        role, why = _numeric_role(unique_count, ratio, dims, measures)
    elif kind == "mixed":
        role, why = ("measure" if measures > dims else "dimension"), "mixed"
    else:
        role, why = "dimension", "empty" if kind == "empty" else "text"
    aggregation = None
    if role == "measure":
        aggregation = "avg" if any(w in snake_case(name) for w in AVERAGED_WORDS) else "sum"
    return role, CONFIDENCE[why], aggregation


def _numeric_role(unique: int, ratio: float, dims: int, measures: int) -> tuple[str, str]:
    rules = (
        (unique <= LOW_CARDINALITY, "dimension", "few"),
        (ratio < LOW_RATIO, "dimension", "low_ratio"),
        (ratio > HIGH_RATIO, "measure", "high_ratio"),
        (dims > 0 and measures == 0, "dimension", "dimension_word"),
        (measures > dims, "measure", "measure_words"),
        (dims > measures, "dimension", "dimension_words"),
    )
    return next(((role, why) for hit, role, why in rules if hit), ("measure", "default"))


def examples(df: DataFrame, sample: int = SAMPLE_SIZE) -> dict[str, tuple[str, ...]]:
    """Up to five distinct values per column among the first rows."""
    names = _profiled(df)
    head = df.select(*(F.col(f"`{n}`").cast("string").alias(n) for n in names)).limit(sample).collect()
    return {n: tuple(dict.fromkeys(r[n] for r in head if r[n] not in (None, "")))[:EXAMPLES] for n in names}


def infer_schema(df: DataFrame, sample: int | None = None, exact: bool = False) -> list[ColumnMeta]:
    """Types, roles, constraints and examples of all columns.

    All rows decide, with distinct counts from a sketch unless ``exact``; with ``sample`` the first rows do, as
    in a preview. Examples are the first values that come up.
    """
    rows = {r["column"]: r for r in profile(df if sample is None else df.limit(sample), exact).collect()}
    shown = examples(df, sample or SAMPLE_SIZE)
    out = []
    for n in _profiled(df):
        r = rows.get(n)
        if r is None:
            out.append(ColumnMeta(n, "empty", role="dimension", confidence=CONFIDENCE["empty"]))
            continue
        kind = dominant_type({t: r[f"{t}_values"] for t in TYPE_ORDER})
        known = r["row_count"] - r["null_count"]
        role, confidence, aggregation = classify_role(n, kind, r["unique_count"], known)
        out.append(ColumnMeta(
            n, kind, role=role, constraints=infer_constraints(n, kind), suggested_aggregation=aggregation,
            sample_values=shown[n], null_count=r["null_count"], unique_count=r["unique_count"],
            confidence=confidence, type_counts={t: r[f"{t}_values"] for t in TYPE_ORDER if r[f"{t}_values"]}))
    return out


def profile_frame(spark, dataset: str, schema: list[ColumnMeta]) -> DataFrame:
    """Column metadata as a frame: one row per column."""
    rows = [(dataset, c.name, c.type, c.role, c.suggested_aggregation, list(map(str, c.sample_values)),
             c.null_count, c.unique_count, c.nullable, {k: str(v) for k, v in c.constraints.items()})
            for c in schema]
    return spark.createDataFrame(rows, (
        "dataset string, name string, dtype string, role string, suggested_aggregation string, "
        "sample array<string>, null_count long, unique_count long, nullable boolean, "
        "constraints map<string,string>"))


def reclean(df: DataFrame, schema: list[ColumnMeta]) -> DataFrame:
    """Stored columns cast to the types of an overridden schema (unreadable -> null)."""
    by_name = {c.name: c for c in schema}
    out = []
    for n, dtype in df.dtypes:
        meta = by_name.get(n)
        cleaner = resolve_cleaner(meta) if meta else None
        same = meta is None or cleaner is None or spark_type(meta).simpleString() == dtype
        out.append(F.col(f"`{n}`") if same else cleaner(F.col(f"`{n}`")).try_cast(spark_type(meta)).alias(n))
    return df.select(*out)
