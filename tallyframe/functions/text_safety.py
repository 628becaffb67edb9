"""Text checks and severity rules as column expressions (batch or stream)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# --- fixed values -----------------------------------------------------------
HTML_PRESENT = r"(?i)<[a-z][\s\S]*>"
SQL_PATTERNS = (
    r"(?i)(\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE)\b.*?\b(FROM|INTO|TABLE|SET|WHERE|JOIN)\b)",
    r"(--|/\*|\*/|@@|@@version)",
    r"(?i)(union.*select|union.*all)",
    r"(?i)(\bor\b\s+\d+\s*=\s*\d+)",
    r"(?i)(\band\b\s+\d+\s*=\s*\d+)",
)
OPERATOR_KEYS = r"\$where|\$regex|\$gt|\$lt|\$ne|\$in|\$nin|\$exists"
DATA_URL = r"(?i)^data:[a-z]+/[a-z0-9+.-]+;base64,"
HTML_ENTITY = r"(?i)&[a-z0-9]+;"
SLOW_REQUEST_MS = 1500.0
# ----------------------------------------------------------------------------


def strip_tags(c: Column) -> Column:
    """Text without markup tags; text without a tag is left alone."""
    return F.when(c.rlike(HTML_PRESENT), F.regexp_replace(c, r"<[^>]*>", "")).otherwise(c)


def looks_like_injection(c: Column) -> Column:
    """SQL-looking text that is neither a data URL nor carries an HTML entity."""
    hit = reduce(lambda a, b: a | b, (c.rlike(p) for p in SQL_PATTERNS))
    return F.coalesce(~c.rlike(DATA_URL) & hit & ~c.rlike(HTML_ENTITY), F.lit(False))


def looks_like_operator_key(c: Column) -> Column:
    return F.coalesce(c.rlike(OPERATOR_KEYS), F.lit(False))


def strip_html(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``strip_tags`` over the given (default: all) string columns."""
    wanted = set(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    return df.select(*(strip_tags(F.col(n)).alias(n) if n in wanted else F.col(n) for n in df.columns))


def flag_injection(df: DataFrame, cols: list[str], out: str = "suspicious") -> DataFrame:
    """Adds a flag: one of ``cols`` looks like SQL, or a map key like an operator."""
    checks = []
    for n in cols:
        dtype = df.schema[n].dataType
        if isinstance(dtype, T.MapType):
            checks.append(F.exists(F.map_keys(n), looks_like_operator_key)
                          | F.exists(F.map_values(n), looks_like_injection))
        else:
            checks.append(looks_like_injection(F.col(n)))
    return df.withColumn(out, F.coalesce(reduce(lambda a, b: a | b, checks), F.lit(False)))


def request_level(status: Column, duration_ms: Column, slow_ms: float = SLOW_REQUEST_MS) -> Column:
    """error for 5xx or an aborted (null-status) request, warn for 4xx or slow, else info."""
    return (
        F.when(status.isNull() | (status >= 500), "error")
        .when((status >= 400) | (duration_ms >= slow_ms), "warn")
        .otherwise("info")
    )


def classify_requests(df: DataFrame, status: str = "status", duration_ms: str = "duration_ms",
                      slow_ms: float = SLOW_REQUEST_MS) -> DataFrame:
    """Adds ``level`` to a request log; works on batch and stream frames."""
    return df.withColumn("level", request_level(F.col(status), F.col(duration_ms), slow_ms))
