"""Quarantine analytics and repair over events read as the text rows of a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.columns import ColumnMeta
from ..operators.quarantine import (
    bulk_fix, bulk_fix_summary, classify_quarantine, discard, error_patterns, error_statistics,
    errors_by_pattern, find_quarantined, list_quarantine, resolve, restore, restore_all, top_issues,
)
from ..operators.validate import clean_and_split
from .registry import load, query

EVENT_SCHEMA = [
    ColumnMeta("item_count", "integer"), ColumnMeta("price", "number"),
    ColumnMeta("status", "string", constraints={"enum": ["Click", "View", "Signup", "Error"]}),
    ColumnMeta("seen_at", "date"),
]


def raw_events(spark, sf):
    """Wrong cells: a count of error events, large purchases, the status of purchases, early users' times."""
    return load(spark, sf, "events").select(
        F.col("event_id").alias("_row_number"), F.lit("events.csv").alias("_source_file"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("user_id").cast("string")).alias("item_count"),
        F.concat(F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), "-").otherwise(""),
                 F.col("value").cast("string")).alias("price"),
        F.col("event_type").alias("status"),
        F.when(F.col("user_id") < 5, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("seen_at"))


def quarantine(spark, sf):
    return clean_and_split(raw_events(spark, sf), EVENT_SCHEMA, "events")[1]


def classified(spark, sf):
    return classify_quarantine(quarantine(spark, sf), EVENT_SCHEMA)


# The same facts about each event in SQL.
_BAD = """(
    SELECT *, (e1::INT + e2::INT + e3::INT + e4::INT) AS n_errors,
        CASE WHEN e1 THEN 'NULL_VALUE' WHEN e2 THEN 'OUT_OF_RANGE' WHEN e3 THEN 'CATEGORICAL_MISMATCH' ELSE 'NULL_VALUE' END AS error_type,
        CASE WHEN e1 THEN 'item_count' WHEN e2 THEN 'price' WHEN e3 THEN 'status' ELSE 'seen_at' END AS field,
        CASE WHEN e1 THEN 'NULL_SUBSTITUTION' WHEN e2 THEN 'RANGE_VALIDATION' WHEN e3 THEN 'CATEGORICAL_MAPPING' ELSE 'NULL_SUBSTITUTION' END AS fix,
        CASE WHEN e1 THEN 30 WHEN e2 THEN 45 WHEN e3 THEN 40 ELSE 30 END AS confidence,
        NOT e1 AND e2 AS automatable,
        CASE WHEN e2 THEN 'validation' WHEN e1 OR e4 THEN 'data_quality' ELSE 'unknown' END AS category,
        CASE WHEN e1::INT + e2::INT + e3::INT + e4::INT > 2 THEN 'high' WHEN e1 OR e4 THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT *, event_type = 'error' AS e1, event_type = 'purchase' AND value > 50 AS e2,
                 event_type = 'purchase' AS e3, user_id < 5 AS e4 FROM events)
    WHERE e1 OR e2 OR e3 OR e4)"""
_STATUS = "CASE WHEN automatable THEN 'QUARANTINED' ELSE 'MANUAL_FIX_NEEDED' END"
_PATTERN = "'events|' || error_type || '|' || field || '|' || fix"


@query("classify_quarantine", f"""
    SELECT event_id AS row_number, error_type, field, fix, category, severity, automatable, confidence::INTEGER AS confidence,
           {_STATUS} AS status, md5(error_type || '|' || field || '|' || fix) AS fingerprint, {_PATTERN} AS pattern,
           lower(error_type) || '_' || field AS fix_id
    FROM {_BAD}""")
def classify_events(spark, sf):
    return classified(spark, sf).select("row_number", "error_type", "field", "fix", "category", "severity", "automatable",
                                        "confidence", "status", "fingerprint", "pattern", "fix_id")


@query("quarantine_records", f"""
    SELECT 'events' AS dataset, 'validation' AS category, 'medium' AS severity, 'QUARANTINED' AS status,
           n_errors::INTEGER AS errors, 4 AS cells, count(*) AS n FROM {_BAD} GROUP BY ALL""")
def quarantine_records(spark, sf):
    return quarantine(spark, sf).groupBy("dataset", "category", "severity", "status", F.size("errors").alias("errors"),
                                         F.size("raw").alias("cells")).agg(F.count(F.lit(1)).alias("n"))


@query("error_patterns", f"""
    SELECT {_PATTERN} AS pattern, 'events' AS dataset, error_type, field, fix, count(*) AS affected_rows,
           arg_min(severity, event_id) AS severity, any_value(automatable) AS automatable,
           any_value(confidence)::INTEGER AS confidence,
           list_sort(list(event_id))[1:5] AS sample_rows
    FROM {_BAD} GROUP BY ALL""")
def error_patterns_events(spark, sf):
    return error_patterns(classified(spark, sf)).drop("fix_description")


@query("error_statistics", f"""
    WITH b AS (SELECT *, {_STATUS} AS status FROM {_BAD})
    SELECT 'status' AS facet, status AS value, count(*) AS count FROM b GROUP BY 2
    UNION ALL SELECT 'severity', severity, count(*) FROM b GROUP BY 2
    UNION ALL SELECT 'category', category, count(*) FROM b GROUP BY 2
    UNION ALL SELECT 'automatable', automatable::VARCHAR, count(*) FROM b GROUP BY 2
    UNION ALL SELECT 'total', NULL, count(*) FROM b""")
def error_statistics_events(spark, sf):
    return error_statistics(classified(spark, sf))


@query("errors_by_pattern", f"""
    SELECT event_id AS row_number, n_errors::INTEGER AS errors, severity FROM {_BAD}
    WHERE error_type = 'CATEGORICAL_MISMATCH' ORDER BY event_id LIMIT 20""")
def errors_by_pattern_events(spark, sf):
    rows = errors_by_pattern(classified(spark, sf), "events|CATEGORICAL_MISMATCH|status|CATEGORICAL_MAPPING")
    return rows.select("row_number", F.size("errors").alias("errors"), "severity")


@query("top_issues", f"""
    SELECT {_PATTERN} AS pattern, count(*) AS affected_rows, arg_min(severity, event_id) AS severity,
           any_value(confidence)::INTEGER AS confidence,
           CASE WHEN any_value(automatable) THEN 'AUTO_FIX_AVAILABLE' ELSE 'MANUAL_REVIEW_NEEDED' END AS action
    FROM {_BAD} GROUP BY 1 ORDER BY affected_rows DESC LIMIT 10""")
def top_issues_events(spark, sf):
    return top_issues(classified(spark, sf)).select("pattern", "affected_rows", "severity", "confidence", "action")


@query("bulk_fix", f"""
    SELECT event_id AS row_number, value::VARCHAR AS price, 'AUTO_FIXED' AS status, 1 AS history
    FROM {_BAD} WHERE error_type = 'OUT_OF_RANGE'""")
def bulk_fix_prices(spark, sf):
    fixed = bulk_fix(classified(spark, sf), "events|OUT_OF_RANGE|price|RANGE_VALIDATION",
                     {"price": lambda c: F.replace(c, F.lit("-"), F.lit(""))})
    return fixed.select("row_number", F.col("cleaned")["price"].alias("price"), "status", F.size("history").alias("history"))


@query("bulk_fix_summary", f"""
    SELECT count(*) AS total_attempted, count(*) FILTER (user_id >= 5) AS successful, count(*) FILTER (user_id < 5) AS failed,
           round(count(*) FILTER (user_id >= 5) / count(*) * 100) AS success_rate
    FROM {_BAD} WHERE error_type = 'CATEGORICAL_MISMATCH'""")
def bulk_fix_summary_status(spark, sf):
    """A fix of the whole raw map that cannot help rows without a time."""
    fixed = bulk_fix(classified(spark, sf), "events|CATEGORICAL_MISMATCH|status|CATEGORICAL_MAPPING",
                     lambda raw: F.when(raw["seen_at"] != "not a date", raw))
    return bulk_fix_summary(fixed).drop("bulk_fix_id")


@query("resolve_rows", f"""
    SELECT CASE WHEN severity = 'high' THEN 'IGNORED' ELSE 'QUARANTINED' END AS status,
           CASE WHEN severity = 'high' THEN 1 ELSE 0 END AS history, count(*) AS n FROM {_BAD} GROUP BY ALL""")
def resolve_rows(spark, sf):
    rows = classified(spark, sf).filter("severity = 'high'")
    out = resolve(quarantine(spark, sf), rows, "IGNORED")
    return out.groupBy("status", F.size("history").alias("history")).agg(F.count(F.lit(1)).alias("n"))


@query("discard_all", f"SELECT 'DELETED' AS status, 'DELETED_ALL' AS action, count(*) AS n FROM {_BAD}")
def discard_all(spark, sf):
    out = discard(quarantine(spark, sf))
    return out.groupBy("status", F.col("history")[0]["action"].alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("list_quarantine", f"SELECT event_id AS row_number, n_errors::INTEGER AS errors FROM {_BAD} ORDER BY 1 LIMIT 25")
def list_quarantine_events(spark, sf):
    return list_quarantine(quarantine(spark, sf)).select("row_number", F.size("errors").alias("errors"))


@query("find_quarantined", f"""
    SELECT coalesce((SELECT event_id FROM {_BAD} WHERE event_id = 3),
                    (SELECT event_id FROM {_BAD} ORDER BY event_id LIMIT 1 OFFSET 3)) AS row_number""")
def find_quarantined_event(spark, sf):
    return find_quarantined(quarantine(spark, sf), 3).select("row_number")


@query("restore_edited", f"""
    SELECT CASE WHEN user_id < 5 THEN 'failed' ELSE 'restored' END AS outcome, count(*) AS n,
           CASE WHEN user_id < 5 THEN NULL ELSE sum(7) END::BIGINT AS items
    FROM {_BAD} WHERE e1 GROUP BY user_id < 5""")
def restore_edited(spark, sf):
    q = quarantine(spark, sf)
    edits = load(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("row_number"),
        F.create_map(F.lit("item_count"), F.lit("7 pcs"), F.lit("status"), F.lit(" Error ")).alias("data"))
    clean, failed = restore(q, edits, EVENT_SCHEMA)
    done = clean.agg(F.lit("restored").alias("outcome"), F.count(F.lit(1)).alias("n"), F.sum("item_count").alias("items"))
    left = failed.agg(F.lit("failed").alias("outcome"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("items"))
    return done.union(left)


@query("restore_all", f"""
    SELECT 0::BIGINT AS restored, count(*) AS failed FROM {_BAD}""")
def restore_all_events(spark, sf):
    """Nothing was edited, so every row fails again."""
    clean, failed = restore_all(quarantine(spark, sf), EVENT_SCHEMA)
    return failed.agg(F.count(F.lit(1)).alias("failed")).select(
        F.coalesce(clean.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(0)).alias("restored"), "failed")
