"""Cleaning functions, validation, payload and key checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import WHITE_SPACE, clean_boolean, clean_number, clean_string, clean_unknown
from ..functions.text_safety import classify_requests, flag_injection, strip_html
from ..operators.columns import ColumnMeta
from ..operators.validate import (
    annotate, check_cross_columns, check_foreign_key, check_unique, clean_and_split, clean_for_restore, normalize_dates,
    payload_summary, validate_by_name, validate_payload, validate_rows,
)
from .registry import load, query, rounded

_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_CLEAN_TEXT = f"nullif(trim(replace(text, '\"', ''), {_BLANKS}), '')"


@query("clean_string", f"""
    SELECT doc_id, md5(upper(t[1:1]) || lower(t[2:])) AS cleaned, length(t) AS n
    FROM (SELECT doc_id, {_CLEAN_TEXT} AS t FROM documents)""")
def clean_string_documents(spark, sf):
    cleaned = clean_string(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.md5(cleaned).alias("cleaned"),
                                               F.length(cleaned).cast("long").alias("n"))


@query("clean_number", """
    SELECT event_id, try_cast(regexp_replace(props, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS from_json,
           value AS from_money, NULL::DOUBLE AS from_range, NULL::DOUBLE AS from_word
    FROM events""")
def clean_number_events(spark, sf):
    money = F.concat(F.lit("$ "), F.col("value").cast("string"), F.lit(" USD"))
    return load(spark, sf, "events").select(
        "event_id", clean_number(F.col("props")).alias("from_json"), clean_number(money).alias("from_money"),
        clean_number(F.concat_ws("-", "user_id", "event_id")).alias("from_range"),
        clean_number(F.col("event_type")).alias("from_word"))


@query("clean_boolean", """
    SELECT l_returnflag, CASE WHEN l_returnflag = 'N' THEN false END AS flag,
           CASE WHEN l_linenumber = 1 THEN true END AS first_line, count(*) AS n
    FROM lineitem GROUP BY ALL""")
def clean_boolean_lines(spark, sf):
    return load(spark, sf, "lineitem").groupBy(
        "l_returnflag", clean_boolean(F.concat(F.lit(" "), "l_returnflag")).alias("flag"),
        clean_boolean(F.col("l_linenumber").cast("string")).alias("first_line")).agg(F.count(F.lit(1)).alias("n"))


@query("clean_unknown", """
    SELECT o_orderkey, o_totalprice, o_orderpriority[1:1] || lower(o_orderpriority[2:]) AS o_orderpriority FROM orders""")
def clean_unknown_orders(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return df.select(*(clean_unknown(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields))


@query("parse_date", """
    SELECT o_orderkey, o_orderpriority,
           CASE WHEN o_orderpriority = '3-MEDIUM' AND day(o_orderdate) <= 12
                THEN make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0)
                ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS written
    FROM orders""")
def parse_date_formats(spark, sf):
    """The same day written in five ways; day-first wins where month and day could swap."""
    day, kind = F.col("o_orderdate"), F.col("o_orderpriority")
    written = (
        F.when(kind == "1-URGENT", F.date_format(day, "yyyy/MM/dd"))
        .when(kind == "2-HIGH", F.concat(F.lit('" '), F.date_format(day, "dd/MM/yyyy"), F.lit('"')))
        .when(kind == "3-MEDIUM", F.date_format(day, "MM-dd-yyyy"))
        .when(kind == "4-NOT SPECIFIED", F.date_diff(day.cast("date"), F.lit("1899-12-30").cast("date")).cast("string"))
        .otherwise(F.date_format(day, "d MMM yyyy")))
    df = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", written.alias("written"))
    out = normalize_dates(df, [ColumnMeta("Written", "date"), ColumnMeta("o_orderkey", "number")])
    return out.withColumn("written", F.col("written").cast("timestamp_ntz"))


@query("strip_html", """
    SELECT page_id, md5(CASE WHEN regexp_matches(html, '(?i)<[a-z][\\s\\S]*>')
                             THEN regexp_replace(html, '<[^>]*>', '', 'g') ELSE html END) AS html
    FROM pages""")
def strip_html_pages(spark, sf):
    df = strip_html(load(spark, sf, "pages").select("page_id", "html"), ["html"])
    return df.withColumn("html", F.md5("html"))


@query("injection_flags", r"""
    SELECT doc_id, NOT regexp_matches(text, '(?i)^data:[a-z]+/[a-z0-9+.-]+;base64,')
           AND NOT regexp_matches(text, '(?i)&[a-z0-9]+;')
           AND (regexp_matches(text, '(?i)(\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE)\b.*?\b(FROM|INTO|TABLE|SET|WHERE|JOIN)\b)')
             OR regexp_matches(text, '(--|/\*|\*/|@@|@@version)')
             OR regexp_matches(text, '(?i)(union.*select|union.*all)')
             OR regexp_matches(text, '(?i)(\bor\b\s+\d+\s*=\s*\d+)')
             OR regexp_matches(text, '(?i)(\band\b\s+\d+\s*=\s*\d+)')) AS suspicious
    FROM documents""")
def injection_flags(spark, sf):
    return flag_injection(load(spark, sf, "documents"), ["text"]).select("doc_id", "suspicious")


@query("classify_requests", """
    SELECT event_type, CASE WHEN event_type = 'signup' THEN 'error' WHEN event_type = 'error' THEN 'error'
                            WHEN event_type = 'view' OR value * 50 >= 1500 THEN 'warn' ELSE 'info' END AS level, count(*) AS n
    FROM events GROUP BY ALL""")
def classify_requests_events(spark, sf):
    status = (F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "view", 404)
              .when(F.col("event_type") != "signup", 200))
    df = load(spark, sf, "events").select("event_type", status.alias("status"), (F.col("value") * 50).alias("duration_ms"))
    return classify_requests(df).groupBy("event_type", "level").agg(F.count(F.lit(1)).alias("n"))


# --- validation ----------------------------------------------------------------

LINE_SCHEMA = [
    ColumnMeta("order_no", "integer"), ColumnMeta("quantity", "integer"), ColumnMeta("amount", "number"),
    ColumnMeta("status", "string", constraints={"enum": ["O"]}), ColumnMeta("is_returned", "boolean", nullable=True),
    ColumnMeta("ship_date", "date"), ColumnMeta("note", "string", nullable=True),
]


def raw_lines(spark, sf):
    """Line items as the text cells of a file, some of them wrong."""
    price = F.col("l_extendedprice").cast("string")
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_no"),
        F.when(F.col("l_quantity") == 50, "12.5").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity"),
        F.concat(F.when(F.col("l_extendedprice") < 5000, "-").otherwise("$"), price).alias("amount"),
        F.col("l_linestatus").alias("status"),
        F.when(F.col("l_returnflag") == "R", "Yes").when(F.col("l_returnflag") == "A", "0").otherwise("maybe").alias("is_returned"),
        F.when(F.col("l_discount") > 0.095, "31/02/1999").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("ship_date"),
        F.when(F.col("l_linestatus") == "F", "late").alias("note"))


_BAD = {"quantity": "l_quantity = 50", "amount": "l_extendedprice < 5000", "status": "l_linestatus <> 'O'",
        "ship_date": "l_discount > 0.095"}
_KIND = {"quantity": "invalid_format", "amount": "constraint_violation", "status": "constraint_violation",
         "ship_date": "missing_required_value"}
_ANY_BAD = " OR ".join(_BAD.values())


@query("validate_errors", " UNION ALL ".join(
    f"SELECT '{f}' AS field, '{_KIND[f]}' AS error_type, count(*) AS n FROM lineitem WHERE {c}" for f, c in _BAD.items()))
def validate_errors(spark, sf):
    errors = annotate(raw_lines(spark, sf), LINE_SCHEMA).select(F.inline("_errors"))
    return errors.groupBy("field", "error_type").agg(F.count(F.lit(1)).alias("n"))


@query("validate_split_counts", f"""
    SELECT count(*) AS total, count(*) FILTER (NOT ({_ANY_BAD})) AS clean, count(*) FILTER ({_ANY_BAD}) AS quarantined,
           count(*) FILTER (l_returnflag = 'N') AS warned
    FROM lineitem""")
def validate_split_counts(spark, sf):
    ok = F.col("_valid")
    return annotate(raw_lines(spark, sf), LINE_SCHEMA).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("clean"), F.count_if(~ok).alias("quarantined"),
        F.count_if(F.size("_warnings") > 0).alias("warned"))


@query("clean_rows", f"""
    SELECT CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS is_returned, count(*) AS n,
           sum(l_quantity)::BIGINT AS quantity, round(sum(l_extendedprice), 2) AS amount,
           min(l_shipdate) AS first_shipped, count(DISTINCT l_orderkey) AS orders
    FROM lineitem WHERE NOT ({_ANY_BAD}) GROUP BY 1""")
def clean_rows(spark, sf):
    clean, _ = clean_and_split(raw_lines(spark, sf), LINE_SCHEMA)
    return rounded(clean.groupBy("is_returned").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum("amount").alias("amount"),
        F.min("ship_date").cast("timestamp_ntz").alias("first_shipped"), F.countDistinct("order_no").alias("orders")))


@query("required_nulls", """
    SELECT 'kind' AS field, 'missing_required_value' AS error_type, count(*) AS n FROM events
    WHERE event_type = 'view' AND value <= 20
    UNION ALL SELECT NULL, 'unusable_row', count(*) FROM events WHERE event_type = 'view' AND value > 20""")
def required_nulls(spark, sf):
    raw = load(spark, sf, "events").select(
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
        F.when((F.col("event_type") != "view") | (F.col("value") <= 20), F.col("props")).alias("note"))
    _, bad = clean_and_split(raw, [ColumnMeta("kind"), ColumnMeta("note", nullable=True)])
    return bad.select(F.inline("errors")).groupBy("field", "error_type").agg(F.count(F.lit(1)).alias("n"))


@query("validate_rows", """
    SELECT 'quantity' AS field, 'constraint_violation' AS error_type, count(*) AS n FROM lineitem WHERE l_quantity + l_tax > 41
    UNION ALL SELECT 'quantity', 'invalid_format', count(*) FROM lineitem WHERE l_quantity + l_tax <> floor(l_quantity + l_tax)
    UNION ALL SELECT 'is_open', 'invalid_format', count(*) FROM lineitem WHERE l_linestatus = 'F'
    UNION ALL SELECT 'note', 'invalid_format', count(*) FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT 'shipped', 'invalid_format', count(*) FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT 'amount', 'type_mismatch', count(*) FROM lineitem WHERE l_extendedprice < 5000
    UNION ALL SELECT 'amount', 'missing_required_value', count(*) FROM lineitem WHERE l_extendedprice >= 5000""")
def validate_rows_lines(spark, sf):
    """Values as they stand: nothing is cleaned before it is checked."""
    df = load(spark, sf, "lineitem").select(
        (F.col("l_quantity") + F.col("l_tax")).alias("quantity"),
        F.when(F.col("l_linestatus") == "F", "late").otherwise("yes").alias("is_open"),
        F.nullif("l_returnflag", F.lit("R")).alias("flag"), F.when(F.col("l_returnflag") == "A", "").alias("note"),
        F.when(F.col("l_returnflag") == "R", "soon").otherwise("2024-01-31").alias("shipped"),
        F.when(F.col("l_extendedprice") < 5000, "5").otherwise("").alias("amount"))
    schema = [ColumnMeta("quantity", "number", constraints={"max": 41}), ColumnMeta("is_open", "boolean"),
              ColumnMeta("flag", "string", nullable=True, constraints={"enum": ["A", "N"]}), ColumnMeta("note", nullable=True),
              ColumnMeta("shipped", "date"), ColumnMeta("amount", "number")]
    errors = validate_rows(df, schema).select(F.inline("errors"))
    return errors.groupBy("field", "error_type").agg(F.count(F.lit(1)).alias("n"))


@query("validate_by_name", """
    SELECT 'p_count' AS field, count(*) AS n FROM part WHERE p_size >= 40
    UNION ALL SELECT 'is_active', count(*) FROM part WHERE p_type <> 'PROMO'""")
def validate_by_name_parts(spark, sf):
    df = load(spark, sf, "part").select(
        F.when(F.col("p_size") < 40, F.concat(F.col("p_size").cast("string"), F.lit(" pcs"))).otherwise("many").alias("p_count"),
        F.when(F.col("p_type") == "PROMO", "Y").otherwise(F.col("p_type")).alias("is_active"), "p_name")
    errors = validate_by_name(df).select(F.inline("errors"))
    return errors.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("clean_for_restore", """
    SELECT p_partkey, p_size::DOUBLE AS p_size, NULL::DOUBLE AS brand, p_type = 'PROMO' AS promo, p_name AS p_name,
           2 AS unread
    FROM part WHERE p_type = 'PROMO'
    UNION ALL SELECT p_partkey, p_size::DOUBLE, NULL, NULL, p_name, 3 FROM part WHERE p_type <> 'PROMO'""")
def clean_for_restore_parts(spark, sf):
    df = load(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("p_partkey"), F.concat(F.lit(" "), F.col("p_size"), F.lit(" kg")).alias("p_size"),
        F.col("p_brand").alias("brand"), F.col("p_brand").alias("brand_no"),
        F.when(F.col("p_type") == "PROMO", " YES ").otherwise(F.col("p_type")).alias("promo"),
        F.concat(F.col("p_name"), F.lit("  ")).alias("p_name"))
    schema = [ColumnMeta("p_partkey", "integer"), ColumnMeta("p_size", "number"), ColumnMeta("brand", "number"),
              ColumnMeta("brand_no", "integer"), ColumnMeta("promo", "boolean"), ColumnMeta("p_name", "string")]
    return clean_for_restore(df, schema).select("p_partkey", "p_size", "brand", "promo", "p_name",
                                                F.size("_bad").alias("unread"))


_PAYLOAD = [
    ColumnMeta("l_quantity", "number", constraints={"min": 2, "max": 45}),
    ColumnMeta("l_returnflag", "string", constraints={"pattern": "^[AN]$", "maxLength": 1}),
    ColumnMeta("l_linestatus", "string", nullable=True, constraints={"enum": ["O", "F"]}),
    ColumnMeta("l_tax", "integer", nullable=True), ColumnMeta("l_shipmode", "string", nullable=True),
]


@query("validate_payload", """
    SELECT error_type, count(*) AS n FROM (
        SELECT 'minimum' AS error_type FROM lineitem WHERE l_quantity < 2
        UNION ALL SELECT 'maximum' FROM lineitem WHERE l_quantity > 45
        UNION ALL SELECT 'pattern' FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL SELECT 'type' FROM lineitem WHERE l_tax <> floor(l_tax)
        UNION ALL SELECT 'additionalProperties' FROM lineitem WHERE l_linenumber IS NOT NULL) GROUP BY 1""")
def validate_payload_lines(spark, sf):
    df = load(spark, sf, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus", "l_tax", "l_linenumber")
    errors = validate_payload(df, _PAYLOAD).select(F.inline("errors"))
    return errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


@query("payload_summary", """
    SELECT count(*) AS total_processed,
           count(*) FILTER (l_quantity BETWEEN 2 AND 45 AND l_returnflag <> 'R' AND l_tax = floor(l_tax)) AS valid_count,
           count(*) FILTER (NOT (l_quantity BETWEEN 2 AND 45 AND l_returnflag <> 'R' AND l_tax = floor(l_tax))) AS error_count,
           bool_and(l_quantity BETWEEN 2 AND 45 AND l_returnflag <> 'R' AND l_tax = floor(l_tax)) AS is_valid
    FROM lineitem""")
def payload_summary_lines(spark, sf):
    df = load(spark, sf, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus", "l_tax")
    return payload_summary(validate_payload(df, _PAYLOAD))


@query("check_cross_columns", """
    SELECT error_type, count(*) AS n FROM (
        SELECT CASE WHEN l_quantity < 2 THEN 'minimum'
                    WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'unique' END AS error_type FROM lineitem
        UNION ALL SELECT 'foreignKey' FROM lineitem WHERE l_quantity >= 2 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40))
    WHERE error_type IS NOT NULL GROUP BY 1""")
def check_cross_columns_lines(spark, sf):
    """Keys are looked up only for rows that fit the schema."""
    schema = [ColumnMeta("l_quantity", "number", constraints={"min": 2}),
              ColumnMeta("l_orderkey", "number", constraints={"unique": True}),
              ColumnMeta("l_partkey", "number", constraints={"foreignKey": {"collection": "parts", "field": "p_partkey"}})]
    df = load(spark, sf, "lineitem").select("l_quantity", "l_orderkey", "l_partkey")
    stored = load(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    checked = check_cross_columns(validate_payload(df, schema), schema, stored, {"parts": load(spark, sf, "part").filter("p_size < 40")})
    return checked.select(F.inline("errors")).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


@query("unique_violations", """
    SELECT c_custkey, c_nationkey FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)""")
def unique_violations(spark, sf):
    existing = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return check_unique(load(spark, sf, "customer"), existing, "c_custkey").select("c_custkey", "c_nationkey")


@query("unique_within_batch", """
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
       OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def unique_within_batch(spark, sf):
    existing = load(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return check_unique(load(spark, sf, "lineitem"), existing, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("fk_violations", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def fk_violations(spark, sf):
    ref = load(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return check_foreign_key(load(spark, sf, "lineitem"), ref, "l_orderkey", "o_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey")
