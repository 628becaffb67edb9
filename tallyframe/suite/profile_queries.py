"""Profiles, schema inference and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import (
    is_foreign_key, is_generic_id, is_key_like, is_primary_key, points_to, snake_case,
)
from ..operators.columns import ColumnMeta, columns_of, override_column, serialize_schema
from ..operators.profile import infer_schema, profile, profile_frame, reclean, value_type
from ..operators.relate import detect_relationships, edges_of, edges_with_names, merge_edges, types_compatible, value_overlap
from .registry import load, query, rounded

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_TYPE = f"""CASE WHEN v IS NULL OR v = '' THEN NULL WHEN lower(v) IN ('true', 'false', '1', '0') THEN 'boolean'
    WHEN regexp_matches(v, '{_NUMBER}') THEN 'number'
    WHEN regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}') THEN 'date' ELSE 'string' END"""


def _profile_sql(table, columns):
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS v FROM {table}" for c in columns)
    kinds = ", ".join(f"count(*) FILTER (kind = '{t}') AS {t}_values" for t in ("string", "number", "date", "boolean"))
    return f"""
        SELECT "column", count(*) AS row_count, count(*) FILTER (kind IS NULL) AS null_count,
               count(DISTINCT v) FILTER (kind IS NOT NULL) AS unique_count, {kinds},
               round(count(DISTINCT v) FILTER (kind IS NOT NULL) / greatest(count(kind), 1), 6) AS cardinality_ratio
        FROM (SELECT *, {_TYPE} AS kind FROM ({cells})) GROUP BY 1"""


def _profile(table, columns):
    def run(spark, sf):
        return rounded(profile(load(spark, sf, table).select(*columns), exact=True), 6)
    return run


for _table, _columns in {
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "labels": ["doc_id", "quality", "toxic"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}.items():
    query(f"profile_{_table}", _profile_sql(_table, _columns))(_profile(_table, _columns))


@query("profile_nulls", """
    SELECT 'segment' AS "column", count(*) AS row_count, count(*) FILTER (c_mktsegment = 'BUILDING') AS null_count,
           count(DISTINCT nullif(c_mktsegment, 'BUILDING')) AS unique_count FROM customer""")
def profile_nulls(spark, sf):
    df = load(spark, sf, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return profile(df, exact=True).select("column", "row_count", "null_count", "unique_count")


@query("profile_sketch", """
    SELECT 'o_orderstatus' AS "column", count(*) AS row_count, count(DISTINCT o_orderstatus) AS unique_count FROM orders
    UNION ALL SELECT 'o_orderpriority', count(*), count(DISTINCT o_orderpriority) FROM orders""")
def profile_sketch(spark, sf):
    df = load(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    return profile(df).select("column", "row_count", "unique_count")


@query("value_types", f"""
    SELECT source, kind, count(*) AS n FROM (
        SELECT source, {_TYPE} AS kind FROM (
            SELECT 'quality' AS source, quality::VARCHAR AS v FROM labels
            UNION ALL SELECT 'role', role FROM conversations UNION ALL SELECT 'url', url FROM pages
            UNION ALL SELECT 'shipped', l_shipdate::VARCHAR FROM lineitem
            UNION ALL SELECT 'price', o_totalprice::VARCHAR FROM orders)) GROUP BY ALL""")
def value_types(spark, sf):
    parts = [("quality", "labels", "quality"), ("role", "conversations", "role"), ("url", "pages", "url"),
             ("shipped", "lineitem", "l_shipdate"), ("price", "orders", "o_totalprice")]
    out = None
    for source, table, column in parts:
        df = load(spark, sf, table).select(F.lit(source).alias("source"), value_type(F.col(column).cast("string")).alias("kind"))
        out = df if out is None else out.unionAll(df)
    return out.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("infer_schema_all_rows", """
    SELECT 'event_id' AS name, 'number' AS dtype, 'dimension' AS role, NULL AS suggested_aggregation, count(*) AS unique_count FROM events
    UNION ALL SELECT 'ts', 'date', 'dimension', NULL, count(DISTINCT ts) FROM events
    UNION ALL SELECT 'total_value', 'number', CASE WHEN count(DISTINCT value) <= 15 OR count(DISTINCT value) / count(*) < 0.02
                     THEN 'dimension' ELSE 'measure' END,
                     CASE WHEN count(DISTINCT value) <= 15 OR count(DISTINCT value) / count(*) < 0.02 THEN NULL ELSE 'sum' END,
                     count(DISTINCT value) FROM events
    UNION ALL SELECT 'event_type', 'string', 'dimension', NULL, count(DISTINCT event_type) FROM events""")
def infer_schema_all_rows(spark, sf):
    df = load(spark, sf, "events").select("event_id", "ts", F.col("value").alias("total_value"), "event_type")
    return profile_frame(spark, "events", infer_schema(df, exact=True)).select(
        "name", "dtype", "role", "suggested_aggregation", "unique_count")


@query("schema_compact", """
    SELECT 'customer' AS dataset, 'c_custkey:number;c_name:string;c_nationkey:number;c_acctbal:number;c_mktsegment:string' AS columns,
           count(*) AS row_count, sha256('c_custkey:number;c_name:string;c_nationkey:number;c_acctbal:number;c_mktsegment:string') AS fingerprint
    FROM customer""")
def schema_compact(spark, sf):
    df = load(spark, sf, "customer")
    compact = F.lit(serialize_schema(columns_of(df)))
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("customer").alias("dataset"), compact.alias("columns"), "row_count", F.sha2(compact, 256).alias("fingerprint"))


@query("profile_long_texts", """
    SELECT 'text' AS "column", count(*) AS row_count, count(DISTINCT text) AS unique_count, count(*) AS string_values FROM documents""")
def profile_long_texts(spark, sf):
    df = load(spark, sf, "documents").select("text")
    return profile(df, exact=True).select("column", "row_count", "unique_count", "string_values")


@query("override_and_reclean", """
    SELECT p_partkey, replace(p_brand, 'Brand#', '')::DOUBLE AS p_brand, p_size::VARCHAR AS p_size, p_type = 'PROMO' AS p_type
    FROM part WHERE p_type = 'PROMO'
    UNION ALL SELECT p_partkey, replace(p_brand, 'Brand#', '')::DOUBLE, p_size::VARCHAR, NULL FROM part WHERE p_type <> 'PROMO'""")
def override_and_reclean(spark, sf):
    """Columns whose type a user changed are cleaned again under the new one."""
    df = load(spark, sf, "part").select("p_partkey", "p_brand", "p_size",
                                        F.when(F.col("p_type") == "PROMO", "yes").otherwise(F.col("p_type")).alias("p_type"))
    schema = override_column(columns_of(df), "p_brand", type="number", role="measure")
    schema = override_column(override_column(schema, "p_size", type="string"), "p_type", type="boolean")
    return reclean(df, [c for c in schema if c.name != "p_partkey"])


@query("value_overlap", """
    WITH a AS (SELECT DISTINCT l_partkey AS v FROM lineitem), b AS (SELECT DISTINCT p_partkey AS v FROM part)
    SELECT (SELECT count(*) FROM a JOIN b USING (v)) AS shared, (SELECT count(*) FROM a) AS a_values,
           (SELECT count(*) FROM b) AS b_values,
           (SELECT count(*) FROM a JOIN b USING (v)) / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS overlap""")
def value_overlap_parts(spark, sf):
    return value_overlap(load(spark, sf, "lineitem"), "l_partkey", load(spark, sf, "part"), "p_partkey")


# Tables under the column names a dictionary of the model would give them.
MODEL = {
    "regions": ("region", {"region_id": "r_regionkey", "name": "r_name"}),
    "nations": ("nation", {"nation_id": "n_nationkey", "name": "n_name", "region_id": "n_regionkey"}),
    "customers": ("customer", {"customer_id": "c_custkey", "nation_id": "c_nationkey", "segment": "c_mktsegment"}),
    "suppliers": ("supplier", {"supplier_id": "s_suppkey", "nation_id": "s_nationkey"}),
    "orders": ("orders", {"order_id": "o_orderkey", "customer_id": "o_custkey", "status": "o_orderstatus"}),
    "order_lines": ("lineitem", {"order_id": "l_orderkey", "part_id": "l_partkey", "supplier_id": "l_suppkey",
                                 "status": "l_linestatus"}),
    "parts": ("part", {"part_id": "p_partkey", "size": "p_size"}),
}


def model_frames(spark, sf):
    return {name: load(spark, sf, table).select(*(F.col(c).alias(n) for n, c in cols.items()))
            for name, (table, cols) in MODEL.items()}


def _kind(column):
    return "string" if column in ("name", "segment", "status") else "number"


def _detect_sql():
    """Overlaps and scores in SQL; the facts that follow from names are constants."""
    cols, targets, values = [], [], []
    for pos, (ds, (table, columns)) in enumerate(MODEL.items()):
        for c, source in columns.items():
            i = len(cols)
            cols.append(f"({i}, {pos}, '{ds}', '{c}', '{snake_case(c)}', '{_kind(c)}', {is_key_like(c)}, "
                        f"{is_generic_id(c)}, {is_primary_key(c, ds)}, {is_foreign_key(c, ds)})")
            targets += [f"({i}, '{d}')" for d in MODEL if points_to(c, d)]
            values.append(f"SELECT DISTINCT {i} AS id, trim({source}::VARCHAR) AS v FROM {table}")
    compat = " OR ".join(f"(x.kind = '{a}' AND y.kind = '{b}')" for a in ("number", "string")
                         for b in ("number", "string") if types_compatible(a, b))
    return f"""
        WITH cols(id, pos, ds, col, norm, kind, key_like, generic, is_pk, is_fk) AS (VALUES {', '.join(cols)}),
        targets(id, ds) AS (VALUES {', '.join(targets)}),
        vals AS ({' UNION ALL '.join(values)}),
        sizes AS (SELECT id, count(*) AS n FROM vals WHERE v <> '' GROUP BY 1),
        shared AS (SELECT a.id AS i, b.id AS j, count(*) AS n FROM vals a JOIN vals b ON a.v = b.v AND a.id < b.id AND a.v <> '' GROUP BY ALL),
        pairs AS (SELECT a.id AS i, b.id AS j FROM cols a JOIN cols b ON a.pos < b.pos
                  WHERE (a.key_like OR b.key_like OR a.norm = b.norm) AND NOT (a.generic AND b.generic)),
        directed AS (SELECT i, j, i AS f, j AS t, 0 AS back FROM pairs UNION ALL SELECT i, j, j, i, 1 FROM pairs),
        scored AS (
            SELECT d.i, d.j, back, x.ds AS from_dataset, x.col AS from_column, y.ds AS to_dataset, y.col AS to_column,
                CASE WHEN x.norm = y.norm AND NOT x.generic THEN 0.40::DOUBLE ELSE 0 END
                + CASE WHEN x.is_fk AND y.is_pk AND (x.id, y.ds) IN (SELECT (id, ds) FROM targets) THEN 0.50::DOUBLE ELSE 0 END
                + CASE WHEN NOT (x.is_fk OR x.is_pk OR y.is_pk OR (x.norm = y.norm AND NOT x.generic)) THEN 0
                       WHEN coalesce(s.n, 0) / least(sx.n, sy.n) >= 0.8 THEN 0.30::DOUBLE
                       WHEN coalesce(s.n, 0) / least(sx.n, sy.n) >= 0.5 THEN coalesce(s.n, 0) / least(sx.n, sy.n) * 0.20::DOUBLE ELSE 0 END
                + CASE WHEN {compat} THEN 0.05::DOUBLE ELSE -0.20::DOUBLE END
                + CASE WHEN y.is_pk THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN x.is_fk THEN 0.05::DOUBLE ELSE 0 END
                + CASE WHEN sx.n > 10 AND sy.n > 10 THEN 0.05::DOUBLE ELSE 0 END AS score
            FROM directed d JOIN cols x ON x.id = f JOIN cols y ON y.id = t JOIN sizes sx ON sx.id = f JOIN sizes sy ON sy.id = t
            LEFT JOIN shared s ON s.i = d.i AND s.j = d.j),
        best AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY score DESC, back) AS r FROM scored)
        SELECT from_dataset, from_column, to_dataset, to_column, round(least(score, 1), 2) AS confidence, 'inferred' AS source
        FROM best WHERE r = 1 AND score >= 0.45"""


def _detected(spark, sf):
    schemas = {ds: [ColumnMeta(c, _kind(c)) for c in cols] for ds, (_, cols) in MODEL.items()}
    return detect_relationships(spark, schemas, model_frames(spark, sf))


query("detect_relationships", _detect_sql())(_detected)


@query("merge_edges", f"""
    WITH d AS ({_detect_sql()}) SELECT * FROM d
    WHERE NOT (from_column = 'customer_id' AND to_column = 'customer_id') AND (from_dataset IN ('orders', 'customers', 'nations') AND to_dataset IN ('orders', 'customers', 'nations'))
    UNION ALL SELECT 'customers', 'customer_id', 'orders', 'customer_id', 1.0, 'manual'
    UNION ALL SELECT 'orders', 'status', 'order_lines', 'status', 0.7, 'inferred'""")
def merge_edges_refresh(spark, sf):
    """A manual link and one to a dataset outside the refresh stay; a stale inferred one goes."""
    ids = ["orders", "customers", "nations"]
    old = spark.createDataFrame(
        [("customers", "customer_id", "orders", "customer_id", 1.0, "manual"),
         ("orders", "status", "order_lines", "status", 0.7, "inferred"),
         ("nations", "name", "customers", "segment", 0.5, "inferred")],
        "from_dataset string, from_column string, to_dataset string, to_column string, confidence double, source string")
    found = _detected(spark, sf).filter(F.col("from_dataset").isin(ids) & F.col("to_dataset").isin(ids))
    return merge_edges(old, found, ids)


@query("edges_of_with_names", f"""
    WITH d AS ({_detect_sql()}), c AS (SELECT 'orders' AS dataset, 'Orders ' || count(*) AS name FROM orders)
    SELECT d.*, coalesce(f.name, from_dataset) AS from_name, coalesce(t.name, to_dataset) AS to_name
    FROM d LEFT JOIN c f ON f.dataset = from_dataset LEFT JOIN c t ON t.dataset = to_dataset
    WHERE 'orders' IN (from_dataset, to_dataset)""")
def edges_of_with_names(spark, sf):
    catalog = load(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("orders").alias("dataset"), F.concat(F.lit("Orders "), "n").alias("name"))
    return edges_with_names(edges_of(_detected(spark, sf), "orders"), catalog)


@query("value_overlap_mixed_types", """
    SELECT count(*) AS shared, (SELECT count(DISTINCT o_custkey) FROM orders) AS a_values, (SELECT count(*) FROM customer) AS b_values,
           count(*) / least((SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(*) FROM customer)) AS overlap
    FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def value_overlap_mixed_types(spark, sf):
    """Whole numbers as doubles meet the same numbers as text."""
    a = load(spark, sf, "orders").select(F.col("o_custkey").cast("double").alias("k"))
    b = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    return value_overlap(a, "k", b, "k")
