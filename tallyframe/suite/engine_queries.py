"""Chart queries: filters, groups, buckets, sort, limits, percent of total."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.query import preview, run_query
from .registry import load, query, rounded


@query("revenue_by_flag", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity,
           round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 6) AS discount,
           max(l_extendedprice) AS largest, count(*) AS orders
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
    GROUP BY ALL""")
def revenue_by_flag(spark, sf):
    out = run_query(load(spark, sf, "lineitem"), {
        "dimensions": ["l_returnflag", "l_linestatus"],
        "measures": [{"field": "l_quantity", "label": "quantity"},
                     {"field": "l_extendedprice", "aggregation": "SUM", "label": "revenue"},
                     {"field": "l_discount", "aggregation": "AVG", "label": "discount"},
                     {"field": "l_extendedprice", "aggregation": "MAX", "label": "largest"},
                     {"field": "*", "aggregation": "COUNT", "label": "orders"}],
        "filters": [{"field": "l_shipdate", "operator": "<=", "value": "1998-09-02"}],
        "orderBy": [{"field": "l_returnflag"}, {"field": "l_linestatus"}],
    })
    return rounded(rounded(out, 2, "quantity", "revenue"), 6, "discount")


def _orders_by_priority(filters):
    def run(spark, sf):
        return rounded(run_query(load(spark, sf, "orders"), {
            "dimensions": ["o_orderpriority"],
            "measures": [{"field": "*", "aggregation": "COUNT", "label": "n"},
                         {"field": "o_totalprice", "label": "total"}],
            "filters": filters}))
    return run


def _orders_sql(where):
    return f"""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
               FROM orders WHERE {where} GROUP BY 1"""


for _name, _filters, _where in (
    ("filter_eq", [{"field": "o_orderstatus", "operator": "=", "value": "F"}], "o_orderstatus = 'F'"),
    ("filter_eq_number_text", {"o_custkey": "17"}, "o_custkey = 17"),
    ("filter_gt", [{"field": "o_totalprice", "operator": ">", "value": "250000"}], "o_totalprice > 250000"),
    ("filter_ge", [{"field": "o_orderkey", "operator": ">=", "value": 1234}], "o_orderkey >= 1234"),
    ("filter_lt_fraction", [{"field": "o_orderkey", "operator": "<", "value": "5000.5"}], "o_orderkey < 5000.5"),
    ("filter_le_date", [{"field": "o_orderdate", "operator": "<=", "value": "1997-06-30"}],
     "o_orderdate <= TIMESTAMP '1997-06-30'"),
    ("filter_range", [{"field": "o_orderdate", "operator": ">=", "value": "1996-01-01"},
                      {"field": "o_orderdate", "operator": "<", "value": "1997-01-01"},
                      {"field": "o_totalprice", "operator": ">", "value": 1000}],
     "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_totalprice > 1000"),
    ("filter_in", {"o_orderstatus": ["F", "P"]}, "o_orderstatus IN ('F', 'P')"),
    ("filter_in_text", [{"field": "o_orderpriority", "operator": "IN", "value": " 1-URGENT, 2-HIGH ,"}],
     "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("filter_in_empty", [{"field": "o_orderpriority", "operator": "IN", "value": ""}], "true"),
    ("filter_unknown_operator", [{"field": "o_orderpriority", "operator": "LIKE", "value": "1%"}], "true"),
    ("filter_text_vs_number", [{"field": "o_orderstatus", "operator": ">", "value": "5"}], "false"),
):
    query(_name, _orders_sql(_where))(_orders_by_priority(_filters))

_SEGMENTS = "(SELECT *, nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer)"


def _customers_by_segment(filters):
    def run(spark, sf):
        df = load(spark, sf, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
        return run_query(df, {"dimensions": ["segment"], "filters": filters, "measures": [
            {"field": "*", "label": "n"}, {"field": "c_acctbal", "aggregation": "MIN", "label": "least"}]})
    return run


for _name, _filters, _where in (
    ("filter_ne_nulls", [{"field": "segment", "operator": "!=", "value": "BUILDING"}],
     "segment IS DISTINCT FROM 'BUILDING'"),
    ("filter_ne_null_value", [{"field": "segment", "operator": "!=", "value": None}], "segment IS NOT NULL"),
    ("filter_eq_null", [{"field": "segment", "operator": "=", "value": None}], "segment IS NULL"),
    ("filter_not_in", [{"field": "segment", "operator": "NOT IN", "value": ["BUILDING", "FURNITURE"]}],
     "segment IS NULL OR segment NOT IN ('BUILDING', 'FURNITURE')"),
    ("filter_map_form", {"f1": {"field": "segment", "operator": "!=", "value": "FURNITURE"},
                         "c_nationkey": ["1", 2, "3"]},
     "segment IS DISTINCT FROM 'FURNITURE' AND c_nationkey IN (1, 2, 3)"),
):
    query(_name, f"SELECT segment, count(*) AS n, min(c_acctbal) AS least FROM {_SEGMENTS} WHERE {_where} GROUP BY 1")(
        _customers_by_segment(_filters))


def _bucket(unit, timezone="UTC"):
    def run(spark, sf):
        return rounded(run_query(load(spark, sf, "events"), {
            "dimensions": [{"field": "ts", "timeBucket": unit, "timezone": timezone}],
            "measures": [{"field": "*", "label": "n"}, {"field": "value", "label": "total"}]}))
    return run


for _unit in ("hour", "day", "month", "quarter", "year"):
    query(f"bucket_{_unit}", f"""
        SELECT CAST(date_trunc('{_unit}', ts) AS TIMESTAMP) AS ts, count(*) AS n, round(sum(value), 2) AS total
        FROM events GROUP BY 1""")(_bucket(_unit))
query("bucket_week_sunday", """
    SELECT CAST(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS TIMESTAMP) AS ts,
           count(*) AS n, round(sum(value), 2) AS total
    FROM events GROUP BY 1""")(_bucket("week"))
query("bucket_tz", """
    SELECT CAST(date_trunc('day', ts + INTERVAL 330 MINUTE) - INTERVAL 330 MINUTE AS TIMESTAMP) AS ts,
           count(*) AS n, round(sum(value), 2) AS total
    FROM events GROUP BY 1""")(_bucket("day", "+05:30"))


@query("bucket_text_dates", """
    SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS day, o_orderstatus, count(*) AS n
    FROM orders GROUP BY ALL""")
def bucket_text_dates(spark, sf):
    df = load(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    out = run_query(df, {"dimensions": [{"field": "day", "timeBucket": "month"}, "o_orderstatus"],
                         "measures": [{"field": "*", "aggregation": "COUNT", "label": "n"}]})
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("distinct_dims", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_dims(spark, sf):
    return run_query(load(spark, sf, "customer"), {"dimensions": ["c_nationkey", {"field": "c_mktsegment"}]})


@query("global_agg", """
    SELECT round(sum(c_acctbal), 2) AS c_acctbal, round(avg(c_acctbal), 6) AS mean, min(c_name) AS first_name,
           max(c_name) AS last_name, count(*) AS "COUNT(*)"
    FROM customer""")
def global_agg(spark, sf):
    out = run_query(load(spark, sf, "customer"), {"measures": [
        "c_acctbal", {"field": "c_acctbal", "aggregation": "avg", "label": "mean"},
        {"field": "c_name", "aggregation": "MIN", "label": "first_name"},
        {"field": "c_name", "aggregation": "MAX", "label": "last_name"}, {"field": "*"}]})
    return rounded(rounded(out, 2, "c_acctbal"), 6, "mean")


@query("global_count", "SELECT count(*) AS count FROM lineitem")
def global_count(spark, sf):
    return run_query(load(spark, sf, "lineitem"), {})


@query("global_empty", "SELECT count(*) AS count FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
def global_empty(spark, sf):
    return run_query(load(spark, sf, "lineitem"), {"filters": [{"field": "l_quantity", "operator": "<", "value": 0}]})


@query("sum_without_numbers", """
    SELECT c_nationkey, 0.0::DOUBLE AS names, NULL::DOUBLE AS mean,
           coalesce(sum(CASE WHEN c_acctbal < 0 THEN c_custkey END), 0)::DOUBLE AS in_debt
    FROM customer GROUP BY 1""")
def sum_without_numbers(spark, sf):
    df = load(spark, sf, "customer").withColumn("debtor", F.when(F.col("c_acctbal") < 0, F.col("c_custkey")))
    return run_query(df, {"dimensions": ["c_nationkey"], "measures": [
        {"field": "c_name", "aggregation": "SUM", "label": "names"},
        {"field": "c_name", "aggregation": "AVG", "label": "mean"},
        {"field": "debtor", "aggregation": "RAW", "label": "in_debt"}]})


@query("raw_projection", "SELECT c_name, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 0")
def raw_projection(spark, sf):
    return run_query(load(spark, sf, "customer"), {
        "dimensions": ["c_name", "c_mktsegment"], "measures": ["c_acctbal", {"field": "*"}], "raw": True,
        "filters": [{"field": "c_acctbal", "operator": ">", "value": "0"}], "rowLimit": 999_999})


@query("top_n_series", """
    SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders
    GROUP BY 1 ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey LIMIT 25""")
def top_n_series(spark, sf):
    return rounded(run_query(load(spark, sf, "orders"), {
        "dimensions": ["o_custkey"],
        "measures": [{"field": "o_totalprice", "label": "total"}, {"field": "*", "label": "n"}],
        "sortBy": [{"field": "total", "direction": "desc"}], "seriesLimit": 25}))


@query("sort_two_keys", """
    SELECT l_suppkey, count(*) AS n, max(l_quantity) AS most FROM lineitem
    GROUP BY 1 ORDER BY most DESC, n ASC, l_suppkey LIMIT 40""")
def sort_two_keys(spark, sf):
    return run_query(load(spark, sf, "lineitem"), {
        "dimensions": ["l_suppkey"], "rowLimit": "40",
        "measures": [{"field": "*", "label": "n"}, {"field": "l_quantity", "aggregation": "MAX", "label": "most"}],
        "orderBy": [{"field": "most", "direction": "DESC"}, {"field": "n"}, {"field": "nothing"}]})


@query("contribution_pct", """
    WITH top AS (SELECT l_suppkey, sum(l_quantity) AS quantity, count(*)::DOUBLE AS n FROM lineitem
                 GROUP BY 1 ORDER BY quantity DESC, l_suppkey LIMIT 20)
    SELECT l_suppkey, round(quantity / sum(quantity) OVER () * 100, 2) AS quantity,
           round(n / sum(n) OVER () * 100, 2) AS n FROM top""")
def contribution_pct(spark, sf):
    return run_query(load(spark, sf, "lineitem"), {
        "dimensions": ["l_suppkey"], "seriesLimit": 20, "contributionMode": "row",
        "measures": [{"field": "l_quantity", "label": "quantity"}, {"field": "*", "label": "n"}],
        "sortBy": [{"field": "quantity", "direction": "desc"}]})


@query("label_collision", """
    SELECT count(*) AS o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY orders.o_orderstatus""")
def label_collision(spark, sf):
    return rounded(run_query(load(spark, sf, "orders"), {
        "dimensions": ["o_orderstatus"],
        "measures": [{"field": "o_totalprice", "aggregation": "MAX", "label": "total"},
                     {"field": "*", "label": "o_orderstatus"}, {"field": "o_totalprice", "label": "total"}]}), 2, "total")


@query("page_preview", """
    SELECT o_orderkey AS _row_number, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100""")
def page_preview(spark, sf):
    df = load(spark, sf, "orders").select(F.col("o_orderkey").alias("_row_number"), "o_orderstatus", "o_totalprice")
    return preview(df, 25, 100)


@query("group_many", """
    SELECT o_orderkey, count(*) AS n, round(max(o_totalprice), 2) AS most FROM orders GROUP BY 1""")
def group_many(spark, sf):
    """As many groups as rows: nothing is cut without a limit."""
    return rounded(run_query(load(spark, sf, "orders"), {
        "dimensions": ["o_orderkey"],
        "measures": [{"field": "*", "label": "n"}, {"field": "o_totalprice", "aggregation": "MAX", "label": "most"}]}))


@query("filter_beyond_range", """
    SELECT count(*) AS n FROM events WHERE event_id < 99999999999999999999::HUGEINT
    AND user_id NOT IN (5) AND event_id > -99999999999999999999::HUGEINT""")
def filter_beyond_range(spark, sf):
    return run_query(load(spark, sf, "events"), {"measures": [{"field": "*", "label": "n"}], "filters": [
        {"field": "event_id", "operator": "<", "value": "99999999999999999999"},
        {"field": "user_id", "operator": "NOT IN", "value": [5, 10**30]},
        {"field": "event_id", "operator": ">", "value": -99999999999999999999}]})


@query("sum_beyond_long", """
    SELECT event_type, sum((event_id + 4000000000000000000)::HUGEINT)::DOUBLE AS total FROM events GROUP BY 1""")
def sum_beyond_long(spark, sf):
    df = load(spark, sf, "events").withColumn("big", F.col("event_id") + 4_000_000_000_000_000_000)
    return run_query(df, {"dimensions": ["event_type"], "measures": [{"field": "big", "label": "total"}]})


@query("bucket_clock_change", """
    SELECT CAST(to_timestamp(floor(epoch(ts) / 3600) * 3600) AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts, count(*) AS n
    FROM (SELECT TIMESTAMP '2024-11-03 00:00:00' + to_minutes((event_id % 1440)::INTEGER) AS ts FROM events) GROUP BY 1""")
def bucket_clock_change(spark, sf):
    """Hours of a day on which the clock goes back: the repeated hour is two hours."""
    df = load(spark, sf, "events").select((F.lit("2024-11-03 00:00:00").cast("timestamp_ntz") + F.make_interval(
        mins=(F.col("event_id") % 1440).cast("int"))).alias("ts"))
    return run_query(df, {"dimensions": [{"field": "ts", "timeBucket": "hour", "timezone": "America/New_York"}],
                          "measures": [{"field": "*", "label": "n"}]})


@query("contribution_all", """
    WITH g AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1)
    SELECT o_custkey, round(total / sum(total) OVER () * 100, 2) AS total FROM g""")
def contribution_all(spark, sf):
    """Percent of the total of all groups."""
    return run_query(load(spark, sf, "orders"), {"dimensions": ["o_custkey"], "contributionMode": "row",
                                                 "measures": [{"field": "o_totalprice", "label": "total"}]})
