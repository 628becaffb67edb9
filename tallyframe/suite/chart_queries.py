"""Chart data, dashboards and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.charts import boxplot, category_series, histogram, scatter, series_by_x
from ..operators.export import export_frame, export_log, flatten, sweep_stale, write_csv
from ..plans.charts import run_chart, run_dashboard
from ..session import scratch_dir
from .registry import load, query, rounded

_HISTOGRAM = """
    WITH v AS (SELECT measure, value FROM ({values}) WHERE value IS NOT NULL),
    r AS (SELECT floor(min(value) / {w}) * {w} AS lo, ceil(max(value) / {w}) * {w} AS hi FROM v),
    n AS (SELECT greatest(1, ceil((hi - lo) / {w}))::BIGINT AS bins FROM r),
    b AS (SELECT unnest(generate_series(0, (SELECT bins FROM n) - 1)) AS bin),
    c AS (SELECT measure, least((SELECT bins FROM n) - 1, floor((value - (SELECT lo FROM r)) / {w}))::BIGINT AS bin,
                 count(*) AS n FROM v GROUP BY ALL)
    SELECT m.measure, b.bin::BIGINT AS bin, ((SELECT lo FROM r) + b.bin * {w})::DOUBLE AS bin_start,
           ((SELECT lo FROM r) + (b.bin + 1) * {w})::DOUBLE AS bin_end, coalesce(c.n, 0)::BIGINT AS count
    FROM (SELECT DISTINCT measure FROM v) m CROSS JOIN b LEFT JOIN c ON c.measure = m.measure AND c.bin = b.bin"""


@query("histogram", _HISTOGRAM.format(w=10000, values="SELECT 'o_totalprice' AS measure, o_totalprice AS value FROM orders"))
def histogram_orders(spark, sf):
    return histogram(load(spark, sf, "orders"), ["o_totalprice"], 10_000)


@query("histogram_shared_bins", _HISTOGRAM.format(w=7, values="""
    SELECT 'l_quantity' AS measure, l_quantity AS value FROM lineitem
    UNION ALL SELECT 'supplier', l_suppkey::DOUBLE FROM lineitem
    UNION ALL SELECT 'line', l_linenumber::DOUBLE FROM lineitem"""))
def histogram_shared_bins(spark, sf):
    cols = {"l_quantity": "l_quantity", "supplier": "l_suppkey", "line": "l_linenumber"}
    return histogram(load(spark, sf, "lineitem"), cols, 7)


@query("histogram_closed_last_bin", _HISTOGRAM.format(w=10, values="SELECT 'p_size' AS measure, p_size::DOUBLE AS value FROM part"))
def histogram_closed_last_bin(spark, sf):
    return histogram(load(spark, sf, "part"), ["p_size"])


@query("boxplot", """
    SELECT measure, count(*) AS n, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q1,
           round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, max(v) AS max
    FROM (SELECT 'price' AS measure, l_extendedprice AS v FROM lineitem
          UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem)
    GROUP BY 1""")
def boxplot_lines(spark, sf):
    out = boxplot(load(spark, sf, "lineitem"), {"price": "l_extendedprice", "l_quantity": "l_quantity"})
    return rounded(out, 6, "q1", "median", "q3")


@query("scatter", "SELECT c_custkey::DOUBLE AS c_custkey, c_acctbal FROM customer")
def scatter_customers(spark, sf):
    return scatter(load(spark, sf, "customer"), "c_custkey", "c_acctbal")


@query("scatter_text_dropped", """
    SELECT p_size::DOUBLE AS p_size, try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand FROM part
    WHERE p_brand LIKE 'Brand#%'""")
def scatter_text_dropped(spark, sf):
    df = load(spark, sf, "part").withColumn("brand", F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    return scatter(df, "p_size", "brand")


@query("series_by_x", """
    SELECT measure, x, round(y, 6) AS y FROM (
        SELECT 'l_extendedprice' AS measure, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY l_quantity
        UNION ALL SELECT 'l_tax', l_quantity, sum(l_tax) FROM lineitem GROUP BY l_quantity
        UNION ALL SELECT 'l_discount', l_quantity, max(l_discount) FROM lineitem GROUP BY l_quantity)""")
def series_lines(spark, sf):
    return rounded(series_by_x(load(spark, sf, "lineitem"), "l_quantity", {
        "l_extendedprice": None, "l_tax": "SUM", "l_discount": "MAX"}), 6, "y")


@query("category_series", "SELECT p_type AS name, count(*) AS value FROM part GROUP BY 1")
def category_parts(spark, sf):
    return category_series(load(spark, sf, "part"), "p_type")


@query("chart_bar_filtered", """
    SELECT c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal FROM customer WHERE c_nationkey >= 10 GROUP BY 1""")
def chart_bar_filtered(spark, sf):
    chart = {"type": "bar", "datasetId": "customer", "x": "c_mktsegment", "y": {"field": "c_acctbal"}}
    filters = {"a": {"datasetId": "customer", "field": "c_nationkey", "operator": ">=", "value": "10"}}
    return rounded(run_chart(load(spark, sf, "customer"), chart, filters))


_CHARTS = [
    {"chartId": "by_status", "type": "bar", "datasetId": "orders",
     "query": {"dimensions": ["o_orderstatus"], "measures": [{"field": "*", "label": "value"}]}},
    {"chartId": "by_segment", "type": "pie", "datasetId": "customer",
     "query": {"dimensions": ["c_mktsegment"], "measures": [{"field": "*", "label": "value"}]}},
    {"chartId": "orders_kpi", "type": "kpi", "datasetId": "orders",
     "query": {"measures": [{"field": "*", "label": "value"}]}},
]
_DASHBOARD_FILTERS = [
    {"datasetId": "orders", "field": "o_orderpriority", "operator": "IN", "value": ["1-URGENT", "5-LOW"]},
    {"datasetId": "customer", "field": "c_acctbal", "operator": ">", "value": 0},
]


@query("dashboard_run", """
    SELECT 'by_status' AS chart, o_orderstatus AS name, count(*) AS value FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 2
    UNION ALL SELECT 'by_segment', c_mktsegment, count(*) FROM customer WHERE c_acctbal > 0 GROUP BY 2
    UNION ALL SELECT 'orders_kpi', NULL, count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def dashboard_run(spark, sf):
    frames = {n: load(spark, sf, n) for n in ("orders", "customer")}
    results = run_dashboard(_CHARTS, frames, _DASHBOARD_FILTERS)
    names = {"by_status": F.col("o_orderstatus"), "by_segment": F.col("c_mktsegment"),
             "orders_kpi": F.lit(None).cast("string")}
    parts = [df.select(F.lit(cid).alias("chart"), names[cid].alias("name"), "value") for cid, df in results.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("flatten_json", """
    SELECT event_id, user_id AS "who.id", event_type AS "who.kind", value AS "who.seen.value",
           '["' || event_type || '","k"]' AS tags
    FROM events""")
def flatten_json(spark, sf):
    df = load(spark, sf, "events").select(
        "event_id",
        F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.struct("value").alias("seen")).alias("who"),
        F.array("event_type", F.lit("k")).alias("tags"))
    return flatten(df)


@query("export_csv_roundtrip", """
    SELECT o_orderpriority, count(*)::VARCHAR AS n, max(o_custkey)::VARCHAR AS o_custkey FROM orders
    WHERE o_orderstatus = 'O' AND o_totalprice > 5000 GROUP BY 1""")
def export_csv_roundtrip(spark, sf):
    context = {"query": {"dimensions": ["o_orderpriority"],
                         "measures": [{"field": "*", "label": "n"}, {"field": "o_custkey", "aggregation": "MAX"}],
                         "filters": [{"field": "o_orderstatus", "operator": "=", "value": "O"}]},
               "dashboardFilters": [{"field": "o_totalprice", "operator": ">", "value": 5000}]}
    path = scratch_dir(spark, "export")
    write_csv(export_frame(load(spark, sf, "orders"), context), path)
    return spark.read.option("header", "true").csv(path)


@query("export_histogram", """
    WITH b AS (SELECT unnest(generate_series(0, 9)) AS bin),
    c AS (SELECT least(9, floor(l_quantity / 5))::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT (b.bin * 5)::BIGINT::VARCHAR || ' - ' || (b.bin * 5 + 5)::BIGINT::VARCHAR AS "Bin",
           (b.bin * 5)::DOUBLE AS "Start", (b.bin * 5 + 5)::DOUBLE AS "End", coalesce(n, 0)::BIGINT AS "Quantity Count"
    FROM b LEFT JOIN c USING (bin)""")
def export_histogram_lines(spark, sf):
    context = {"query": {"measures": [{"field": "l_quantity", "label": "Quantity"}], "binSize": 5,
                         "chartType": "histogram", "raw": True}}
    return export_frame(load(spark, sf, "lineitem"), context)


@query("export_legacy_selection", """
    SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY 1""")
def export_legacy_selection(spark, sf):
    return rounded(export_frame(load(spark, sf, "lineitem"), {
        "selectedDimensions": ["l_returnflag"], "selectedMeasures": ["l_quantity"],
        "sort": [{"field": "l_quantity", "direction": "desc"}]}))


def _log(spark, sf):
    """Events read as an export log."""
    return load(spark, sf, "events").select(
        F.col("event_type").alias("dataset"), F.col("event_id").alias("job"), F.col("ts").alias("exported_at"),
        F.when(F.col("value") > 20, "processing").otherwise("completed").alias("status"))


@query("export_log", """
    SELECT event_type AS dataset, event_id AS job, ts AS exported_at,
           CASE WHEN value > 20 THEN 'processing' ELSE 'completed' END AS status
    FROM events WHERE event_type = 'purchase' ORDER BY ts DESC LIMIT 50""")
def export_log_newest(spark, sf):
    return export_log(_log(spark, sf), "purchase")


@query("export_log_sweep", """
    SELECT event_type AS dataset, CASE WHEN value > 20 THEN 'failed' ELSE 'completed' END AS status,
           CASE WHEN value > 20 THEN 'Server restart or unexpected termination.' END AS failure_reason, count(*) AS n
    FROM events GROUP BY ALL""")
def export_log_sweep(spark, sf):
    return sweep_stale(_log(spark, sf)).groupBy("dataset", "status", "failure_reason").agg(F.count(F.lit(1)).alias("n"))


@query("histogram_wide", """
    SELECT 'value' AS measure, floor(v / 1000)::BIGINT - (SELECT floor(min(w) / 1000) FROM (SELECT value * 1e9 AS w FROM events))::BIGINT AS bin,
           floor(v / 1000) * 1000 AS bin_start, (floor(v / 1000) + 1) * 1000 AS bin_end, count(*) AS count
    FROM (SELECT value * 1e9 + 0.5 AS v FROM events) GROUP BY ALL""")
def histogram_wide(spark, sf):
    """Narrow bins over a wide range: only bins with values are made."""
    df = load(spark, sf, "events").select((F.col("value") * 1e9 + 0.5).alias("value"))
    return histogram(df, ["value"], 1000, empty=False)


@query("chart_raw_line", """
    SELECT 'o_totalprice' AS measure, (o_orderkey % 2)::DOUBLE AS x, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY ALL""")
def chart_raw_line(spark, sf):
    """A RAW line is averaged over all rows."""
    df = load(spark, sf, "orders").withColumn("half", F.col("o_orderkey") % 2)
    return rounded(run_chart(df, {"type": "line", "query": {
        "dimensions": ["half"], "measures": [{"field": "o_totalprice", "aggregation": "RAW"}]}}), 4, "y")


@query("chart_scatter", "SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 10")
def chart_scatter(spark, sf):
    return run_chart(load(spark, sf, "lineitem"), {"type": "scatter", "query": {
        "measures": ["l_quantity", "l_extendedprice"], "filters": [{"field": "l_quantity", "operator": ">", "value": 10}]}})
