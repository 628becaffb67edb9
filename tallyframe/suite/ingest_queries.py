"""Files, stored datasets, duplicates, catalog lists and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.catalog import list_charts, list_datasets, search_datasets, visible_to
from ..operators.columns import ColumnMeta
from ..operators.dedupe import backfill_defaults, dedupe_keep_first, find_duplicates, insert_idempotent
from ..operators.export import export_dataset
from ..operators.quarantine import restore_into
from ..operators.validate import split_structural
from ..session import scratch_dir
from ..sources.csv import read_csv_raw, sample_rows
from ..sources.store import AppendRefused, Store
from ..streaming.events import latest_counts, rate_counts, rate_flags, read_batches, stream_dedupe, write_batches
from ..streaming.ingest import read_ingested, stream_ingest
from .quarantine_queries import EVENT_SCHEMA, raw_events
from .registry import load, query, rounded

ORDER_SCHEMA = [
    ColumnMeta("o_orderkey", "integer"), ColumnMeta("o_custkey", "integer"), ColumnMeta("o_orderstatus", "string"),
    ColumnMeta("o_totalprice", "number"), ColumnMeta("o_orderdate", "date"), ColumnMeta("o_orderpriority", "string"),
]


def orders_csv(spark, sf):
    path = scratch_dir(spark, "orders-csv")
    load(spark, sf, "orders").write.option("header", "true").csv(path)
    return path


@query("ingest_csv_roundtrip", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
           o_orderpriority[1:1] || lower(o_orderpriority[2:]) AS o_orderpriority FROM orders""")
def ingest_csv_roundtrip(spark, sf):
    store = Store(spark, scratch_dir(spark, "store"))
    store.write_dataset("orders", read_csv_raw(spark, orders_csv(spark, sf)), ORDER_SCHEMA)
    out = store.load_dataset("orders").drop("_row_number", "_source_file")
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("ingest_append", """
    SELECT 2 * count(*) AS row_count, 2 * count(*) AS row_numbers, 2::BIGINT AS first_row, 2 * count(*) + 2 AS last_row,
           round(2 * sum(o_totalprice), 2) AS total FROM orders""")
def ingest_append(spark, sf):
    """The same file twice: appended rows are numbered after the stored ones."""
    store = Store(spark, scratch_dir(spark, "store"))
    path = scratch_dir(spark, "orders-csv")
    load(spark, sf, "orders").coalesce(1).write.option("header", "true").csv(path)
    store.write_dataset("orders", read_csv_raw(spark, path), ORDER_SCHEMA)
    store.write_dataset("orders", read_csv_raw(spark, path), mode="append")
    return rounded(store.load_dataset("orders").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("_row_number").alias("row_numbers"),
        F.min("_row_number").alias("first_row"), F.max("_row_number").alias("last_row"),
        F.sum("o_totalprice").alias("total")))


@query("ingest_catalog", """
    SELECT 'events' AS dataset, 'replace' AS mode,
           count(*) FILTER (NOT (event_type IN ('error', 'purchase') OR user_id < 5)) AS row_count,
           count(*) FILTER (event_type IN ('error', 'purchase') OR user_id < 5) AS quarantined_count FROM events""")
def ingest_catalog(spark, sf):
    store = Store(spark, scratch_dir(spark, "store"))
    store.write_dataset("events", raw_events(spark, sf), EVENT_SCHEMA)
    store.write_dataset("events", raw_events(spark, sf), EVENT_SCHEMA, mode="replace")
    return store.catalog().select("dataset", "mode", "row_count", "quarantined_count")


@query("ingest_restore", """
    SELECT status, count(*) AS n FROM (
        SELECT CASE WHEN event_type = 'error' AND user_id >= 5 THEN 'RESTORED' ELSE 'QUARANTINED' END AS status
        FROM events WHERE event_type IN ('error', 'purchase') OR user_id < 5) GROUP BY 1
    UNION ALL SELECT 'CLEAN', count(*) FROM events WHERE event_type <> 'purchase' AND user_id >= 5""")
def ingest_restore(spark, sf):
    store = Store(spark, scratch_dir(spark, "store"))
    store.write_dataset("events", raw_events(spark, sf), EVENT_SCHEMA)
    edits = load(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("event_id").alias("row_number"),
        F.create_map(F.lit("item_count"), F.lit("7"), F.lit("status"), F.lit("Error")).alias("data"))
    restore_into(store, "events", edits)
    left = store.load_quarantine("events").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return left.union(store.load_dataset("events").agg(F.lit("CLEAN").alias("status"), F.count(F.lit(1)).alias("n")))


@query("ingest_drop", "SELECT 'kept' AS dataset, count(*) AS row_count, 0::BIGINT AS quarantined_count FROM orders")
def ingest_drop(spark, sf):
    """Of two stored datasets one is dropped with its rows."""
    store = Store(spark, scratch_dir(spark, "store"))
    raw = load(spark, sf, "orders").select(*(F.col(c.name).cast("string").alias(c.name) for c in ORDER_SCHEMA),
                                           F.col("o_orderkey").alias("_row_number"), F.lit("orders").alias("_source_file"))
    for name in ("kept", "gone"):
        store.write_dataset(name, raw, ORDER_SCHEMA)
    store.drop_datasets(["gone", "unknown"])
    return store.catalog().select("dataset", "row_count", "quarantined_count")


@query("export_dataset_csv", """
    SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice), 2) AS total, 0::BIGINT AS filled FROM lineitem""")
def export_dataset_csv(spark, sf):
    """A whole table as CSV in parallel parts, with a column it does not have, read back."""
    path = scratch_dir(spark, "dataset")
    schema = [ColumnMeta("l_orderkey"), ColumnMeta("l_extendedprice"), ColumnMeta("l_comment")]
    export_dataset(load(spark, sf, "lineitem"), path, schema)
    back = spark.read.option("header", "true").csv(path)
    return rounded(back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("orders"),
                            F.sum(F.col("l_extendedprice").cast("double")).alias("total"), F.count("l_comment").alias("filled")))


@query("csv_row_numbers", "SELECT count(*) AS row_count, count(*) AS numbered, 0::BIGINT AS gaps FROM orders")
def csv_row_numbers(spark, sf):
    """Dense numbers from 2, unique over all files."""
    path = scratch_dir(spark, "orders-csv")
    load(spark, sf, "orders").repartition(3).write.option("header", "true").csv(path)
    return read_csv_raw(spark, path).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("_row_number").alias("numbered"),
        (F.max("_row_number") - 1 - F.count(F.lit(1)) + F.min("_row_number") - 2).alias("gaps"))


@query("ingest_two_files_restore", """
    SELECT 'CLEAN' AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    UNION ALL SELECT 'RESTORED', count(*) FILTER (o_orderkey % 7 = 3), 0 FROM orders""")
def ingest_two_files_restore(spark, sf):
    """Rows of several files lost their price, and get it back by edits found through the quarantine."""
    path = scratch_dir(spark, "orders-csv")
    orders = load(spark, sf, "orders")
    bad = F.when(F.col("o_orderkey") % 7 == 3, F.lit(None)).otherwise(F.col("o_totalprice"))
    orders.withColumn("o_totalprice", bad).repartition(3).write.option("header", "true").csv(path)
    store = Store(spark, scratch_dir(spark, "store"))
    store.write_dataset("orders", read_csv_raw(spark, path), ORDER_SCHEMA)
    price = orders.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").cast("string").alias("price"))
    edits = store.load_quarantine("orders").join(price, F.col("raw")["o_orderkey"] == F.col("key")).select(
        "row_number", F.create_map(F.lit("o_totalprice"), F.col("price")).alias("data"))
    restore_into(store, "orders", edits)
    left = store.load_quarantine("orders").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("total"))
    clean = store.load_dataset("orders").agg(F.lit("CLEAN").alias("status"), F.count(F.lit(1)).alias("n"),
                                             F.round(F.sum("o_totalprice"), 2).alias("total"))
    return clean.union(left)


@query("ingest_append_refused", """
    SELECT 'missing' AS what, 'o_totalprice' AS name, count(*) AS row_count FROM orders
    UNION ALL SELECT 'unexpected', 'price', count(*) FROM orders""")
def ingest_append_refused(spark, sf):
    """An append with another column is refused and leaves the stored rows as they were."""
    store = Store(spark, scratch_dir(spark, "store"))
    raw = read_csv_raw(spark, orders_csv(spark, sf))
    store.write_dataset("orders", raw, ORDER_SCHEMA)
    try:
        store.write_dataset("orders", raw.withColumnRenamed("o_totalprice", "price"), mode="append")
        found = {}
    except AppendRefused as e:
        found = e.comparison
    parts = [store.load_dataset("orders").agg(F.lit(what).alias("what"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("row_count"))
             for what, key in (("missing", "missing_columns"), ("unexpected", "unexpected_columns")) for name in found.get(key, ())]
    return parts[0].union(parts[1])


@query("ingest_append_repeated", "SELECT 2 * count(*) AS row_count, round(2 * sum(o_totalprice), 2) AS total FROM orders")
def ingest_append_repeated(spark, sf):
    """The same load twice counts once."""
    store = Store(spark, scratch_dir(spark, "store"))
    raw = read_csv_raw(spark, orders_csv(spark, sf))
    store.write_dataset("orders", raw, ORDER_SCHEMA)
    for _ in range(2):
        store.write_dataset("orders", raw, mode="append", load_id="second")
    return rounded(store.load_dataset("orders").agg(F.count(F.lit(1)).alias("row_count"), F.sum("o_totalprice").alias("total")))


@query("ingest_override", """
    SELECT o_orderkey, o_totalprice::BIGINT - CASE WHEN o_totalprice::BIGINT > o_totalprice THEN 1 ELSE 0 END AS o_totalprice FROM orders""")
def ingest_override(spark, sf):
    """A stored number column shown as whole numbers."""
    store = Store(spark, scratch_dir(spark, "store"))
    store.write_dataset("orders", read_csv_raw(spark, orders_csv(spark, sf)), ORDER_SCHEMA)
    store.set_columns("orders", [ColumnMeta(c.name, "integer") if c.name == "o_totalprice" else c for c in ORDER_SCHEMA])
    return store.load_dataset("orders").select("o_orderkey", "o_totalprice")


@query("stream_two_batches", "SELECT count(*) AS row_count, count(*) AS numbered, round(sum(o_totalprice), 2) AS total FROM orders")
def stream_two_batches(spark, sf):
    """Files that arrive in many micro-batches: every row has a number of its own."""
    path, out = scratch_dir(spark, "orders-csv"), scratch_dir(spark, "stream")
    load(spark, sf, "orders").repartition(3).write.option("header", "true").csv(path)
    stream_ingest(spark, path, out, ORDER_SCHEMA, max_files=1).awaitTermination()
    clean, _ = read_ingested(spark, out)
    return rounded(clean.agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("_row_number").alias("numbered"),
                             F.sum("o_totalprice").alias("total")))


@query("csv_structural", """
    SELECT count(*) FILTER (event_type NOT IN ('view', 'error')) AS well_formed,
           count(*) FILTER (event_type IN ('view', 'error')) AS broken FROM events""")
def csv_structural(spark, sf):
    """Views have a cell too many, errors one too few."""
    path = scratch_dir(spark, "broken-csv")
    cells = (F.when(F.col("event_type") == "view", F.concat_ws(",", "event_id", "event_type", "value", "user_id"))
             .when(F.col("event_type") == "error", F.concat_ws(",", "event_id", "event_type"))
             .otherwise(F.concat_ws(",", "event_id", "event_type", "value")))
    header = F.when(F.col("event_id") == 0, F.concat(F.lit("id,kind,value\n"), cells)).otherwise(cells)
    load(spark, sf, "events").coalesce(1).sortWithinPartitions("event_id").select(header).write.text(path)
    good, bad = split_structural(read_csv_raw(spark, path, row_numbers=False))
    parts = good.select(F.lit(1).alias("g"), "id").unionAll(bad.select(F.lit(0).alias("g"), "id"))
    return parts.agg(F.sum("g").alias("well_formed"), F.sum(1 - F.col("g")).alias("broken"))


@query("sample_rows", "SELECT 100::BIGINT AS sampled, 100::BIGINT AS known FROM (SELECT count(*) AS n FROM events) WHERE n >= 100")
def sample_rows_events(spark, sf):
    events = load(spark, sf, "events")
    picked = sample_rows(events.select("event_id"), 100)
    known = picked.join(events.select("event_id"), "event_id", "left_semi")
    return picked.agg(F.count(F.lit(1)).alias("sampled")).withColumn(
        "known", known.agg(F.count(F.lit(1)).alias("n")).scalar())


# --- duplicates ------------------------------------------------------------------

@query("find_duplicates", """
    SELECT l_orderkey, l_linenumber, count(*) AS count, max(l_shipdate) AS last_updated FROM lineitem
    GROUP BY 1, 2 HAVING count(*) > 1""")
def find_duplicates_lines(spark, sf):
    return find_duplicates(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate")


@query("dedupe_keep_first", """
    SELECT l_returnflag, l_linenumber, l_orderkey, l_partkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey) = 1""")
def dedupe_keep_first_lines(spark, sf):
    """Few keys that hold very many rows each."""
    df = load(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")
    return dedupe_keep_first(df, ["l_returnflag", "l_linenumber"],
                             F.struct("l_orderkey", "l_partkey", "l_suppkey")).drop("l_suppkey")


@query("insert_idempotent", """
    SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)""")
def insert_idempotent_customers(spark, sf):
    new = load(spark, sf, "orders").select("o_custkey")
    have = load(spark, sf, "customer").filter("c_acctbal > 3000").select(F.col("c_custkey").alias("o_custkey"))
    return insert_idempotent(new, have, ["o_custkey"])


@query("backfill_defaults", """
    SELECT CASE WHEN event_type = 'view' OR value > 30 THEN 'unknown' ELSE event_type END AS category,
           CASE WHEN event_type = 'view' OR value > 30 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n
    FROM events GROUP BY ALL""")
def backfill_defaults_events(spark, sf):
    df = load(spark, sf, "events").select(F.nullif("event_type", F.lit("view")).alias("category"),
                                          F.when(F.col("value") <= 30, "low").alias("severity"))
    out = backfill_defaults(df, {"category": "unknown", "severity": "medium"})
    return out.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


# --- catalog lists ---------------------------------------------------------------

@query("list_datasets", "SELECT event_id, ts AS created_at FROM events ORDER BY ts DESC, event_id LIMIT 5000")
def list_datasets_newest(spark, sf):
    return list_datasets(load(spark, sf, "events").select("event_id", F.col("ts").alias("created_at")), 5000, id="event_id")


@query("search_datasets", """
    SELECT p_partkey::VARCHAR AS dataset, p_name AS name, p_retailprice FROM part
    WHERE contains(lower(p_name), 'red') OR contains(p_partkey::VARCHAR, 'red')""")
def search_parts(spark, sf):
    catalog = load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("dataset"),
                                             F.col("p_name").alias("name"), "p_retailprice")
    return search_datasets(catalog, "RED", "p_retailprice", "asc")


@query("visible_to", """
    SELECT 'admin' AS role, count(*) AS n FROM documents
    UNION ALL SELECT 'editor', count(*) FROM documents WHERE lang = 'en' OR source = 'src3'
    UNION ALL SELECT 'viewer', count(*) FROM documents WHERE lang = 'en'
    UNION ALL SELECT 'nobody', count(*) FROM documents WHERE lang = 'en'""")
def visible_documents(spark, sf):
    df = load(spark, sf, "documents").select(
        F.when(F.col("lang") == "en", "published").otherwise("draft").alias("status"), F.col("source").alias("created_by"))
    parts = [visible_to(df, None if role == "nobody" else "src3", role).agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(role).alias("role"), "n") for role in ("admin", "editor", "viewer", "nobody")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("list_charts", """
    SELECT event_id, total FROM (SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 30 OFFSET 60),
           (SELECT count(*) AS total FROM events WHERE event_type = 'click')""")
def list_charts_page(spark, sf):
    charts = load(spark, sf, "events").select("event_id", F.col("event_type").alias("dataset"), F.col("ts").alias("updated_at"))
    page, total = list_charts(charts, "click", 30, 60, id="event_id")
    return page.select("event_id", total.scalar().alias("total"))


# --- streams -----------------------------------------------------------------------

_FLAGS = """
    SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS window_end,
           count(*) AS events FROM events GROUP BY ALL HAVING count(*) > 3"""


def _plain_windows(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("rate_flags", _FLAGS)
def rate_flags_batch(spark, sf):
    return _plain_windows(rate_flags(load(spark, sf, "events"), "user_id", "1 day", 3))


def _event_stream(spark, sf):
    schema = load(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("stream_rate_flags", _FLAGS)
def stream_rate_flags(spark, sf):
    out = scratch_dir(spark, "rate")
    write_batches(rate_counts(_event_stream(spark, sf), "user_id", window="1 day"), out, "update").awaitTermination()
    return _plain_windows(latest_counts(read_batches(spark, out), "user_id").filter(F.col("events") > 3))


@query("stream_dedupe", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_dedupe_replayed(spark, sf):
    """Every event is delivered twice and kept once."""
    twice = _event_stream(spark, sf).select("event_id", "ts", "user_id", "event_type", "value",
                                            F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")).drop("delivery")
    out = scratch_dir(spark, "dedupe")
    write_batches(stream_dedupe(twice, "event_id"), out).awaitTermination()
    return read_batches(spark, out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_ingest", """
    SELECT count(*) FILTER (NOT (event_type IN ('error', 'purchase') OR user_id < 5)) AS clean,
           round(sum(CASE WHEN NOT (event_type IN ('error', 'purchase') OR user_id < 5) THEN value END), 2) AS price,
           count(*) FILTER (event_type IN ('error', 'purchase') OR user_id < 5) AS quarantined FROM events""")
def stream_ingest_events(spark, sf):
    path, out = scratch_dir(spark, "arriving"), scratch_dir(spark, "ingested")
    raw_events(spark, sf).drop("_row_number", "_source_file").write.option("header", "true").csv(path)
    stream_ingest(spark, path, out, EVENT_SCHEMA).awaitTermination()
    clean, bad = read_ingested(spark, out)
    done = clean.agg(F.count(F.lit(1)).alias("clean"), F.sum("price").alias("price"))
    return rounded(done).withColumn("quarantined", bad.agg(F.count(F.lit(1)).alias("n")).scalar())
