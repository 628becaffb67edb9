import os

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.catalog import list_charts, list_datasets, search_datasets, visible_to
from tallyframe.operators.columns import ColumnMeta
from tallyframe.operators.dedupe import backfill_defaults, dedupe_keep_first, find_duplicates, insert_idempotent
from tallyframe.operators.profile import infer_schema
from tallyframe.operators.quarantine import discard_into, restore_into
from tallyframe.operators.validate import split_structural
from tallyframe.session import scratch_dir
from tallyframe.sources import csv as csv_source
from tallyframe.sources.csv import (
    compare_append_columns, normalize_headers, peek, read_csv_raw, sample_rows, unique_row_id, validate_headers,
)
from tallyframe.sources.store import AppendRefused, Store
from tallyframe.streaming.events import rate_counts, rate_flags, read_batches, stream_dedupe, write_batches
from tallyframe.streaming.ingest import PROGRESS, IngestProgress, read_ingested, stream_ingest

CSV = '''Name,, Price ,Active
"Bo ""B"" Long",x,"$1,200.50",yes
short,1

long,1,2,no,5
 , ,,
neg,y,-3,N
ok,z,1e5,maybe
'''


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    return str(path)


SCHEMA = [ColumnMeta("Name"), ColumnMeta("column_2"), ColumnMeta("Price", "number"), ColumnMeta("Active", "boolean", nullable=True)]


def test_headers():
    assert normalize_headers([" a ", None, ""]) == ["a", "column_2", "column_3"]
    with pytest.raises(ValueError, match="no header"):
        validate_headers([])
    with pytest.raises(ValueError, match="twice"):
        validate_headers(["a", "A"])


def test_read_csv(spark, csv_file):
    df = read_csv_raw(spark, csv_file)
    rows = df.orderBy("_row_number").collect()
    assert df.columns == ["Name", "column_2", "Price", "Active", "_corrupt_record", "_source_file", "_row_number"]
    assert [(r["_row_number"], r["Name"], r["_corrupt_record"] is not None) for r in rows] == [
        (2, 'Bo "B" Long', False), (3, "short", True), (4, "long", True), (6, "neg", False), (7, "ok", False)]
    good, bad = split_structural(df)
    assert len(good.collect()) == 3 and len(bad.collect()) == 2


@pytest.mark.parametrize("few", [500_000, 0])  # offsets broadcast, and joined by shuffle
def test_row_numbers_over_many_splits(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(csv_source, "BROADCAST_SPLITS", few)
    lines = ["k,v"] + [f"{i},{'x' * 200}" for i in range(3000)]
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        df = read_csv_raw(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1
        before = F.when(F.col("_source_file").endswith("b.csv"), 3000).otherwise(0)
        assert df.filter(F.col("_row_number") != before + F.col("k").cast("long") + 2).isEmpty()
        assert df.groupBy("_source_file").count().count() == 2 and df.select("k").collect().__len__() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_restore_from_one_of_many_files(spark, tmp_path):
    """Row numbers are unique over files, so the edited row alone is restored."""
    for name, bad in (("a.csv", "3"), ("b.csv", "-3")):
        (tmp_path / name).write_text(f"sku,price\nx,1\ny,{bad}\n")
    store = Store(spark, str(tmp_path / "store"))
    schema = [ColumnMeta("sku"), ColumnMeta("price", "number")]
    store.write_dataset("d", read_csv_raw(spark, str(tmp_path / "*.csv")), schema)
    number = store.load_quarantine("d").first()["row_number"]
    edits = spark.createDataFrame([(number, {"price": "9"}), (number, {"price": "8"})], "row_number long, data map<string,string>")
    done = restore_into(store, "d", edits)
    assert done == {"restored_count": 1, "failed_count": 0, "row_count": 4, "quarantined_count": 0}
    assert sorted(r["price"] for r in store.load_dataset("d").collect()) == [1.0, 1.0, 3.0, 9.0]


def test_files_must_share_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sku,price\nx,1\n")
    (tmp_path / "b.csv").write_text("price,sku\n1,x\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_raw(spark, str(tmp_path)).collect()


def test_appends_are_compared_and_repeatable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    schema = [ColumnMeta("sku"), ColumnMeta("price", "number")]
    one = spark.createDataFrame([("x", "1", 2)], "sku string, price string, _row_number long")
    store.write_dataset("d", one, schema)
    with pytest.raises(AppendRefused) as refused:
        store.write_dataset("d", one.withColumnRenamed("price", "colour"), mode="append")
    assert refused.value.comparison["missing_columns"] == ["price"]
    for _ in range(2):
        report = store.write_dataset("d", one, mode="append", load_id="monday")
        assert (report.rows_seen, report.rows_valid) == (1, 1)
    assert store.load_dataset("d").count() == store.entry("d")["row_count"] == 2
    # A load that died before its catalog entry is not seen, and its repetition takes its place.
    log = store.update_catalog
    store.update_catalog = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.write_dataset("d", one, mode="append", load_id="tuesday")
    store.update_catalog = log
    assert store.load_dataset("d").count() == 2
    store.write_dataset("d", one, mode="append", load_id="tuesday")
    assert sorted(r["_row_number"] for r in store.load_dataset("d").collect()) == [2, 4, 6]
    absent = store.write_dataset("e", one.drop("price"), schema)
    assert absent.rows_valid == 0  # a required column the frame does not have


def test_stored_types_after_an_override(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("x", "1.5", 2), ("y", "7", 3)], "sku string, size string, _row_number long")
    store.write_dataset("d", rows, [ColumnMeta("sku"), ColumnMeta("size", "number")])
    for kind, want in (("string", ["1.5", "7.0"]), ("integer", [1, 7]), ("number", [1.5, 7.0])):
        store.set_columns("d", [ColumnMeta("sku"), ColumnMeta("size", kind)])
        assert sorted(r["size"] for r in store.load_dataset("d").collect()) == want
    store.set_columns("d", [ColumnMeta("sku"), ColumnMeta("size", "string")])
    store.write_dataset("d", rows, mode="append")
    assert store.records("d").count() == 4  # of both loads, whatever their stored types


def test_multiline(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('a,b\n"x\ny",1\nz,2\n')
    assert [r["a"] for r in read_csv_raw(spark, str(path), multiline=True).collect()] == ["x\ny", "z"]


def test_small_sources(spark, csv_file):
    df = read_csv_raw(spark, csv_file, row_numbers=False)
    assert len(peek(df, 2).collect()) == 2 and len(sample_rows(df, 3).collect()) == 3
    assert [r["_row_number"] for r in unique_row_id(spark.range(3).coalesce(1), 10).collect()] == [11, 12, 13]
    fits = compare_append_columns(SCHEMA, ["name", "COLUMN 2", "Price", "Active"])
    assert fits["is_match"]
    assert compare_append_columns(SCHEMA, ["Name", "Extra"]) == {
        "is_match": False, "expected_count": 4, "received_count": 2, "missing_columns": ["column_2", "Price", "Active"], "unexpected_columns": ["Extra"]}


def test_store_life_cycle(spark, csv_file, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    raw = read_csv_raw(spark, csv_file)
    report = store.write_dataset("d", raw, SCHEMA, name="Sales")
    assert (report.rows_seen, report.rows_valid, report.rows_quarantined) == (5, 2, 3)
    clean = {r["_row_number"]: (r["Name"], r["Price"], r["Active"]) for r in store.load_dataset("d").collect()}
    assert clean == {2: ("Bo b long", 1200.5, True), 7: ("Ok", 15.0, None)}
    q = {r["row_number"]: (r["category"], r["errors"][0]["error_type"]) for r in store.load_quarantine("d").collect()}
    assert q == {3: ("structural", "structural_parse_error"), 4: ("structural", "structural_parse_error"), 6: ("validation", "constraint_violation")}
    with pytest.raises(ValueError, match="exists"):
        store.write_dataset("d", raw, SCHEMA)
    with pytest.raises(ValueError, match="does not exist"):
        store.write_dataset("other", raw, mode="append")

    store.write_dataset("d", raw, mode="append")
    entry = store.entry("d")
    assert (entry["row_count"], entry["quarantined_count"], entry["name"]) == (4, 6, "Sales")
    assert sorted(r["_row_number"] for r in store.load_dataset("d").collect()) == [2, 7, 9, 14]

    edits = spark.createDataFrame([(6, {"Price": "3"})], "row_number long, data map<string,string>")
    done = restore_into(store, "d", edits, "me")
    assert done == {"restored_count": 1, "failed_count": 0, "row_count": 5, "quarantined_count": 5}
    again = restore_into(store, "d", edits, "me")  # nothing left to restore
    assert again["restored_count"] == 0 and again["row_count"] == 5
    everything = restore_into(store, "d")
    assert (everything["restored_count"], everything["failed_count"]) == (0, 5)
    assert discard_into(store, "d", [3])["quarantined_count"] == 4
    r = store.load_quarantine("d").filter("row_number = 6").first()
    assert r["status"] == "RESTORED" and [(h["action"], h["user"]) for h in r["history"]] == [("RESTORED", "me")]

    store.set_columns("d", [*SCHEMA[:3], ColumnMeta("Active", "boolean", role="measure", nullable=True)])
    assert store.columns("d")[3].role == "measure" and store.entry("d")["row_count"] == 5
    store.write_dataset("d", raw, SCHEMA, mode="replace")
    assert store.entry("d")["row_count"] == 2 and store.load_quarantine("d").filter("status = 'QUARANTINED'").count() == 3
    assert store.drop_datasets(["d", "nope", "d"]) == {"requested_count": 3, "deleted_count": 1}
    assert store.catalog().count() == 0 and not os.path.exists(tmp_path / "store/data/d")


def test_store_edges(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.edges().count() == 0
    one = spark.createDataFrame([("a", "x", "b", "y", 0.5, "inferred")], store.edges().schema)
    store.save_edges(one)
    assert [tuple(r) for r in store.edges().collect()] == [("a", "x", "b", "y", 0.5, "inferred")]
    store.save_edges(one.limit(0))
    assert store.edges().count() == 0


def test_inferred_schema_of_a_file(spark, csv_file):
    kinds = {c.name: c.type for c in infer_schema(read_csv_raw(spark, csv_file))}
    assert kinds["Name"] == "string" and kinds["Price"] == "mixed"


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, None)], "k string, o int, v string")
    assert [tuple(r) for r in find_duplicates(df, ["k"], "o").collect()] == [("a", 2, 2)]
    assert sorted(tuple(r) for r in dedupe_keep_first(df, ["k"], "o").collect()) == [("a", 1, "x"), ("b", 3, None)]
    plan = dedupe_keep_first(df, ["k"], "o")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # hot keys are cut down before the shuffle
    assert [r["k"] for r in insert_idempotent(df, df.filter("k = 'b'"), ["k"]).collect()] == ["a"]
    filled = backfill_defaults(spark.createDataFrame([(None, "low"), ("x", "low"), ("y", None)], "category string, severity string"),
                               {"category": "unknown", "severity": "medium", "note": "none"}, ["category", "severity"])
    assert [tuple(r) for r in filled.collect()] == [("unknown", "medium", "none"), ("x", "low", None), ("unknown", "medium", "none")]


def test_catalog_lists(spark):
    df = spark.createDataFrame([("d1", "Sales 2024", 1), ("d2", "Stock", 2), ("sales3", None, 3)], "dataset string, name string, created_at int")
    assert [r["dataset"] for r in list_datasets(df, 2).collect()] == ["sales3", "d2"]
    assert [r["dataset"] for r in search_datasets(df, "SALES").collect()] == ["sales3", "d1"]
    assert [r["dataset"] for r in search_datasets(df, "s", "name", "asc").collect()] == ["sales3", "d1", "d2"]
    page, total = list_charts(df.withColumnRenamed("created_at", "updated_at"), None, 1, 1)
    assert page.first()["dataset"] == "d2" and total.first()["total"] == 3
    boards = spark.createDataFrame([("published", "a"), ("draft", "a"), ("draft", "b")], "status string, created_by string")
    assert [visible_to(boards, u, r).count() for u, r in (("a", "admin"), ("a", "editor"), ("a", "viewer"), (None, None))] == [3, 2, 1, 1]


def test_stream_ingest_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    progress = IngestProgress()
    spark.streams.addListener(progress)
    (src / "1.csv").write_text(CSV)
    stream_ingest(spark, str(src), out, SCHEMA).awaitTermination()
    (src / "2.csv").write_text("Name,,Price,Active\nlate,q,7,no\n")
    q = stream_ingest(spark, str(src), out, SCHEMA)
    q.awaitTermination()
    clean, bad = read_ingested(spark, out, "d")
    numbers = [r["_row_number"] for r in clean.collect()] + [r["row_number"] for r in bad.collect()]
    assert len(set(numbers)) == len(numbers) == 6
    assert sorted(r["Name"] for r in clean.collect()) == ["Bo b long", "Late", "Ok"] and bad.count() == 3
    seen = [p["observedMetrics"].get(PROGRESS) for p in q.recentProgress]
    assert sum(m["seen"] for m in seen if m) == 1
    spark.streams.removeListener(progress)
    assert progress.rows_seen >= progress.rows_valid


def test_stream_dedupe_and_rates(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = spark.sql("SELECT id % 5 AS k, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts FROM range(100)")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    write_batches(stream_dedupe(stream, "k"), str(tmp_path / "d")).awaitTermination()
    assert sorted(r["k"] for r in read_batches(spark, str(tmp_path / "d")).collect()) == [0, 1, 2, 3, 4]
    write_batches(rate_counts(stream, "k"), str(tmp_path / "r"), "update").awaitTermination()
    streamed = {tuple(r) for r in read_batches(spark, str(tmp_path / "r")).collect()}
    assert streamed == {tuple(r) for r in rate_counts(rows, "k").collect()}
    assert rate_flags(rows, "k", max_events=11).count() == 5 and rate_flags(rows, "k", max_events=12).count() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "late")
    def batch(day, n):
        spark.sql(f"SELECT 1 AS k, timestamp'2024-01-{day:02d}' AS ts FROM range({n})").coalesce(1).write.mode("append").parquet(src)
    schema = "k int, ts timestamp"
    for day, n in ((1, 1), (10, 1), (2, 5)):  # the last batch is eight days late
        batch(day, n)
        q = write_batches(rate_counts(spark.readStream.schema(schema).parquet(src), "k"), str(tmp_path / "o"), "update")
        q.awaitTermination()
    days = sorted(r["window_start"].day for r in read_batches(spark, str(tmp_path / "o")).collect())
    assert days == [1, 10]


def test_scratch_folder_follows_the_session(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
