"""Files of one load or stream whose headers differ, and frames without row numbers."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyframe.operators.columns import ColumnMeta
from tallyframe.operators.validate import ROW_NUMBER
from tallyframe.sources.csv import HeaderDiffers, read_csv_raw
from tallyframe.sources.store import Store
from tallyframe.streaming.ingest import read_ingested, stream_ingest


def files(folder, *texts):
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"{i}.csv").write_text(text)
    return str(folder)


@pytest.mark.parametrize("first, second", [("sku ,price", "price,sku "), (" sku,price", "price,sku"), (",price", "price,")])
def test_swapped_columns_are_refused(spark, tmp_path, first, second):
    path = files(tmp_path / "in", f"{first}\nA,1\n", f"{second}\n2,B\n")
    with pytest.raises((HeaderDiffers, PySparkException, Py4JJavaError), match="[Hh]eader|columns"):
        read_csv_raw(spark, path).collect()


@pytest.mark.parametrize("first, second, names", [("sku ,price", "sku, price", ["sku", "price"]), (",price", " ,price ", ["column_1", "price"])])
def test_names_equal_but_for_white_space_fit(spark, tmp_path, first, second, names):
    path = files(tmp_path / "in", f"{first}\nA,1\n", f"{second}\nB,2\n")
    rows = read_csv_raw(spark, path).select(*names).collect()
    assert sorted(map(tuple, rows)) == [("A", "1"), ("B", "2")]


def test_stream_refuses_swapped_columns(spark, tmp_path):
    schema = [ColumnMeta("column_1", "string", nullable=True), ColumnMeta("price", "number", nullable=True)]
    good = files(tmp_path / "good", "column_1,price\nA,1\n", ",price\nB,2\n")
    stream_ingest(spark, good, str(tmp_path / "out"), schema).awaitTermination()
    clean, _ = read_ingested(spark, str(tmp_path / "out"))
    assert sorted((r.column_1, r.price) for r in clean.collect()) == [("A", 1.0), ("B", 2.0)]
    bad = files(tmp_path / "bad", "price,column_1\n1,A\n")
    with pytest.raises(PySparkException):
        stream_ingest(spark, bad, str(tmp_path / "out2"), schema).awaitTermination()


def test_frames_without_numbers_get_them(spark, tmp_path):
    store, schema = Store(spark, str(tmp_path / "s")), [ColumnMeta("a", "number"), ColumnMeta("b", "string")]
    raw = spark.createDataFrame([("1", "x"), ("bad", "y"), ("3", "z")], "a string, b string").repartition(3)
    store.write_dataset("d", raw, schema)
    store.write_dataset("d", raw, mode="append")
    numbers = [r[0] for r in store.records("d").select(ROW_NUMBER).collect()]
    assert None not in numbers and len(set(numbers)) == 6
    assert store.load_quarantine("d").where(F.col("row_number").isNull()).count() == 0
