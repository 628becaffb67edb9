import pytest

from tallyframe.operators.columns import ColumnMeta
from tallyframe.operators.export import (
    export_csv, export_dataset, export_fields, export_histogram, export_log, flatten, histogram_table, spec_from_export,
    sweep_stale, union_records, validate_export,
)


def test_flatten(spark):
    df = spark.createDataFrame([(1, ((2, [1, 2]), "x"), {"a": 1})], "id int, s struct<t:struct<u:int,v:array<int>>,w:string>, m map<string,int>")
    out = flatten(df)
    assert out.columns == ["id", "s.t.u", "s.t.v", "s.w", "m"] and tuple(out.first()) == (1, 2, "[1,2]", "x", '{"a":1}')


def test_fields(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "x int, y int")
    assert export_fields([a, b]) == ["x", "y"] and export_fields([a], [ColumnMeta("q")]) == ["q"]
    assert sorted(map(tuple, union_records([a, b]).collect()), key=str) == [(1, None), (2, 3)]


def read(folder):
    return "".join(sorted(p.read_text() for p in folder.glob("part-*.csv")))


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("a,b", None, 'q"q'), ("c", 1, "")], "k string, n int, t string")
    export_csv(df, str(tmp_path / "e"), single_file=True)
    assert read(tmp_path / "e") == 'k,n,t\n"a,b",,"q""q"\nc,1,\n'
    context = {"query": {"dimensions": ["k"], "measures": [{"field": "n", "label": "N"}], "filters": []},
               "dashboardFilters": {"k": "c"}}
    export_csv(df, str(tmp_path / "q"), context)
    assert read(tmp_path / "q") == "k,N\nc,1.0\n"  # whole numbers are summed as doubles
    export_dataset(df.coalesce(1), str(tmp_path / "d"), [ColumnMeta("n"), ColumnMeta("gone"), ColumnMeta("k")])
    assert read(tmp_path / "d").splitlines()[0] == "n,gone,k"
    export_dataset(df, str(tmp_path / "p"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        export_dataset(df, str(tmp_path / "x"), fmt="xlsx")


def test_histogram_files(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 12.0), (3.0, None)], "a double, b double")
    out = histogram_table(df, {"measures": [{"field": "a", "label": "A"}, "b"], "binSize": 10})
    assert [tuple(r) for r in out.collect()] == [("0 - 10", 0.0, 10.0, 2, 0), ("10 - 20", 10.0, 20.0, 0, 1)]
    export_histogram(df, str(tmp_path / "h"), ["a"], 0)
    assert "Bin,Start,End,a Count" in read(tmp_path / "h")


def test_spec_from_export():
    legacy = spec_from_export({"selectedDimensions": ["a"], "selectedMeasures": ["b"], "filters": {"c": 1},
                               "dashboardFilters": [{"field": "d", "operator": ">", "value": 2}], "rowLimit": 10**6})
    assert spec_from_export({"selectedDimensions": ["a"]}).limit is None
    assert [d.field for d in legacy.dimensions] == ["a"] and legacy.measures[0].output == "b"
    assert [f.field for f in legacy.filters] == ["c", "d"] and legacy.limit == 10**6
    assert spec_from_export({"query": {"rowLimit": "20"}}).limit == 20


CONTEXT = {"query": {"dimensions": [], "measures": []}}


@pytest.mark.parametrize("request_", [
    None, {"datasetId": "d", "format": "pdf", "context": CONTEXT}, {"format": "csv", "context": CONTEXT}, {"datasetId": "d", "format": "csv"},
    {"datasetId": "d", "format": "csv", "context": {}}, {"datasetId": "d", "format": "csv", "context": {"query": {"filters": {}}}},
    {"datasetId": "d", "format": "csv", "context": {"selectedDimensions": []}},
    {"datasetId": "d", "format": "csv", "context": {"selectedDimensions": ["a"], "selectedMeasures": "b"}},
    {"datasetId": "d", "format": "csv", "context": CONTEXT | {"dashboardFilters": 1}}])
def test_invalid_requests(request_):
    with pytest.raises(ValueError):
        validate_export(request_)


def test_valid_requests():
    assert validate_export({"datasetId": "d", "format": "Excel", "context": CONTEXT})
    assert validate_export({"datasetId": "d", "format": "csv", "context": {"selectedMeasures": ["a"], "dashboardFilters": {}}})


def test_log(spark):
    log = spark.createDataFrame([("d", 1, "processing"), ("d", 2, "completed"), ("e", 3, "processing")], "dataset string, exported_at int, status string")
    assert [r["exported_at"] for r in export_log(log, "d").collect()] == [2, 1]
    assert [(r["status"], r["failure_reason"] is not None) for r in sweep_stale(log).collect()] == [("failed", True), ("completed", False), ("failed", True)]
