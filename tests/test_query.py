import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from tallyframe.functions.timebucket import time_bucket
from tallyframe.plans.predicates import NO_VALUE, apply_filters, coerce_value, to_number
from tallyframe.plans.query import QueryResult, explain_spec, export_columns, preview, run_query
from tallyframe.plans.spec import normalize_filters

ROWS = [(1, "a", 10.0, True, dt.datetime(2024, 1, 6, 23)), (2, "b", None, False, dt.datetime(2024, 1, 7, 1)),
        (3, None, 5.5, None, None), (4, "a", -2.0, True, dt.datetime(2024, 2, 1))]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, kind string, amount double, flag boolean, ts timestamp_ntz")


@pytest.mark.parametrize("f, ids", [
    (["kind", "=", " a "], [1, 4]), (["kind", "!=", "a"], [2, 3]), (["kind", "=", None], [3]), (["kind", "!=", None], [1, 2, 4]),
    (["KIND", "==", "b"], [2]), (["amount", ">", "5"], [1, 3]), (["amount", "!=", "10"], [2, 3, 4]), (["amount", "=", "abc"], []),
    (["amount", "!=", "abc"], [1, 2, 3, 4]), (["id", ">", 2.5], [3, 4]), (["id", "<=", "2.5"], [1, 2]), (["id", "=", 1.5], []),
    (["id", "IN", "1, 3,"], [1, 3]), (["id", "NOT IN", [1, 2]], [3, 4]), (["kind", "NOT IN", ["a"]], [2, 3]),
    (["kind", "IN", [None, "b"]], [2, 3]), (["kind", "NOT IN", [None, "b"]], [1, 4]), (["id", "IN", []], [1, 2, 3, 4]),
    (["flag", "=", "TRUE"], [1, 4]), (["flag", "!=", True], [2, 3]), (["flag", "=", "yes"], []),
    (["ts", ">=", "2024-01-07"], [2, 4]), (["ts", "<", "2024-01-07T00:00:00Z"], [1]), (["ts", "=", "2024-02-01"], [4]),
    (["amount", ">=", None], [2]), (["amount", ">", None], []), (["kind", ">", "10"], []), (["kind", ">=", "b"], [2]),
    (["nothing", "=", "x"], []), (["nothing", "!=", "x"], [1, 2, 3, 4]), (["amount", "=", ""], []),
])
def test_filter(df, f, ids):
    spec = normalize_filters([dict(zip(("field", "operator", "value"), f))])
    assert sorted(r["id"] for r in apply_filters(df, spec).collect()) == ids


def test_unknown_operator_is_ignored_with_a_warning(df):
    with pytest.warns(UserWarning, match="LIKE"):
        assert apply_filters(df, normalize_filters([{"field": "kind", "operator": "LIKE", "value": "a"}])).count() == 4


def test_strict_rejects_unknown_columns(df):
    with pytest.raises(ValueError, match="unknown column"):
        run_query(df, {"dimensions": ["nothing"]}, strict=True)


def test_nested_field(spark):
    nested = spark.createDataFrame([((1,), "x"), ((2,), "y")], "s struct<a:int>, k string")
    assert run_query(nested, {"dimensions": ["k"], "filters": {"s.a": 2}}).collect()[0]["k"] == "y"


def test_coercion():
    assert to_number("0x10") == 16 and to_number("") == 0 and to_number("1e3") == 1000.0 and to_number("x") is None
    assert coerce_value("5", T.StringType(), ">") is NO_VALUE
    assert coerce_value("true", T.BooleanType()) is True
    assert coerce_value("03/04/2024", T.TimestampType()) == dt.datetime(2024, 3, 4)
    assert coerce_value(0, T.TimestampType()) == dt.datetime(1970, 1, 1)


def test_filters_are_pushed_into_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = explain_spec(orders, {"dimensions": ["o_orderstatus"], "measures": ["o_totalprice"], "filters": [
        {"field": "o_custkey", "operator": ">", "value": "7.5"}, {"field": "o_orderpriority", "operator": "!=", "value": "x"}], "rowLimit": 10_000})
    assert "GreaterThanOrEqual(o_custkey,8)" in plan
    assert "o_orderdate" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert "TakeOrderedAndProject" in plan


def test_group_totals(df):
    out = run_query(df, {"dimensions": ["kind"], "measures": [
        "amount", {"field": "amount", "aggregation": "AVG", "label": "mean"}, {"field": "kind", "label": "text"},
        {"field": "flag", "aggregation": "odd", "label": "flags"}, {"field": "*"}]}).collect()
    assert [tuple(r) for r in out] == [(None, 5.5, 5.5, 0.0, 0.0, 1), ("a", 8.0, 4.0, 0.0, 0.0, 2), ("b", 0.0, None, 0.0, 0.0, 1)]


def test_empty_forms(df):
    assert run_query(df, {}).collect()[0]["count"] == 4
    assert run_query(df.filter("id > 9"), {"measures": ["amount"]}).collect() == []
    assert {r["kind"] for r in run_query(df, {"dimensions": ["kind"]}).collect()} == {None, "a", "b"}
    raw = run_query(df, {"raw": True, "dimensions": ["kind"], "measures": ["amount", {"field": "*"}], "rowLimit": 2})
    assert raw.columns == ["kind", "amount"] and raw.count() == 2


def test_sort_nulls_and_ties(df):
    spec = {"dimensions": ["kind"], "measures": [{"field": "amount", "aggregation": "AVG"}]}
    asc = run_query(df, spec | {"orderBy": [{"field": "amount"}]}).collect()
    desc = run_query(df, spec | {"orderBy": [{"field": "amount", "direction": "desc"}]}).collect()
    assert [r["kind"] for r in asc] == ["b", "a", None] and [r["kind"] for r in desc] == [None, "a", "b"]


def test_contribution(df):
    spec = {"dimensions": ["id"], "measures": [{"field": "amount", "label": "p"}, {"field": "kind", "label": "zero"}],
            "contributionMode": "row", "filters": [{"field": "amount", "operator": ">", "value": 0}]}
    assert [tuple(r) for r in run_query(df, spec).collect()] == [(1, 64.52, 0.0), (3, 35.48, 0.0)]


def test_time_buckets(spark, df):
    got = {u: [r[0] for r in df.filter("id < 3").orderBy("id").select(time_bucket(F.col("ts"), u, dtype=T.TimestampNTZType())).collect()]
           for u in ("week", "quarter", "hour")}
    assert got["week"] == [dt.datetime(2023, 12, 31), dt.datetime(2024, 1, 7)]
    assert got["quarter"] == [dt.datetime(2024, 1, 1)] * 2
    assert got["hour"] == [dt.datetime(2024, 1, 6, 23), dt.datetime(2024, 1, 7, 1)]
    berlin = df.filter("id = 1").select(time_bucket(F.col("ts"), "day", "Europe/Berlin", T.TimestampNTZType())).first()[0]
    assert berlin == dt.datetime(2024, 1, 6, 23)
    with pytest.raises(ValueError, match="time bucket"):
        time_bucket(F.col("ts"), "decade")


def test_result_and_helpers(df):
    result = QueryResult.run(df, {"dimensions": ["kind"], "measures": [{"field": "*"}]})
    assert result.row_count == 3 and result.rows[1] == {"kind": "a", "COUNT(*)": 2} and result.execution_time_ms >= 0
    spec = {"dimensions": ["kind"], "measures": ["amount", {"field": "*"}]}
    assert export_columns(spec) == ["kind", "amount", "COUNT(*)"]
    assert export_columns(spec | {"raw": True}) == ["kind", "amount"]
    assert export_columns({}, df) == df.columns
    page = preview(df.withColumnRenamed("id", "_row_number"), 2, 1).collect()
    assert [r["_row_number"] for r in page] == [2, 3]
