import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyframe.operators.columns import (
    ColumnMeta, classify_columns, columns_from_json, columns_to_json, deserialize_schema, format_schema, override_column,
    resolved_kind, schema_fingerprint, schemas_equal, serialize_schema, to_json_schema,
)
from tallyframe.operators.profile import reclean
from tallyframe.operators.validate import (
    annotate, check_foreign_key, check_unique, clean_and_split, clean_for_restore, payload_report, payload_summary,
    validate_by_name, validate_payload,
)

SCHEMA = [ColumnMeta("price", "number"), ColumnMeta("item_count", "integer", nullable=True), ColumnMeta("name", "string"),
          ColumnMeta("active", "boolean", nullable=True), ColumnMeta("day", "date", nullable=True)]


def frame(spark, rows, names=("price", "item_count", "name", "active", "day")):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def errors_of(spark, row, schema=SCHEMA, **kw):
    names = [c.name for c in schema]
    out = annotate(frame(spark, [row], names), schema, **kw).first()
    assert out["_valid"] == (not out["_errors"])
    return [(e["field"], e["error_type"]) for e in out["_errors"]]


@pytest.mark.parametrize("row, want", [
    (("1.5", "2", "x", "yes", "2024-01-01"), []),
    (("-1", "2", "x", "no", None), [("price", "constraint_violation")]),
    (("1", "2.5", "x", None, None), [("item_count", "invalid_format")]),
    (("1", "-2", "x", None, None), [("item_count", "constraint_violation")]),
    ((None, "2", "x", None, None), [("price", "missing_required_value")]),
    (("abc", "2", None, None, None), [("price", "missing_required_value"), ("name", "missing_required_value")]),
    ((None, None, None, None, None), [(None, "unusable_row")]),
    (("?", "", '""', "maybe", "never"), [(None, "unusable_row")]),
])
def test_row_rules(spark, row, want):
    assert errors_of(spark, row) == want


def test_warnings_keep_the_row(spark):
    out = annotate(frame(spark, [("1", "many", "x", "maybe", "31/02/2024")]), SCHEMA).first()
    assert out["_errors"] == [] and out["_raw"] is None
    assert [w.split(":")[0] for w in out["_warnings"]] == ["item_count", "active", "day"]


def test_types_and_names_disagree(spark):
    schema = [ColumnMeta("unit_price", "string"), ColumnMeta("count", "boolean", nullable=True), ColumnMeta("is_new", "string")]
    assert errors_of(spark, ("cheap", "yes", "perhaps"), schema) == [("unit_price", "type_mismatch"), ("count", "type_mismatch")]
    assert ("is_new", "invalid_format") in errors_of(spark, ("cheap", None, "perhaps"), schema, boolean_names=True)


def test_limits_and_enum(spark):
    schema = [ColumnMeta("score", "number", constraints={"min": -5, "max": 5}), ColumnMeta("grade", "string", constraints={"enum": ["A", "B"]})]
    assert errors_of(spark, ("-4", "a"), schema) == []
    assert errors_of(spark, ("7", "c"), schema) == [("score", "constraint_violation"), ("grade", "constraint_violation")]


def test_repair_mode(spark):
    assert errors_of(spark, ("12 EUR", "3", " keep Case ", "1", None), mode="repair") == []
    assert errors_of(spark, ("free", "3", "x", "maybe", None), mode="repair") == [("price", "type_mismatch"), ("active", "invalid_format")]
    out = annotate(frame(spark, [("12 EUR", "3", " keep Case ", "1", None)]), SCHEMA, mode="repair").first()
    assert (out["price"], out["item_count"], out["name"], out["active"]) == (12.0, 3, "keep Case", True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*(st.one_of(st.none(), st.sampled_from(["", "1", "-1", "2.5", "x", "yes", "2024-01-01", "31/02/2024"])) for _ in range(5))),
                min_size=1, max_size=20))
def test_split_is_a_partition(spark, rows):
    numbered = frame(spark, [(str(i), *r) for i, r in enumerate(rows)], ("_row_number", "price", "item_count", "name", "active", "day"))
    numbered = numbered.withColumn("_row_number", F.col("_row_number").cast("long"))
    clean, bad = clean_and_split(numbered, SCHEMA, "d")
    a, b = [r["_row_number"] for r in clean.collect()], [r["row_number"] for r in bad.collect()]
    assert sorted(a + b) == list(range(len(rows)))


def test_quarantine_record(spark):
    _, bad = clean_and_split(frame(spark, [("-1", None, "x", None, None)]), SCHEMA, "d")
    r = bad.first()
    assert (r["dataset"], r["category"], r["severity"], r["status"], r["history"]) == ("d", "validation", "medium", "QUARANTINED", [])
    assert r["raw"]["price"] == "-1" and r["errors"][0]["value"] == "-1.0"


def test_by_name(spark):
    df = frame(spark, [("x", "maybe", "t"), ("12 kg", "Yes", None), (None, None, None)], ("item_id", "is_active", "note"))
    out = [[(e["field"], e["error_type"]) for e in r["errors"]] for r in validate_by_name(df).collect()]
    assert out == [[("item_id", "type_mismatch"), ("is_active", "invalid_format")], [], [(None, "unusable_row")]]


def test_clean_for_restore_without_schema(spark):
    df = frame(spark, [(" 12 kg", "01/02/2024", "hELLO", "soon")], ("price", "ship_date", "note", "start_time"))
    assert tuple(clean_for_restore(df).first()) == ("12.0", "2024-02-01T00:00:00.000Z", "Hello", "soon")


def test_payload(spark):
    schema = [ColumnMeta("n", "integer", constraints={"min": 1}), ColumnMeta("s", "string", nullable=True, constraints={"pattern": "^a", "minLength": 2}),
              ColumnMeta("must", "string")]
    df = spark.createDataFrame([(1, 1.0, "ab", None), (2, 0.5, "b", 1), (3, None, None, None)], "id int, n double, s string, extra int")
    checked = validate_payload(df.drop("id").withColumn("must", F.lit("x")), schema)
    kinds = [[e["error_type"] for e in r["errors"]] for r in checked.collect()]
    assert kinds == [[], ["type", "minimum", "pattern", "minLength", "additionalProperties"], ["required"]]
    assert tuple(payload_summary(checked).first()) == (3, 1, 2, False)
    assert payload_report(checked, "n").count() == 2
    assert [e["field"] for e in validate_payload(df.select("n"), schema).first()["errors"]] == ["must"]


def test_unique_and_foreign_keys(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int")
    stored = spark.createDataFrame([(3,), (9,)], "k int")
    assert sorted(r["k"] for r in check_unique(rows, stored, "k").collect()) == [1, 1, 3]
    assert sorted(r["k"] for r in check_unique(rows, stored, "k", within=False).collect()) == [3]
    assert sorted(r["k"] for r in check_foreign_key(rows, stored, "k", "k").collect()) == [1, 1, 2]


def test_mixed_columns():
    assert resolved_kind(ColumnMeta("x", "mixed", role="measure")) == "number"
    assert resolved_kind(ColumnMeta("x", "mixed", sample_values=("1", "2", "x"))) == "number"
    assert resolved_kind(ColumnMeta("x", "mixed", sample_values=("yes", "no", "x"))) == "boolean"
    assert resolved_kind(ColumnMeta("x", "mixed", sample_values=("1", "x"))) == "string"


def test_schema_forms(spark):
    sales = [ColumnMeta("Region", "string"), ColumnMeta("Revenue", "number"), ColumnMeta("Date", "date", nullable=True), ColumnMeta("IsActive", "boolean")]
    assert classify_columns(sales) == {"Region": "dimension", "Revenue": "measure", "Date": "dimension", "IsActive": "dimension"}
    text = serialize_schema(sales)
    assert text == "Region:string;Revenue:number;Date:date;IsActive:boolean"
    assert schemas_equal(deserialize_schema(text), sales) and len(schema_fingerprint(sales)) == 64
    assert deserialize_schema(" a : ;; b:number") == [ColumnMeta("a", "string"), ColumnMeta("b", "number")]
    assert columns_from_json(columns_to_json(sales)) == sales
    assert format_schema(sales).splitlines()[1:3] == ["  Region: string (required)", "  Revenue: number (required)"]
    assert to_json_schema(sales)["properties"]["Date"] == {"type": ["string", "null"], "format": "date-time"}
    strict = to_json_schema([ColumnMeta("n", "integer", constraints={"min": 1})], strict=True)
    assert strict["properties"]["n"] == {"type": "integer", "minimum": 1} and strict["additionalProperties"] is False
    changed = override_column(sales, "Region", type="number", role="measure")
    assert (changed[0].type, changed[0].role) == ("number", "measure")
    with pytest.raises(ValueError):
        override_column(sales, "Nope", type="number")
    df = spark.createDataFrame([("12", 1.0)], "Region string, Revenue double")
    assert tuple(reclean(df, changed).first()) == (12.0, 1.0)
