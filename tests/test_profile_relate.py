import pytest

from tallyframe.operators.columns import ColumnMeta
from tallyframe.operators.profile import (
    classify_role, dominant_type, infer_constraints, infer_schema, infer_types, profile, value_type,
)
from tallyframe.operators.relate import (
    add_relationship, column_masks, detect_relationships, merge_edges, overlaps, remove_relationship, types_compatible,
)


def test_value_types(values):
    texts = ["true", "0", "12", "-1.5e3", ".5", "2024-01-15", "Jan 5, 2024", "13/14/2024", "2024", "abc", "a-b", "", None, " 7 "]
    assert values(texts, value_type) == ["boolean", "boolean", "number", "number", "number", "date", "date", "string", "number",
                                         "string", "string", None, None, "number"]


def test_dominant_type():
    assert dominant_type({}) == "empty" and dominant_type({"number": 4, "string": 1}) == "number"
    assert dominant_type({"number": 3, "string": 1}) == "mixed" and dominant_type({"number": 2}) == "number"
    assert dominant_type({"string": 1, "number": 1}) == "mixed"


@pytest.mark.parametrize("args, want", [
    (("order_id", "number", 900, 1000), ("dimension", 0.97, None)), (("region", "string", 5, 10), ("dimension", 0.9, None)),
    (("x", "number", 15, 20), ("dimension", 0.85, None)), (("x", "number", 16, 1000), ("dimension", 0.8, None)),
    (("x", "number", 900, 1000), ("measure", 0.85, "sum")), (("year", "number", 20, 100), ("dimension", 0.78, None)),
    (("tax_rate", "number", 20, 100), ("measure", 0.82, "avg")), (("product type price", "number", 20, 100), ("dimension", 0.75, None)),
    (("foo", "number", 20, 100), ("measure", 0.6, "sum")), (("total", "mixed", 5, 10), ("measure", 0.7, "sum")),
    (("foo", "mixed", 5, 10), ("dimension", 0.7, None)), (("foo", "empty", 0, 0), ("dimension", 0.5, None))])
def test_roles(args, want):
    assert classify_role(*args) == want


def test_constraints():
    assert infer_constraints("Unit Price", "number") == {"min": 0} and infer_constraints("price", "string") == {}
    assert infer_constraints("base_excess", "number") == {} and infer_constraints("order_id", "number") == {}


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([("1", "a", None), ("2", "a", ""), ("x", "b", None), ("2", "2024-01-01", None)], "n string, s string, e string")


def test_exact_and_sketched_profiles_agree(cells):
    a, b = ({r["column"]: r for r in profile(cells, exact).collect()} for exact in (True, False))
    assert a == b
    assert (a["n"]["unique_count"], a["n"]["number_values"], a["n"]["boolean_values"], a["e"]["null_count"]) == (3, 2, 1, 4)


def test_infer_schema(cells):
    n, s, e = infer_schema(cells)
    assert (n.type, n.role, n.sample_values) == ("mixed", "dimension", ("1", "2", "x"))
    assert (s.type, e.type, e.null_count) == ("mixed", "empty", 4)
    assert infer_types(cells) == {"n": "mixed", "s": "mixed", "e": "empty"}


@pytest.fixture(scope="module")
def shop(spark):
    customers = spark.createDataFrame([(i, f"c{i}") for i in range(20)], "customer_id long, country string")
    orders = spark.createDataFrame([(100 + i, i % 20, f"c{i % 3}") for i in range(60)], "order_id long, customer_id long, country string")
    schemas = {"customers": [ColumnMeta("customer_id", "number"), ColumnMeta("country")],
               "orders": [ColumnMeta("order_id", "number"), ColumnMeta("customer_id", "number"), ColumnMeta("country")]}
    return {"customers": customers, "orders": orders}, schemas


def test_overlap(shop):
    frames, _ = shop
    rows = overlaps(frames, [("customers", "customer_id"), ("orders", "customer_id"), ("orders", "order_id")]).collect()
    got = {(r["a"], r["b"]): (r["shared"], r["a_values"], r["b_values"], r["overlap"]) for r in rows}
    assert got == {(0, 1): (20, 20, 20, 1.0), (0, 2): (0, 20, 60, 0.0)}


def test_masks_beyond_one_word(spark):
    wide = spark.createDataFrame([tuple(range(130))], ", ".join(f"c{i} int" for i in range(130)))
    cols = [("a", f"c{i}") for i in range(130)]
    assert column_masks({"a": wide}, cols).columns == ["m0", "m1", "m2", "n"]
    same = overlaps({"a": wide, "b": wide}, [*cols, ("b", "c7"), ("b", "c129")])
    hits = {(r["a"], r["b"]) for r in same.filter("shared > 0").collect()}
    assert hits == {(7, 130), (129, 131)}


def test_detect(spark, shop):
    frames, schemas = shop
    edges = detect_relationships(spark, schemas, frames).collect()
    best = edges[0]
    # FK pattern .5 + same name .4 + overlap .3 + types .05 + PK .1 + FK .05 + values .05, capped at 1
    assert tuple(best)[:5] == ("orders", "customer_id", "customers", "customer_id", 1.0)
    # same name .4 + full overlap .3 + types .05
    assert ("customers", "country", "orders", "country", 0.75, "inferred") in {tuple(e) for e in edges}


def test_detect_from_samples(spark):
    schemas = {"a": [ColumnMeta("country", sample_values=("x", "y"))], "b": [ColumnMeta("Country", sample_values=("z",))]}
    assert [tuple(e) for e in detect_relationships(spark, schemas).collect()] == [("a", "country", "b", "Country", 0.45, "inferred")]
    assert detect_relationships(spark, {"a": [ColumnMeta("x")], "b": [ColumnMeta("y")]}).collect() == []
    ids = {"a": [ColumnMeta("id", "number")], "b": [ColumnMeta("ID", "number")]}
    assert detect_relationships(spark, ids).collect() == []


def test_edges(spark, shop):
    _, schemas = shop
    none = detect_relationships(spark, {})
    one = add_relationship(none, schemas, "orders", "customer_id", "customers", "customer_id")
    assert one.first()["confidence"] == 1.0 and one.first()["source"] == "manual"
    for args, reason in ((("orders", "customer_id", "customers", "customer_id"), "exists"), (("orders", "x", "customers", "country"), "not found"),
                         (("nope", "x", "customers", "country"), "not found")):
        with pytest.raises(ValueError, match=reason):
            add_relationship(one, schemas, *args)
    flipped = one.selectExpr("to_dataset AS from_dataset", "to_column AS from_column", "from_dataset AS to_dataset",
                             "from_column AS to_column", "0.9D AS confidence", "'inferred' AS source")
    assert merge_edges(one, flipped, ["orders", "customers"]).count() == 1
    assert merge_edges(flipped, one, ["orders", "customers"]).first()["source"] == "manual"
    assert remove_relationship(one, "customers", "customer_id", "orders", "customer_id").count() == 0
    assert types_compatible("number", "text") and types_compatible("", "date") and not types_compatible("date", "number")
