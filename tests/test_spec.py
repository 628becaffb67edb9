import pytest

from tallyframe.plans.spec import Filter, QuerySpec, merge_filters, normalize_filters


def test_dimensions_and_measures_are_normalised():
    spec = QuerySpec.from_dict({
        "dimensions": [" a ", {"field": "b", "timeBucket": "day"}, {"field": " "}, None, 3],
        "measures": ["x", {"field": "y", "aggregation": "avg", "label": "Y"}, {"field": "*"}, {"aggregation": "SUM"}],
    })
    assert [(d.field, d.time_bucket, d.timezone) for d in spec.dimensions] == [("a", None, "UTC"), ("b", "day", "UTC")]
    assert [(m.field, m.aggregation, m.output) for m in spec.measures] == [
        ("x", "SUM", "x"), ("y", "AVG", "Y"), ("*", "SUM", "COUNT(*)")]


def test_filters_in_all_forms():
    assert normalize_filters([{"field": " a ", "operator": "=", "value": 1}, {"field": "b"}, "x"]) == (Filter("a", "=", 1),)
    assert normalize_filters({"a": 1, "b": [1, 2], "id": {"field": "c", "operator": ">", "value": 3},
                              "d": {"operator": "<", "value": 4}, " ": 5}) == (
        Filter("a", "=", 1), Filter("b", "IN", [1, 2]), Filter("c", ">", 3), Filter("d", "<", 4))
    assert normalize_filters(None) == ()
    assert merge_filters([{"field": "a", "operator": "=", "value": 1}], {"b": 2}) == (Filter("a", "=", 1), Filter("b", "=", 2))


@pytest.mark.parametrize("rows, series, limit", [
    (None, None, None), (0, None, None), ("25", None, 25), ("30 rows", None, 30), (-5, None, 1),
    (10**9, None, 10**9), (10, 7, 7), (10, "0", 10), (10, -3, 10), ("x", None, None)])
def test_limits(rows, series, limit):
    assert QuerySpec.from_dict({"rowLimit": rows, "seriesLimit": series}).limit == limit


def test_sort_by_wins_over_order_by():
    spec = QuerySpec.from_dict({"sortBy": [{"field": "a", "direction": "DESC"}], "orderBy": [{"field": "b"}]})
    assert [(s.field, s.descending) for s in spec.sorts] == [("a", True)]
    assert [s.field for s in QuerySpec.from_dict({"orderBy": [{"field": "b"}, {"direction": "asc"}]}).sorts] == ["b"]
