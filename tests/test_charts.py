import random

import numpy as np
import pytest

from tallyframe.operators import charts
from tallyframe.operators.charts import boxplot, category_series, histogram, scatter, series_by_x
from tallyframe.operators.columns import ColumnMeta
from tallyframe.plans.charts import (
    ChartError, chart_to_stored, filters_of, run_chart, run_dashboard, spec_for_chart, stored_to_chart, validate_chart,
)

SALES = [ColumnMeta("Region", "string"), ColumnMeta("Revenue", "number"), ColumnMeta("Date", "date"), ColumnMeta("IsActive", "boolean")]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 30.0), (9.99, None), (20.0, float("nan")), (-0.5, 11.0)], "a double, b double")
    got = {(r["measure"], r["bin"]): (r["bin_start"], r["bin_end"], r["count"]) for r in histogram(df, ["a", "b"]).collect()}
    assert got == {("a", 0): (-10.0, 0.0, 1), ("a", 1): (0.0, 10.0, 2), ("a", 2): (10.0, 20.0, 0), ("a", 3): (20.0, 30.0, 1),
                   ("b", 0): (-10.0, 0.0, 0), ("b", 1): (0.0, 10.0, 0), ("b", 2): (10.0, 20.0, 1), ("b", 3): (20.0, 30.0, 1)}


def test_histogram_special_cases(spark):
    one = spark.createDataFrame([(20.0,), (20.0,)], "a double")
    assert [tuple(r) for r in histogram(one, ["a"]).collect()] == [("a", 0, 20.0, 30.0, 2)]
    assert histogram(one.filter("a < 0"), ["a"]).collect() == []
    assert histogram(one, {"x": "a"}, 0.25).first()["bin_end"] == 21.0  # widths below one count as one
    assert histogram(one, ["a"], 0.25, min_bin_size=None).first()["bin_end"] == 20.25
    wide = spark.createDataFrame([(0.0,), (250_000.0,)], "a double")
    out = histogram(wide, ["a"])
    assert out.count() == 25_000 and out.groupBy().sum("count").first()[0] == 2


@pytest.mark.parametrize("buckets", [1024, 40])
def test_boxplot_is_exact_on_every_path(spark, monkeypatch, buckets):
    """Few buckets force many passes."""
    monkeypatch.setattr(charts, "_BUCKETS", buckets)
    rng = random.Random(5)
    skewed = [7.0] * 400 + [rng.uniform(-1, 50) for _ in range(601)]  # one value holds a third
    rows = [(x, rng.gauss(0, 1), None if i % 3 else float(i)) for i, x in enumerate(skewed)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    got = {r["measure"]: [r[k] for k in charts.BOX] for r in boxplot(df, {"A": "a", "b": "b", "c": "c"}).collect()}
    for name, values in (("A", [r[0] for r in rows]), ("b", [r[1] for r in rows]), ("c", [r[2] for r in rows if r[2] is not None])):
        assert got[name] == pytest.approx(np.percentile(values, [0, 25, 50, 75, 100]))


def test_boxplot_selects_over_the_whole_range_of_doubles(spark):
    rng = random.Random(9)
    wide = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 1.7e308, -1.7e308] + [rng.choice((-1, 1)) * 2.0 ** rng.uniform(-1070, 1020) for _ in range(301)]
    close = [1.0 + k * 2.0 ** -52 for k in range(200)] * 2 + [1e300] * 109 + [-1e-300] * 20
    tiny = [5e-324 * (k % 7) for k in range(1001)]
    frames = {"wide": wide, "close": close, "below": [-abs(x) for x in wide], "tiny": tiny, "one": [3.5]}
    rows = [tuple(v[k] if k < len(v) else None for v in frames.values()) for k in range(max(map(len, frames.values())))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in frames)).repartition(4)
    got = {r["measure"]: r for r in boxplot(df, list(frames)).collect()}
    for name, values in frames.items():
        v = sorted(values)
        for p, key in zip((0.25, 0.5, 0.75), ("q1", "median", "q3")):
            at = (len(v) - 1) * p
            k, part = int(at), at - int(at)
            assert got[name][key] == (v[k] + part * (v[k + 1] - v[k]) if part else v[k]), (name, key)
        assert (got[name]["n"], got[name]["min"], got[name]["max"]) == (len(v), v[0], v[-1])


def test_boxplot_small_inputs(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert [tuple(r) for r in boxplot(df, ["a", "b"]).collect()] == [("a", 2, 1.0, 1.25, 1.5, 1.75, 2.0)]
    assert boxplot(df, ["b"]).collect() == []
    assert tuple(boxplot(df, ["a"], exact=False).first())[:3] == ("a", 2, 1.0)


def test_points_and_series(spark):
    df = spark.createDataFrame([("1", 2.0, 5), ("1", 4.0, 6), ("x", 1.0, 7), ("0", None, 8)], "x string, y double, z int")
    assert [tuple(r) for r in scatter(df, "x", "y").collect()] == [(1.0, 2.0), (1.0, 4.0)]
    assert [tuple(r) for r in series_by_x(df, "x", [("y", None), ("z", "COUNT")]).collect()] == [
        ("y", 1.0, 3.0), ("z", 0.0, 1.0), ("z", 1.0, 2.0)]
    assert [tuple(r) for r in category_series(df, "x", "z", "SUM", top=1).collect()] == [("1", 11)]


@pytest.mark.parametrize("chart", [
    {"type": "bar", "x": "Revenue", "y": "Revenue"}, {"type": "scatter", "x": "Region", "y": "Revenue"},
    {"type": "pie", "x": "Revenue", "y": "Revenue"}, {"type": "bar", "x": "Region"}, {"x": "Region", "y": "Revenue"},
    {"type": "line", "x": "Nope", "y": "Revenue"}, {"type": "kpi", "y": "Region"}])
def test_invalid_charts(chart):
    with pytest.raises(ChartError):
        validate_chart(chart | {"datasetId": "ds"}, SALES)


@pytest.mark.parametrize("chart", [
    {"type": "bar", "x": "region", "y": "Revenue"}, {"type": "line", "x": "Date", "y": "Revenue"},
    {"type": "scatter", "x": "Revenue", "y": "Revenue"}, {"type": "pie", "x": {"field": "Region"}, "y": {"field": "Revenue"}},
    {"type": "bar", "x": "Region", "y": {"field": "*", "aggregation": "count"}}, {"type": "table"},
    {"type": "kpi", "query": {"measures": [{"field": "Revenue"}]}}])
def test_valid_charts(chart):
    assert validate_chart(chart | {"datasetId": "ds"}, SALES)
    with pytest.raises(ChartError):
        validate_chart(chart, SALES)


def test_chart_round_trip():
    config = {"chartId": "c1", "name": "Bar", "datasetId": "ds", "type": "bar",
              "x": {"field": "Region", "type": "categorical", "label": "R"}, "y": {"field": "Revenue", "aggregation": "avg"},
              "filters": [{"field": "Date", "operator": ">", "value": "2024-01-01"}], "showLegend": False, "note": {"a": 1}}
    stored = chart_to_stored(config)
    assert stored["query"]["measures"] == [{"field": "Revenue", "aggregation": "avg"}] and stored["style"]["showLegend"] is False
    assert stored_to_chart(stored) == config
    del stored["visualization"]["series"]
    assert stored_to_chart(stored)["x"] == {"field": "Region", "type": "categorical", "label": "R"}


def test_chart_specs(spark):
    spec = spec_for_chart({"type": "bar", "query": {"dimensions": ["a"], "measures": [{"field": "b", "label": "B"}]}})
    assert [(s.field, s.descending) for s in spec.sorts] == [("B", True)] and not spec.raw
    assert spec_for_chart({"type": "histogram", "query": {"dimensions": ["a"], "measures": ["b"]}}).dimensions == ()
    assert spec_for_chart({"type": "line", "query": {"dimensions": ["a"], "measures": [{"field": "b", "aggregation": "raw"}]}}).raw
    df = spark.createDataFrame([(1, 2.0, "u"), (1, 4.0, "v"), (2, 5.0, "u")], "x int, y double, k string")
    line = {"type": "line", "query": {"dimensions": ["x"], "measures": [{"field": "y", "aggregation": "RAW"}]}}
    assert [tuple(r) for r in run_chart(df, line).collect()] == [("y", 1.0, 3.0), ("y", 2.0, 5.0)]
    points = run_chart(df, {"type": "scatter", "query": {"measures": ["x", "y"]}}, [{"field": "k", "operator": "=", "value": "u"}])
    assert sorted(tuple(r) for r in points.collect()) == [(1.0, 2.0), (2.0, 5.0)]
    box = run_chart(df, {"type": "boxplot", "query": {"measures": [{"field": "y", "label": "Y"}]}}).first()
    assert (box["measure"], box["median"]) == ("Y", 4.0)


def test_dashboard(spark):
    df = spark.createDataFrame([("u", 1), ("v", 2)], "k string, n int")
    bar = {"chartId": "1", "type": "bar", "datasetId": "d", "x": "k", "y": "n"}
    other = bar | {"chartId": "2", "datasetId": "unknown"}
    filters = {"k": "u", "f": {"datasetId": "e", "field": "n", "operator": ">", "value": 100}}
    assert filters_of(filters, "d") == {"k": "u"}
    out = run_dashboard([bar, other], {"d": df}, filters, cache=True)
    assert {k: [tuple(r) for r in v.collect()] for k, v in out.items()} == {"1": [("u", 1)]}
    df.unpersist()
