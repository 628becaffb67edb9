import datetime as dt

import pytest

from tallyframe.functions.cleaning import (
    clean_boolean, clean_number, clean_string, leading_number, parse_date, trimmed,
)
from tallyframe.functions.names import (
    base_entity, has_name_token, is_foreign_key, is_key_like, is_primary_key, points_to, singular, snake_case, tokenize_name,
)
from tallyframe.functions.text_safety import classify_requests, flag_injection, strip_tags

D = dt.datetime


def test_clean_string(values):
    texts = [None, "", "  ", '""', 'hELLO "World"', "\t écOLE﻿\n", "x"]
    assert values(texts, clean_string) == [None, None, None, None, "Hello world", "École", "X"]


def test_clean_number(values):
    texts = [None, "", "-", "$1,200.50", "1e5", "1.2.3", "12-3", ".5", "5.", "-7 kg", "abc"]
    assert values(texts, clean_number) == [None, None, None, 1200.5, 15.0, None, None, 0.5, 5.0, -7.0, None]


def test_clean_boolean(values):
    texts = ["yes", " Y ", "TRUE", "1", "no", "N", "false", "0", "maybe", "", None]
    assert values(texts, clean_boolean) == [True] * 4 + [False] * 4 + [None] * 3


@pytest.mark.parametrize("text, want", [
    ("2024-01-15", D(2024, 1, 15)), ("2024/01-15", D(2024, 1, 15)), ("15/01/2024", D(2024, 1, 15)),
    ("01-15-2024", D(2024, 1, 15)), ("03/04/2024", D(2024, 4, 3)), ("31/02/2024", None), ("2024-02-30", None),
    ("44562", D(2022, 1, 1)), ("0", D(1899, 12, 30)), ("44562.9", D(2022, 1, 1)), ("1e3", D(1902, 9, 26)), ("9e99", None),
    ("2024-01-15T10:00:00Z", D(2024, 1, 15, 10)), ("2024-01-15T10:00:00+02:00", D(2024, 1, 15, 8)),
    ("2024-01-15 10:30", D(2024, 1, 15, 10, 30)), ("1/5/2024", D(2024, 1, 5)), ("1/5/2024 7:05", D(2024, 1, 5, 7, 5)),
    ("Jan 5, 2024", D(2024, 1, 5)), ("5 january 2024", D(2024, 1, 5)), ("Mon, 5 Feb 2024 10:11:12", D(2024, 2, 5, 10, 11, 12)),
    (' "2024-01-15" ', D(2024, 1, 15)), ("soon", None), ("10:00", None), ("", None), (None, None), ("ab/cd/2024", None),
])
def test_parse_date(values, text, want):
    got = values([text], lambda c: parse_date(c).cast("timestamp_ntz"))
    assert got == [want]


def test_leading_number_and_trim(values):
    assert values(["12 kg", "-3.5e1x", "kg", "", None, "+.5"], leading_number) == [12.0, -35.0, None, None, None, 0.5]
    assert values(["　a \t", "   "], trimmed) == ["a", None]


def test_strip_tags(values):
    assert values(["<p>a <b>c</b></p>", "1 < 2 > 0", "a<br/>\nb"], strip_tags) == ["a c", "1 < 2 > 0", "a\nb"]


def test_injection(spark):
    rows = [("select name from users", {"a": "b"}), ("it's; -- note", {}), ("union of sets, select one", {}), ("x or 1 = 1", {}),
            ("a &amp; drop table t", {}), ("data:image/png;base64,--", {}), ("plain text", {"$where": "1"}), ("plain", {"k": "drop table x"}), (None, None)]
    df = flag_injection(spark.createDataFrame(rows, "t string, m map<string,string>"), ["t", "m"])
    assert [r["suspicious"] for r in df.collect()] == [True, True, True, True, False, False, True, True, False]


def test_request_levels(spark):
    df = spark.createDataFrame([(500, 1.0), (404, 1.0), (200, 1500.0), (200, 10.0), (None, 1.0)], "status int, duration_ms double")
    assert [r["level"] for r in classify_requests(df).collect()] == ["error", "warn", "warn", "info", "error"]


def test_names():
    assert snake_case(" customerId ") == "customer_id" and tokenize_name("Order-Total2024") == ["order", "total2024"]
    assert has_name_token("Unit Price", ["price"]) and not has_name_token("priceless", ["price"])
    assert base_entity("fk_customer_id") == "customer" and base_entity("OrderNo") == "order"
    assert [singular(t) for t in ("categories", "leaves", "statuses", "orders", "gas", "people")] == [
        "category", "leaf", "status", "order", "gas", "person"]
    assert is_key_like("customer_id") and not is_key_like("id")
    assert is_primary_key("customer_id", "customers") and is_primary_key("order_id", "orders_2024") and is_primary_key("ID", "x")
    assert is_foreign_key("customer_id", "orders") and points_to("customer_id", "Customers") and not points_to("order_item_id", "orders")
