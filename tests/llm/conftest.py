from __future__ import annotations

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and extra columns whose
    names clash with those of operators and, but for case, with the table's own."""
    long = " ".join(f"word{i % 977} of the" for i in range(40_000))
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (None, "a text without an id", "en", "a", 20),
        (3, " \t\n ", "de", "b", 4), (4, long, "en", "a", len(long)), (5, long, "en", "a", len(long)),
        (6, "same line\nsame line\n\nother line", "en", "a", 31), (6, "same line\nsame line\n\nother line", "en", "a", 31),
        (7, "  two  spaces ▁ mark ", "fr", "b", 20), (8, "nul\x00 and é́ é \U0001f600", "es", "b", 12), (None, None, None, None, None),
        (9, "<|endoftext|> THE,the 'S a.b ...x", "en", "c", 30), (10, "x" * 5000, "en", "c", 5000),
    ]
    extra = [r + ("clash", 7, "x", 1.5) for r in rows]
    schema = T._parse_datatype_string(DOCUMENTS + ", key string, fp int, Text string, kept double")
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield spark.createDataFrame(extra, schema).repartition(3).cache()
    spark.conf.unset("spark.sql.caseSensitive")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path
