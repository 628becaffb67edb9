"""Delimited files as all-text frames with source row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.names import plain_name
from ..operators.columns import ColumnMeta
from ..operators.validate import CORRUPT, ROW_NUMBER, SOURCE_FILE

# --- fixed values -----------------------------------------------------------
PEEK_ROWS = 500
SAMPLE_ROWS = 100
FIRST_DATA_ROW = 2  # the header is row 1
# ----------------------------------------------------------------------------

# Splits whose start offsets may be broadcast: about 100 bytes each.
BROADCAST_SPLITS = 500_000


def normalize_headers(cols: list[str | None]) -> list[str]:
    """Trimmed names; a blank one becomes ``column_<position>``."""
    return [(c or "").strip() or f"column_{i}" for i, c in enumerate(cols, start=1)]


def validate_headers(cols: list[str]) -> list[str]:
    if not cols:
        raise ValueError("the file has no header row")
    seen: set[str] = set()
    for c in cols:
        if c.lower() in seen:
            raise ValueError(f"header {c!r} occurs twice")
        seen.add(c.lower())
    return cols


def csv_options(delimiter: str = ",", multiline: bool = False) -> dict[str, str]:
    """Reader options; short and long rows end up in the corrupt-record column."""
    return {
        "header": "true", "sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false",
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
        "multiLine": str(multiline).lower(),
    }


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])


def read_headers(spark: SparkSession, path: str, delimiter: str = ",") -> list[str]:
    """Normalised, checked header of a file (one row reaches the driver)."""
    return validate_headers(normalize_headers(_first_row(spark, path, delimiter)))


def _first_row(spark: SparkSession, path: str, delimiter: str) -> list[str | None]:
    # The white space around names goes here as it does when Spark compares headers.
    options = csv_options(delimiter) | {"header": "false", "columnPruning": "true"}
    options.pop("columnNameOfCorruptRecord")
    return list(spark.read.options(**options).csv(path).first() or ())


class HeaderDiffers(ValueError):
    """A file of a load names other columns, or the same in another order."""


def check_headers(spark: SparkSession, files: list[str], names: list[str], delimiter: str = ",") -> None:
    """Raise unless every file's normalised header is ``names``. Reads one row per file; only for headers with blank
    names, which Spark's own comparison does not know."""
    wanted = [n.lower() for n in names]
    for file in files:
        found = normalize_headers(_first_row(spark, file, delimiter))
        if [n.lower() for n in found] != wanted:
            raise HeaderDiffers(f"{file} has the columns {found}, not {names}")


def read_csv_raw(spark: SparkSession, path: str, delimiter: str = ",", multiline: bool = False,
                 row_numbers: bool = True, base: int = 0) -> DataFrame:
    """Text columns, ``_corrupt_record``, ``_source_file`` and ``_row_number``.

    Cells are trimmed and all-empty rows skipped. Numbers are unique over all files; the source file is its
    whole path. A file whose header differs from the first one's raises. Files split at line ends;
    ``multiline=True`` allows line breaks inside quotes and then reads each file
    in one task.
    """
    given = _first_row(spark, path, delimiter)
    names = validate_headers(normalize_headers(given))
    reader = spark.read.options(**csv_options(delimiter, multiline)).schema(text_schema(names))
    # Spark compares the header of every file, but for names that are blank in it.
    df = reader.option("enforceSchema", str(given != names).lower()).csv(path)
    if given != names:
        check_headers(spark, df.inputFiles(), names, delimiter)
    df = df.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))
    if row_numbers:
        df = with_row_number(df, base + FIRST_DATA_ROW - 1)
    return df.filter(F.coalesce(*(F.col(f"`{n}`") for n in names), F.col(CORRUPT)).isNotNull())


def with_row_number(df: DataFrame, base: int = 0) -> DataFrame:
    """Rows of a file scan numbered ``base + 1, ...`` in the order of files and rows.

    Each row knows its place inside its split (the running id minus the split's
    first id). One count per split gives the offsets, so numbering needs no sort;
    the only window is over splits, one row each. Files follow each other by path,
    so a number is unique over all files of the scan.
    """
    placed = df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    )
    splits = placed.groupBy("__file", "__start").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__file", "__start", "__first",
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # Every split is a task's share of one file, which bounds their number; the file list stays in the JVM.
    # Left to itself the join would move all rows, as the size of an aggregate is not known in advance.
    few = len(df._jdf.inputFiles()) + df.rdd.getNumPartitions() <= BROADCAST_SPLITS
    joined = placed.join(F.broadcast(offsets) if few else offsets, ["__file", "__start"])
    number: Column = F.col("__id") - F.col("__first") + F.col("__before") + F.lit(base + 1)
    return joined.select(*df.columns, number.cast("long").alias(ROW_NUMBER))


def unique_row_id(df: DataFrame, base: int = 0) -> DataFrame:
    """Unique but not dense row ids, with no extra pass."""
    return df.withColumn(ROW_NUMBER, F.monotonically_increasing_id() + F.lit(base + 1))


def compare_append_columns(schema: list[ColumnMeta], headers: list[str]) -> dict:
    """Whether a file's columns fit a stored schema, and what differs."""
    stored = [c.name.strip() for c in schema if c.name and c.name.strip()]
    known, given = {plain_name(n) for n in stored}, {plain_name(h.strip()) for h in headers if h.strip()}
    missing = [n for n in stored if plain_name(n) not in given]
    unexpected = [h for h in headers if plain_name(h) not in known]
    return {
        "is_match": len(stored) == len(headers) and not missing and not unexpected,
        "expected_count": len(stored), "received_count": len(headers),
        "missing_columns": missing, "unexpected_columns": unexpected,
    }


def peek(df: DataFrame, n: int = PEEK_ROWS) -> DataFrame:
    """The first rows of a source."""
    return df.limit(n)


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """``n`` random rows (all when there are fewer): a top-N by a seeded random key."""
    return df.orderBy(F.rand(seed)).limit(n)
