"""Cleaning scalar functions: text -> typed value, as JVM-side column expressions.

Every function takes and returns a Column; unreadable input becomes null and
never raises, whatever the session's ANSI setting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

# --- fixed values -----------------------------------------------------------
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
TEXT_TYPES = ("string", "text", "varchar", "char")
NUMBER_TYPES = ("number", "integer", "int", "float", "decimal", "double")
BOOLEAN_TYPES = ("boolean", "bool")
DATE_TYPES = ("date", "datetime", "timestamp")
SERIAL_DATE_EPOCH = "1899-12-30"
# characters a trim removes: the white space of ECMAScript
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# ----------------------------------------------------------------------------

NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_LEADING_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
SHORT_TEXT = 63  # bytes; below the length of a digest, so the two never meet
_MAX_SERIAL = 100_000_000  # days; the range a date-time can hold

# Text forms beyond the three plain day formats that are read as a date.
MONTH_NAME_FORMATS = (
    "d MMM yyyy[ H:mm[:ss]]", "d MMMM yyyy[ H:mm[:ss]]",
    "MMM d, yyyy[ H:mm[:ss]]", "MMMM d, yyyy[ H:mm[:ss]]",
    "MMM d yyyy[ H:mm[:ss]]", "MMMM d yyyy[ H:mm[:ss]]",
)


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c.cast("string"), F.lit(WHITE_SPACE))


def trimmed(c: Column) -> Column:
    """Without white space at both ends; null when nothing is left."""
    return F.nullif(stripped(c), F.lit(""))


def unquoted(c: Column) -> Column:
    """Without double quotes and white space at both ends."""
    return stripped(F.replace(c.cast("string"), F.lit('"'), F.lit("")))


def clean_string(c: Column) -> Column:
    """No double quotes, trimmed, first letter upper, the rest lower case."""
    text = unquoted(c)
    cased = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))
    return F.nullif(cased, F.lit(""))


def clean_number(c: Column) -> Column:
    """Digits, dots and minus signs only, as a double: ``$1,200.50`` -> 1200.5."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def clean_boolean(c: Column) -> Column:
    word = F.lower(stripped(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def clean_unknown(c: Column, dtype: T.DataType | None = None) -> Column:
    """Flags and finite numbers stay; anything else is cleaned as text."""
    if isinstance(dtype, T.BooleanType):
        return c
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return c if isinstance(dtype, T.NumericType) else clean_string(c)


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date").cast("timestamp")


def native_date(text: Column) -> Column:
    """ISO dates and date-times, month-first dates, and dates with a month name."""
    iso = r"^\d{4}-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{2}.*)?)?$"
    slashed = r"^(\d{4})/(\d{1,2})/(\d{1,2})((?: \d{1,2}:\d{2}(?::\d{2})?)?)$"
    month_first = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})((?: \d{1,2}:\d{2}(?::\d{2})?)?)$"
    # An optional weekday and day, then a month's name: however many spaces lie between them.
    month = r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?(?:\d{1,2}[-\s]+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    named = F.regexp_replace(F.regexp_replace(text, r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), r"\s+", " ")
    return (
        F.when(text.rlike(iso), text.try_cast("timestamp"))
        .when(text.rlike(slashed), F.regexp_replace(text, slashed, "$1-$2-$3$4").try_cast("timestamp"))
        .when(text.rlike(month_first), F.regexp_replace(text, month_first, "$3-$1-$2$4").try_cast("timestamp"))
        .when(
            text.rlike(month),
            F.coalesce(*(F.try_to_timestamp(named, F.lit(f)) for f in MONTH_NAME_FORMATS)),
        )
    )


def parse_date(c: Column) -> Column:
    """Timestamp (UTC) of a date text.

    A number is a spreadsheet day serial. Then year-first, day-first and
    month-first dates with ``-`` or ``/`` are tried in that order, then the
    forms of ``native_date``. A day the calendar does not have is null.
    """
    return parse_plain_date(unquoted(c))


def parse_plain_date(text: Column) -> Column:
    """``parse_date`` of a text without quotes and outer white space.

    Length and separators pick the common forms, so these need no regular
    expression; the cast to a date rejects whatever is not one.
    """
    def separated(*positions: int) -> Column:
        ok = F.octet_length(text) == 10
        for p in positions:
            ok = ok & F.substring(text, p, 1).isin("-", "/")
        return ok

    serial = F.floor(text.try_cast("double"))
    from_serial = F.when(
        F.abs(serial) <= _MAX_SERIAL,
        F.date_add(F.lit(SERIAL_DATE_EPOCH).cast("date"), serial.try_cast("int")).cast("timestamp"),
    )
    a, b, year = F.substring(text, 1, 2), F.substring(text, 4, 2), F.substring(text, 7, 4)
    return (
        F.when(separated(5, 8), _day(F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2)))
        .when(separated(3, 6), F.coalesce(_day(year, b, a), _day(year, a, b)))
        .when(text.rlike(NUMBER_TEXT), from_serial)
        .otherwise(native_date(text))
    )


def leading_number(c: Column) -> Column:
    """The number a text begins with (``12 kg`` -> 12), else null."""
    return F.nullif(F.regexp_extract(trimmed(c), _LEADING_NUMBER, 0), F.lit("")).try_cast("double")


def comparison_key(text: Column) -> Column:
    """Text for grouping by value: long texts as their SHA-256, so a shuffle never carries them."""
    return F.when(F.octet_length(text) > SHORT_TEXT, F.sha2(text, 256)).otherwise(text)


CLEANERS: dict[str, Callable[[Column], Column]] = (
    {t: clean_string for t in TEXT_TYPES}
    | {t: clean_number for t in NUMBER_TYPES}
    | {t: clean_boolean for t in BOOLEAN_TYPES}
    | {t: parse_date for t in DATE_TYPES}
    | {"unknown": clean_unknown}
)
