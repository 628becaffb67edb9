"""Calendar buckets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# --- fixed values -----------------------------------------------------------
TIME_BUCKETS = ("hour", "day", "week", "month", "quarter", "year")
# ----------------------------------------------------------------------------


def time_bucket(c: Column, unit: str, timezone: str = "UTC", dtype: T.DataType | None = None) -> Column:
    """Start of the ``unit`` holding ``c``, on the calendar of ``timezone``.

    Weeks start on Sunday. Text is parsed, unreadable text becomes null. A
    ``timestamp_ntz`` input is read as UTC and stays ``timestamp_ntz``.
    """
    if unit not in TIME_BUCKETS:
        raise ValueError(f"unknown time bucket {unit!r}; use one of {', '.join(TIME_BUCKETS)}")
    if isinstance(dtype, T.StringType):
        c = F.try_to_timestamp(c)
    shifted = timezone.upper() not in ("UTC", "Z", "GMT")
    if unit == "hour" and shifted:
        # An hour that a clock change repeats is two hours: take the wall clock's minutes off the instant.
        wall = F.from_utc_timestamp(c, timezone)
        start = F.timestamp_micros(F.unix_micros(c.cast("timestamp")) - (
            F.unix_micros(wall.cast("timestamp")) - F.unix_micros(F.date_trunc("hour", wall).cast("timestamp"))))
        return start.cast("timestamp_ntz") if isinstance(dtype, T.TimestampNTZType) else start
    wall = F.from_utc_timestamp(c, timezone) if shifted else c
    if unit == "week":
        one_day = F.expr("INTERVAL '1' DAY")
        start = F.date_trunc("week", wall + one_day) - one_day
    else:
        start = F.date_trunc(unit, wall)
    if shifted:
        start = F.to_utc_timestamp(start, timezone)
    return start.cast("timestamp_ntz") if isinstance(dtype, T.TimestampNTZType) else start
