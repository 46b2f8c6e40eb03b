"""Dates. ``ms`` is epoch milliseconds; a zone matters only where a local date is named, and is the session's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOSCOW_MS = 3 * 3_600_000
DAY_MS = 86_400_000


def msk_day(ms: Column) -> Column:
    """Number of the day in Moscow; truncates towards zero."""
    return F.call_function("div", ms + MOSCOW_MS, F.lit(DAY_MS))


def msk_day_double(ms: Column) -> Column:
    return (ms + MOSCOW_MS).cast("double") / F.lit(float(DAY_MS))


#: The number of the day again, whatever the name says: that is what it has always given.
msk_day_midnight = msk_day


def to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def to_local_date(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def date_to_millis(day: Column) -> Column:
    """Midnight at which a day begins in the session's zone."""
    return F.unix_millis(day.cast("timestamp"))


def _utc(ms: Column) -> Column:
    """A timestamp without zone that shows UTC whatever the session's zone is."""
    return F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())


def http_date(ms: Column) -> Column:
    return F.date_format(_utc(ms), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def days_between(a: Column, b: Column) -> Column:
    """Complete days from a to b; negative backwards."""
    return F.timestamp_diff("DAY", a, b).cast("int")


def months_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MONTH", a, b).cast("int")


def years_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("YEAR", a, b).cast("int")


def parse_datetime(s: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.try_to_timestamp(s, F.lit(pattern))


def parse_date(s: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.to_date(F.try_to_timestamp(s, F.lit(pattern)))


def format_datetime(ms: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_millis(ms), pattern)
