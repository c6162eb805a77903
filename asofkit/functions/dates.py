"""Date arithmetic that needs no calendar table."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_MONDAY = "1970-01-05"  # a Monday; weekday counting is measured from here


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _weekdays_since_monday(day: Column) -> Column:
    n = F.date_diff(day, F.lit(_MONDAY).cast("date"))
    week = F.floor(n / 7)
    return week * 5 + F.least(n - week * 7, F.lit(5))


def weekday_count(start: Column | str, end: Column | str) -> Column:
    """Monday-to-Friday days in [start, end). For end before start, minus those in (end, start]."""
    s, e = _c(start), _c(end)
    ahead = _weekdays_since_monday(e) - _weekdays_since_monday(s)
    back = _weekdays_since_monday(F.date_add(e, 1)) - _weekdays_since_monday(F.date_add(s, 1))
    return F.when(e >= s, ahead).otherwise(back).cast("int")


def calendar_parts(day: Column | str, prefix: str) -> list[Column]:
    """Month, quarter and weekday (Monday = 0) of a date."""
    d = _c(day)
    return [
        F.month(d).alias(f"{prefix}_month"),
        F.quarter(d).alias(f"{prefix}_quarter"),
        F.weekday(d).alias(f"{prefix}_weekday"),
    ]


def today_in(zone: str, instant: Column | None = None) -> Column:
    """Calendar date of an instant in a named zone (defaults to now)."""
    moment = instant if instant is not None else F.current_timestamp()
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), moment.cast("timestamp_ntz")).cast("date")


def utc_iso(instant: Column | None = None) -> Column:
    moment = instant if instant is not None else F.current_timestamp()
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def reference_month(year: Column, period: Column, frequency: str) -> Column:
    """First of the month a vintage refers to; a quarter refers to its middle month."""
    month = period if frequency == "monthly" else period * 3 - 1
    return F.make_date(year, month, F.lit(1))


def expected_latest_period(year: Column, period: Column, frequency: str) -> Column:
    """Month before the vintage's reference month."""
    return F.add_months(reference_month(year, period, frequency), -1)


def clamped_day(year: Column, month: Column, day: int) -> Column:
    """year-month-day with the day clamped to the month's length."""
    first = F.make_date(year, month, F.lit(1))
    return F.make_date(year, month, F.least(F.lit(day), F.day(F.last_day(first))))
