"""Tolerant parsing of raw text fields. Every function is Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_token(col: Column | str, token: str) -> Column:
    """Map the source's literal missing token to NULL and touch nothing else."""
    return F.nullif(_c(col), F.lit(token))


def parse_date(col: Column | str, token: str = "null", fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(null_token(col, token), F.lit(fmt)).cast("date")


def parse_number(col: Column | str, token: str = "null") -> Column:
    return null_token(col, token).try_cast("double")


def invalid_date(col: Column | str, token: str = "null", fmt: str = "yyyy-MM-dd") -> Column:
    """True where text was present but is not a date."""
    return null_token(col, token).isNotNull() & parse_date(col, token, fmt).isNull()


def invalid_number(col: Column | str, token: str = "null") -> Column:
    return null_token(col, token).isNotNull() & parse_number(col, token).isNull()


def nan_to_null(col: Column | str) -> Column:
    """Missing numbers are NULL in this library; NaN would poison avg, max and count."""
    return F.when(F.isnan(_c(col)), F.lit(None)).otherwise(_c(col))


# Two-digit vintage years: 50..99 are 19xx, 00..49 are 20xx.
CENTURY_PIVOT = 50


def vintage_year(suffix: Column | str) -> Column:
    two = F.regexp_extract(_c(suffix), r"^(\d{2})[MQ](\d{1,2})$", 1).try_cast("int")
    return F.when(two >= CENTURY_PIVOT, two + 1900).otherwise(two + 2000)


def vintage_period(suffix: Column | str, frequency: str) -> Column:
    """Month number of a yyMm suffix or quarter number of a yyQq suffix, else NULL."""
    pattern = r"^\d{2}M(\d{1,2})$" if frequency == "monthly" else r"^\d{2}Q(\d)$"
    return F.regexp_extract(_c(suffix), pattern, 1).try_cast("int")


def observation_period_date(period: Column | str, frequency: str) -> Column:
    """First day of a 'YYYY:MM' month or a 'YYYY:Qq' quarter; NULL when malformed."""
    if frequency == "monthly":
        year = F.regexp_extract(_c(period), r"^(\d{4}):(\d{2})$", 1).try_cast("int")
        month = F.regexp_extract(_c(period), r"^(\d{4}):(\d{2})$", 2).try_cast("int")
    else:
        year = F.regexp_extract(_c(period), r"^(\d{4}):Q(\d)$", 1).try_cast("int")
        month = F.regexp_extract(_c(period), r"^(\d{4}):Q(\d)$", 2).try_cast("int") * 3 - 2
    return F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))


def leading_reason(col: Column | str) -> Column:
    """Leading word of a free-text missing reason; NULL when the text has none."""
    return F.nullif(F.regexp_extract(_c(col), r"^([a-z_]+)", 1), F.lit(""))
