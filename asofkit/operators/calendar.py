"""Business-day calendar as a small dimension table, and the date rules built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# One row per day; 70 years is about 25,000 rows, so the table is always safe to broadcast.
FIRST_DAY = "1980-01-01"
LAST_DAY = "2049-12-31"


# U.S. federal holidays. A fixed date on a Saturday is observed on Friday, on a Sunday on Monday.
_FIXED = """(month({d}) = 1 AND day({d}) = 1) OR (month({d}) = 6 AND day({d}) = 19 AND year({d}) >= 2021)
  OR (month({d}) = 7 AND day({d}) = 4) OR (month({d}) = 11 AND day({d}) = 11) OR (month({d}) = 12 AND day({d}) = 25)"""
_HOLIDAY = f"""
  (weekday(day) < 5 AND ({_FIXED.format(d="day")}))
  OR (weekday(day) = 4 AND ({_FIXED.format(d="date_add(day, 1)")}))
  OR (weekday(day) = 0 AND ({_FIXED.format(d="date_sub(day, 1)")}))
  OR (weekday(day) = 0 AND (
    (month(day) = 1 AND ceil(day(day) / 7) = 3 AND year(day) >= 1986) OR (month(day) = 2 AND ceil(day(day) / 7) = 3)
    OR (month(day) = 5 AND month(date_add(day, 7)) = 6) OR (month(day) = 9 AND ceil(day(day) / 7) = 1)
    OR (month(day) = 10 AND ceil(day(day) / 7) = 2)))
  OR (weekday(day) = 3 AND month(day) = 11 AND ceil(day(day) / 7) = 4)"""

_KNOWN: dict[tuple, DataFrame] = {}


def computed_calendar(spark: SparkSession, first: str, last: str, extra_closures: DataFrame | None = None) -> DataFrame:
    """The calendar as a plan. The neighbours of a day come from two running windows over this one
    small table, however long the stretch of closed days."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day").selectExpr(
        "day", f"({_HOLIDAY}) AS is_holiday")
    if extra_closures is not None:
        closed = extra_closures.select("day").distinct().withColumn("__closed", F.lit(True))
        days = days.join(F.broadcast(closed), "day", "left").selectExpr(
            "day", "is_holiday OR coalesce(__closed, false) AS is_holiday")
    days = days.selectExpr("day", "is_holiday", "weekday(day) < 5 AND NOT is_holiday AS is_business_day")
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    open_day = F.when(F.col("is_business_day"), F.col("day"))
    return days.select(
        "day", "is_holiday", "is_business_day",
        F.min(open_day).over(after).alias("next_business_day"),
        F.max(open_day).over(before).alias("previous_business_day"),
    )


def business_calendar(
    spark: SparkSession, first: str = FIRST_DAY, last: str = LAST_DAY, extra_closures: DataFrame | None = None
) -> DataFrame:
    """(day, is_holiday, is_business_day, next_business_day, previous_business_day).

    extra_closures(day) adds closings that follow no rule. Without them the calendar depends
    on nothing but its two dates, so it is computed once per session and kept as a literal
    table of one row per day; plans that use it several times stay small.
    """
    if extra_closures is not None:
        return computed_calendar(spark, first, last, extra_closures)
    key = (spark.sparkContext.applicationId, first, last)
    if key not in _KNOWN:
        _KNOWN[key] = spark.createDataFrame(computed_calendar(spark, first, last).toArrow())
    return _KNOWN[key]


def _attach(df: DataFrame, calendar: DataFrame, on: Column, source: str, out: str) -> DataFrame:
    lookup = F.broadcast(calendar.select(F.col("day").alias("__cal_day"), F.col(source).alias(out)))
    return _covered(df.join(lookup, on == F.col("__cal_day"), "left"), on, out)


def _covered(joined: DataFrame, on: Column, out: str) -> DataFrame:
    """Fails on a day beyond the calendar, which would otherwise pass as one without a neighbour."""
    outside = on.isNotNull() & F.col("__cal_day").isNull()
    text = F.concat(F.lit("day outside the calendar: "), on.cast("string"))
    return joined.withColumn(out, F.when(outside, F.raise_error(text)).otherwise(F.col(out))).drop("__cal_day")


def with_next_business_day(df: DataFrame, calendar: DataFrame, day: str, out: str) -> DataFrame:
    """First business day strictly after `day`."""
    return _attach(df, calendar, F.col(day), "next_business_day", out)


def with_previous_business_day(df: DataFrame, calendar: DataFrame, day: str, out: str) -> DataFrame:
    return _attach(df, calendar, F.col(day), "previous_business_day", out)


def with_cutoffs(
    df: DataFrame, calendar: DataFrame, announce: str, event: str,
    announcement_out: str = "announcement_cutoff", pre_event_out: str = "pre_event_cutoff",
) -> DataFrame:
    """Two cutoffs per event: the announcement date and the business day before the event."""
    out = df.withColumn(announcement_out, F.col(announce))
    return with_previous_business_day(out, calendar, event, pre_event_out)


def with_weekly_release_dates(
    df: DataFrame, calendar: DataFrame, observed: str, lag_days: int = 1,
    published_out: str = "published_date", safe_out: str = "safe_date",
) -> DataFrame:
    """Nominal publication `lag_days` after the observation, moved past a holiday; safe use
    starts on the next full business day. Two lookups in the broadcast calendar."""
    out = _shifted(df, calendar, F.date_add(F.col(observed), lag_days), published_out)
    return with_next_business_day(out, calendar, published_out, safe_out)


def _shifted(df: DataFrame, calendar: DataFrame, nominal: Column, out: str) -> DataFrame:
    """`nominal`, or the next business day when it is a holiday."""
    cal = F.broadcast(calendar.select(
        F.col("day").alias("__cal_day"),
        F.when(F.col("is_holiday"), F.col("next_business_day")).otherwise(F.col("day")).alias(out)))
    return _covered(df.join(cal, nominal == F.col("__cal_day"), "left"), nominal, out)


def with_overridden_release_dates(
    df: DataFrame, calendar: DataFrame, observed: str, *,
    overrides: DataFrame, windows: DataFrame, lag_days: int = 3, fallback_days: int = 60,
) -> DataFrame:
    """Release dates with three rules in priority order.

    1. overrides(observed, actual_published, precision, source): the stated date.
    2. windows(window_name, window_start, window_end): inside a known disruption there is no
       nominal date and safe use starts after `fallback_days`.
    3. otherwise the standard lag, moved past a holiday.
    overrides and windows are hand-kept tables of a few dozen rows.
    """
    day = F.col(observed)
    out = _shifted(df, calendar, F.date_add(day, lag_days), "__standard")
    out = out.join(F.broadcast(overrides.withColumnRenamed("observed", observed)), observed, "left")
    out = out.join(F.broadcast(windows), day.between(F.col("window_start"), F.col("window_end")), "left")
    overridden, disrupted = F.col("actual_published").isNotNull(), F.col("window_name").isNotNull()
    nominal = F.when(overridden, F.col("actual_published")).when(~disrupted, F.col("__standard"))
    out = out.select(
        *df.columns, nominal.alias("nominal_published_date"),
        F.when(overridden, F.col("precision")).when(disrupted, F.lit("window_fallback"))
        .otherwise(F.lit("standard_rule")).alias("availability_precision"),
        F.when(overridden, F.col("source")).when(disrupted, F.concat(F.lit("window:"), F.col("window_name")))
        .otherwise(F.lit("standard")).alias("release_rule"),
    )
    anchor = F.coalesce("nominal_published_date", F.date_add(day, fallback_days))
    return _attach(out, calendar, anchor, "next_business_day", "safe_date")
