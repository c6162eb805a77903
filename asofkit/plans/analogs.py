"""The supplied star-schema tables read as event, result and release tables.

events    orders: one row per event with an announcement and an event date
results   lineitem summed by order: a five-part split of the accepted total
weekly    lineitem summed by ISO week of shipping: a release series with a publication lag
daily     lineitem summed by shipping day
contracts lineitem summed by week and supplier class
vintages  ship-month sums as known at each month end (a revised series)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arithmetic import share, total_of
from ..operators import calendar as cal

COMPLETE_YEARS = (1997, 2000)
PROVISIONAL_YEAR = 2001
FLAGS = ("A", "N", "R")
SEGMENTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar(spark: SparkSession) -> DataFrame:
    return cal.business_calendar(spark)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("event_key"),
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderpriority").alias("segment"),
        (F.col("o_orderstatus") == "F").alias("is_repeat"),
        day.alias("announce_date"),
        F.date_add(day, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("event_date"),
        F.col("o_totalprice").alias("amount"),
    )


def events_with_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events plus both cutoffs and the day their own result became safe to use."""
    c = calendar(spark)
    out = cal.with_cutoffs(events(spark, sf_dir), c, "announce_date", "event_date")
    return cal.with_next_business_day(out, c, "event_date", "result_safe_date")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status, price = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_extendedprice")
    even = F.col("l_linenumber") % 2 == 0

    def part(condition):
        return F.round(F.sum(F.when(condition, price).otherwise(0.0)), 2)

    r_closed = (flag == "R") & (status == "F")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_key")).agg(
        part(flag == "A").alias("primary_accepted"),
        part(flag == "N").alias("direct_accepted"),
        part((flag == "R") & (status == "O")).alias("indirect_accepted"),
        part(r_closed & even).alias("noncomp_accepted"),
        part((flag == "R") & ~((status == "O") | (r_closed & even))).alias("foreign_accepted"),
        F.round(F.sum("l_extendedprice") * 2, 2).alias("tendered"),
    )


SHARES = {
    "primary_share": "primary_accepted",
    "direct_share": "direct_accepted",
    "indirect_share": "indirect_accepted",
    "noncomp_share": "noncomp_accepted",
    "foreign_share": "foreign_accepted",
}


def with_targets(df: DataFrame) -> DataFrame:
    """Public total and the shares of it; a missing part makes the total missing."""
    total = total_of(*SHARES.values())
    return df.withColumn("public_total", F.round(total, 2)).select(
        "*", *[share(c, "public_total").alias(n) for n, c in SHARES.items()]
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with cutoffs, results and targets; events without lines are pending."""
    joined = events_with_cutoffs(spark, sf_dir).join(results(spark, sf_dir), "event_key", "left")
    return with_targets(joined).withColumn("results_available", F.col("public_total").isNotNull())


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow modelling pool."""
    return outcomes(spark, sf_dir).select(
        "event_key", "entity_id", "segment", "is_repeat", "announce_date", "event_date",
        F.year("event_date").alias("event_year"), "announcement_cutoff", "pre_event_cutoff",
        "result_safe_date", "amount", "primary_share",
    )


def event_chunk():
    """Order-preserving pieces of (event date, key): one day of a hot segment splits further
    as keys grow."""
    return F.struct("event_date", F.floor(F.col("event_key") / 1_000_000))


def weekly_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, observed, value): weekly sums, observed on the Wednesday of the week."""
    week = F.date_add(F.date_trunc("week", "l_shipdate").cast("date"), 2)
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("series"), week.alias("observed")
    ).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


def weekly_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per week: value_A, value_N, value_R and its publication and safe dates."""
    week = F.date_add(F.date_trunc("week", "l_shipdate").cast("date"), 2)
    flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
    wide = table(spark, sf_dir, "lineitem").groupBy(week.alias("observed")).agg(
        *[F.round(F.sum(F.when(flag == f, price)), 2).alias(f"value_{f}") for f in FLAGS])
    return cal.with_weekly_release_dates(wide, calendar(spark), "observed")


def daily_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("series"), F.col("l_shipdate").cast("date").alias("observed")
    ).agg(F.round(F.sum("l_extendedprice") / 1_000_000, 8).alias("value"))


def contracts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contract, observed, long_qty, short_qty, open_interest) by week and supplier class."""
    week = F.date_add(F.date_trunc("week", "l_shipdate").cast("date"), 1)
    qty, flag = F.col("l_quantity"), F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_suppkey") % 6).cast("int").alias("contract"), week.alias("observed")
    ).agg(
        F.sum(F.when(flag == "A", qty).otherwise(0.0)).alias("long_qty"),
        F.sum(F.when(flag == "N", qty).otherwise(0.0)).alias("short_qty"),
        F.sum("l_quantity").alias("open_interest"),
    )


def vintages_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vintage, observed, value): ship-month sums over orders booked by the vintage's month
    end, for months up to it. Sums are taken per (order month, ship month) first, so the
    running total over vintages works on months, not rows."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    cells = line.join(order, "l_orderkey").groupBy(
        F.trunc("o_orderdate", "month").alias("vintage"), F.trunc("l_shipdate", "month").alias("observed")
    ).agg(F.sum("l_extendedprice").alias("added"))
    months = F.broadcast(order.select(F.trunc("o_orderdate", "month").alias("vintage")).distinct())
    grid = cells.withColumnRenamed("vintage", "booked").join(
        months, (F.col("booked") <= F.col("vintage")) & (F.col("observed") <= F.col("vintage"))
    )
    return grid.groupBy("vintage", "observed").agg(F.round(F.sum("added"), 2).alias("value"))
