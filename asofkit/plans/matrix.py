"""The point-in-time predictor matrix over the supplied tables, as one dataflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import arithmetic as ar, dates as dt
from ..operators import asof, calendar as cal
from ..session import materialise
from ..sources import normalize as no
from . import analogs as an

CUTOFFS = {"announcement": "announcement_cutoff", "pre_event": "pre_event_cutoff"}
SEGMENT_LABEL = {"1-URGENT": "A", "2-HIGH": "N", "3-MEDIUM": "R", "4-NOT SPECIFIED": "A"}
PRIMARY_CONTRACT = {"1-URGENT": "0", "2-HIGH": "1", "4-NOT SPECIFIED": "4"}
CONTRACTS_OF = {"1-URGENT": ["0"], "2-HIGH": ["1", "2", "3"], "4-NOT SPECIFIED": ["4"], "3-MEDIUM": []}

PREDICTORS = ["log_amount", "weekly_a", "weekly_r", "macro_level"]
CONTRACT = ["event_key", "cutoff_view", "segment", "is_repeat", *PREDICTORS]
FORBIDDEN = ["primary_share", "direct_share", "indirect_share", "public_total", "tendered"]


def weekly(spark, sf_dir) -> DataFrame:
    return an.weekly_releases(spark, sf_dir)


def positions_joined(spark, sf_dir, cutoff: str) -> DataFrame:
    """Events with the latest position report.

    The tables hold no gaps, so one is made by expression: contract 4 is taken as covered from 1996 on, and its earlier values are
    NULL. No report is left out.
    """
    ct = an.contracts_long(spark, sf_dir).withColumn("net", ar.net("long_qty", "short_qty"))
    covered = (F.col("contract") != 4) | (F.col("observed") >= F.lit("1996-01-01").cast("date"))
    ct = ct.withColumns({c: F.when(covered, F.col(c)) for c in ("open_interest", "net")})
    wide = no.pivot_unique(ct, index="observed", entity="contract", entities=range(6), values=["open_interest", "net"])
    wide = wide.withColumn("friday", F.date_add("observed", 3))
    wide = cal.with_next_business_day(wide, an.calendar(spark), "friday", "safe_date").drop("friday")
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", "segment", cutoff)
    return asof.asof_join(ev, wide, cutoff=cutoff, safe="safe_date", tie=["observed"])


def variable_snapshots(spark, sf_dir) -> DataFrame:
    """(variable, vintage, value, safe_date): latest quantity per variable and vintage."""
    line = an.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag", "l_quantity")
    order = an.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    cell = line.join(order, "l_orderkey").groupBy(
        F.col("l_returnflag").alias("variable"), F.trunc("o_orderdate", "month").alias("booked"),
        F.trunc("l_shipdate", "month").alias("observed")).agg(F.sum("l_quantity").alias("q"))
    months = F.broadcast(order.select(F.trunc("o_orderdate", "month").alias("vintage")).distinct())
    v = cell.join(months, (F.col("booked") <= F.col("vintage")) & (F.col("observed") <= F.col("vintage"))).groupBy(
        "variable", "vintage", "observed").agg(F.sum("q").alias("value"))
    snap = v.groupBy("variable", "vintage").agg(F.max_by("value", "observed").alias("value"))
    snap = snap.withColumn("nominal", F.date_add("vintage", 24))
    return cal.with_next_business_day(snap, an.calendar(spark), "nominal", "safe_date").drop("nominal")


def macro(spark, sf_dir) -> DataFrame:
    """(vintage, current_value, safe_date) of the revised monthly series."""
    v = an.vintages_long(spark, sf_dir)
    snap = asof.vintage_snapshot(v, by=["vintage"], observed="observed", value="value", yoy_lag=12)
    snap = snap.withColumn("nominal", dt.clamped_day(F.year("vintage"), F.month("vintage"), 25))
    return cal.with_next_business_day(snap, an.calendar(spark), "nominal", "safe_date").select("vintage", "current_value", "safe_date")


def inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    ev = an.events_with_cutoffs(spark, sf_dir)
    return ev, weekly(spark, sf_dir).drop("published_date"), macro(spark, sf_dir)


def joined_from(events: DataFrame, weekly_rel: DataFrame, macro_rel: DataFrame) -> DataFrame:
    """One row per (event, cutoff view) with predictors and `{family}__{column}` provenance."""
    views = asof.melt_cutoffs(events.select("event_key", "segment", "is_repeat", "amount", *CUTOFFS.values()), CUTOFFS)
    w = weekly_rel.select(F.col("observed").alias("weekly__observed"), F.col("safe_date").alias("weekly__safe_date"),
                          F.col("value_A").alias("weekly_a"), F.col("value_R").alias("weekly_r"))
    m = macro_rel.select(F.col("vintage").alias("macro__vintage"), F.col("safe_date").alias("macro__safe_date"),
                         F.col("current_value").alias("macro_level"))
    out = asof.asof_join(views, w, cutoff="cutoff", safe="weekly__safe_date", tie=["weekly__observed"], matched="weekly_matched")
    out = asof.asof_join(out, m, cutoff="cutoff", safe="macro__safe_date", tie=["macro__vintage"], matched="macro_matched")
    return out.withColumn("log_amount", F.round(F.log1p("amount"), 9))


def joined(spark, sf_dir) -> DataFrame:
    return joined_from(*inputs(spark, sf_dir))


def predictor_matrix(table: DataFrame) -> DataFrame:
    """Exactly the contract's columns."""
    return table.select(*CONTRACT)


def audit_table(table: DataFrame) -> DataFrame:
    """Provenance of every predictor, kept apart from the predictors."""
    return table.select("event_key", "cutoff_view", *sorted(c for c in table.columns if "__" in c))
