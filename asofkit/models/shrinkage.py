"""Two-level empirical-Bayes means from grouped moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.folds import Pool, cells, cells_by_fold
from ..session import materialise

# Fixed value: between-group variance never falls below this.
VARIANCE_FLOOR = 1e-8


def _moments(groups: DataFrame, fold: Sequence[str]) -> DataFrame:
    """Per fold: within and between variance of an unbalanced one-way layout.

    `groups` has one row per fold and group with n, mean and the within sum of squares.
    """
    totals = groups.groupBy(*fold).agg(
        F.sum("n").alias("__nt"), F.count("*").alias("__k"), F.sum("ssw").alias("__ssw"),
        F.sum(F.col("n") * F.col("n")).alias("__n2"), F.sum(F.col("n") * F.col("mean")).alias("__ny"),
    ).withColumn("__grand", F.col("__ny") / F.col("__nt"))
    ssb = groups.join(totals, list(fold)).groupBy(*fold).agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("__grand")) * (F.col("mean") - F.col("__grand"))).alias("__ssb"))
    t = totals.join(ssb, list(fold))
    spare = F.col("__nt") - F.col("__k")
    # with one row per group the spread of all rows stands in for the within variance
    overall = F.coalesce(F.try_divide(F.col("__ssb") + F.col("__ssw"), F.col("__nt") - 1), F.lit(0.0))
    within = F.when(spare > 0, F.try_divide("__ssw", spare)).otherwise(overall)
    effective = F.try_divide(F.col("__nt") - F.col("__n2") / F.col("__nt"), F.col("__k") - 1)
    between = F.when(effective > 0, (F.try_divide("__ssb", F.col("__k") - 1) - within) / effective).otherwise(0.0)
    ratio = within / F.greatest(between, F.lit(VARIANCE_FLOOR))
    return t.select(
        *fold, (F.col("__k") < 2).alias("single"), F.when(F.col("__k") < 2, 0.0).otherwise(ratio).alias("ratio"))


def shrunk_means(df: DataFrame, folds: DataFrame, p: Pool) -> DataFrame:
    """(test_year, segment, repeat, n, weight, prior, estimate, segment_estimate, global_mean).

    Segments shrink to the fold's mean, (segment, repeat) cells to their own shrunk segment.
    """
    scored = df.where(F.col(p.value).isNotNull())
    v = F.col(p.value)
    cell = cells(scored, p, [p.segment, p.repeat],
                 [F.count("*").alias("c"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")])
    sums = [F.sum("c").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")]
    return shrink(cells_by_fold(cell, folds, p, [p.segment, p.repeat], sums), p)


def shrink(fine: DataFrame, p: Pool, fold: Sequence[str] = ("test_year",)) -> DataFrame:
    """The same from (fold, segment, repeat, n, s, ss): counts, sums and sums of squares of training rows."""

    def finished(t: DataFrame) -> DataFrame:
        mean = F.col("s") / F.col("n")
        return t.withColumn("mean", mean).withColumn("ssw", F.greatest(F.col("ss") - F.col("s") * mean, F.lit(0.0)))

    coarse = finished(fine.groupBy(*fold, p.segment).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")))
    overall = fine.groupBy(*fold).agg((F.sum("s") / F.sum("n")).alias("global_mean"))
    fine = finished(fine)

    def weight(single: str, ratio: str, n: str):
        return F.when(F.col(single), F.lit(1.0)).otherwise(F.col(n) / (F.col(n) + F.col(ratio)))

    seg = coarse.join(_moments(coarse, fold), list(fold)).join(overall, list(fold))
    w = weight("single", "ratio", "n")
    seg = seg.select(*fold, p.segment, "global_mean",
                     (w * F.col("mean") + (1 - w) * F.col("global_mean")).alias("segment_estimate"))
    full = fine.join(_moments(fine, fold), list(fold)).join(seg, [*fold, p.segment])
    return full.select(
        *fold, p.segment, p.repeat, "n", w.alias("weight"), F.col("segment_estimate").alias("prior"),
        (w * F.col("mean") + (1 - w) * F.col("segment_estimate")).alias("estimate"), "segment_estimate", "global_mean",
    )


def shrinkage_forecasts(rows: DataFrame, table: DataFrame, p: Pool, out: str = "shrinkage", keys: Sequence[str] = ("test_year",)) -> DataFrame:
    """Cell estimate, else its segment's, else the fold mean. The table is written first, so its size picks the joins."""
    table = materialise(table)
    fine = table.select(*keys, p.segment, p.repeat, F.col("estimate").alias("__e2"))
    seg = table.groupBy(*keys, p.segment).agg(F.max("segment_estimate").alias("__e1"))
    top = table.groupBy(*keys).agg(F.max("global_mean").alias("__e0"))
    out_rows = rows.join(fine, [*keys, p.segment, p.repeat], "left").join(
        seg, [*keys, p.segment], "left").join(F.broadcast(top), list(keys), "left")
    return out_rows.withColumn(out, F.coalesce("__e2", "__e1", "__e0")).drop("__e2", "__e1", "__e0")
