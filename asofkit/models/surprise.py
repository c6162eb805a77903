"""Expected share from a group mean plus two slopes, and the surprise against it.

The fit needs only sums per (fold, group), so folds of any nesting come from the same cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.folds import Pool, cells, cells_by_fold, cells_by_pair
from ..session import materialise

SUMS = ["n", "sy", "sx", "sxy", "sxx", "m", "my", "mx", "sr", "srr", "sry", "srx"]


def surprise_cells(df: DataFrame, p: Pool, regime: str) -> DataFrame:
    """Sums per (segment, repeat, year, safe date). x is the log amount, r the regime; the m*
    sums cover the rows that have a regime."""
    y, x, r = F.col(p.value), F.ln(p.amount), F.col(regime)
    have = r.isNotNull()
    known = lambda c: F.sum(F.when(have, c).otherwise(0.0))
    rows = df.where(F.col(p.value).isNotNull() & F.col(p.amount).isNotNull())
    return cells(rows, p, [p.segment, p.repeat], [
        F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(x).alias("sx"), F.sum(x * y).alias("sxy"),
        F.sum(x * x).alias("sxx"), F.count(r).alias("m"), known(y).alias("my"), known(x).alias("mx"),
        known(r).alias("sr"), known(r * r).alias("srr"), known(r * y).alias("sry"), known(r * x).alias("srx"),
    ])


def merged_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in SUMS]


def group_sums_by_fold(cell: DataFrame, folds: DataFrame, p: Pool) -> DataFrame:
    """Written: a few rows, read for the slopes and for the means."""
    return materialise(cells_by_fold(cell, folds, p, [p.segment, p.repeat], merged_sums()))


def group_sums_by_pair(cell: DataFrame, pairs: DataFrame, p: Pool) -> DataFrame:
    return materialise(cells_by_pair(cell, pairs, p, [p.segment, p.repeat], merged_sums()))


def fit_surprise(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of parameters per fold: centres, slopes, regime fallback and overall mean.

    Rows without a regime take the training mean of the regime (the overall mean when no row
    has one). Rank-deficient designs get the minimum-norm slopes.
    """
    total = sums.groupBy(*keys).agg(*merged_sums())
    ybar = F.col("sy") / F.col("n")
    total = total.withColumn("global_mean", ybar).withColumn(
        "regime_fallback", F.coalesce(F.try_divide("sr", "m"), ybar))
    joined = sums.join(total.select(*keys, "regime_fallback"), list(keys))
    filled = lambda known, gap: F.col(known) + F.col("regime_fallback") * gap
    gap_n, gap_y, gap_x = F.col("n") - F.col("m"), F.col("sy") - F.col("my"), F.col("sx") - F.col("mx")
    per_group = joined.withColumns({
        "__r": filled("sr", gap_n), "__ry": filled("sry", gap_y), "__rx": filled("srx", gap_x),
        "__rr": F.col("srr") + F.col("regime_fallback") * F.col("regime_fallback") * gap_n,
    })
    mean = F.col("sy") / F.col("n")
    fold = per_group.groupBy(*keys).agg(
        F.sum("n").alias("N"), F.sum("sx").alias("X"), F.sum("__r").alias("R"), F.sum("sxx").alias("XX"),
        F.sum("__rr").alias("RR"), F.sum("__rx").alias("RX"),
        F.sum(F.col("sxy") - mean * F.col("sx")).alias("b1"), F.sum(F.col("__ry") - mean * F.col("__r")).alias("b2"),
    )
    cx, cr = F.col("X") / F.col("N"), F.col("R") / F.col("N")
    fold = fold.withColumns({
        "amount_center": cx, "regime_center": cr,
        "s11": F.greatest(F.col("XX") - F.col("X") * cx, F.lit(0.0)), "s22": F.greatest(F.col("RR") - F.col("R") * cr, F.lit(0.0)),
        "s12": F.col("RX") - F.col("X") * cr,
    })
    det, trace = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12"), F.col("s11") + F.col("s22")
    full_rank = det > F.lit(1e-12) * trace * trace
    b1, b2 = F.col("b1"), F.col("b2")
    flat = trace * trace
    slope1 = F.when(full_rank, F.try_divide(F.col("s22") * b1 - F.col("s12") * b2, det)).otherwise(
        F.coalesce(F.try_divide(F.col("s11") * b1 + F.col("s12") * b2, flat), F.lit(0.0)))
    slope2 = F.when(full_rank, F.try_divide(F.col("s11") * b2 - F.col("s12") * b1, det)).otherwise(
        F.coalesce(F.try_divide(F.col("s12") * b1 + F.col("s22") * b2, flat), F.lit(0.0)))
    return fold.select(*keys, "amount_center", "regime_center", slope1.alias("amount_slope"), slope2.alias("regime_slope"),
                       F.col("N").alias("n_train")).join(total.select(*keys, "global_mean", "regime_fallback"), list(keys))


def apply_surprise(rows: DataFrame, sums: DataFrame, params: DataFrame, p: Pool, regime: str, keys: Sequence[str]) -> DataFrame:
    """Rows with `expected` and `surprise`. Parameter tables hold one row per fold or fold x group; they are written first, so that
    they go to the rows: shuffled by so few keys, a fold's rows of a group would all lie in one task."""
    means = materialise(sums.select(*keys, p.segment, p.repeat, (F.col("sy") / F.col("n")).alias("__gm")))
    out = rows.join(materialise(params), list(keys), "left").join(means, [*keys, p.segment, p.repeat], "left")
    expected = (
        F.coalesce("__gm", "global_mean") + F.col("amount_slope") * (F.ln(p.amount) - F.col("amount_center"))
        + F.col("regime_slope") * (F.coalesce(F.col(regime), F.col("regime_fallback")) - F.col("regime_center"))
    )
    out = out.withColumn("expected", expected)
    return out.withColumn("surprise", F.col(p.value) - F.col("expected")).select(
        *rows.columns, "expected", "surprise")


def walk_forward_surprise(df: DataFrame, folds: DataFrame, p: Pool, regime: str) -> DataFrame:
    """Every test year scored by a fit on its fold's training rows."""
    from ..operators.folds import test_rows

    sums = group_sums_by_fold(surprise_cells(df, p, regime), folds, p)
    return apply_surprise(test_rows(df, folds, p), sums, fit_surprise(sums, ["test_year"]), p, regime, ["test_year"])


def descriptive_surprise(df: DataFrame, p: Pool, regime: str, *, min_train_years: int = 1) -> DataFrame:
    """Year filter only, no availability rule; for profiles, never for forecasts."""
    years = df.groupBy(F.col(p.year).alias("test_year")).agg(F.lit("9999-12-31").cast("date").alias("fit_origin"))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.orderBy("test_year"))
    folds = years.withColumn("__n", nth).where(F.col("__n") > min_train_years).drop("__n")
    return walk_forward_surprise(df, folds, p, regime)
