"""Stress labels: a training-only percentile of cross-fitted surprises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.folds import Pool, inner_test_rows, test_rows, walk_forward_pairs
from ..operators.quantiles import exact_quantiles
from ..operators.rolling import safe_trailing_mean
from ..session import materialise
from .surprise import apply_surprise, fit_surprise, group_sums_by_fold, group_sums_by_pair, surprise_cells

STRESS_PERCENTILE = 0.90


def with_safe_regime(df: DataFrame, p: Pool, out: str = "regime", n: int = 8) -> DataFrame:
    return safe_trailing_mean(df, by=[p.segment], value=p.value, key=p.key, cutoff=p.cutoff, safe=p.safe, on=p.on, n=n,
                              out=out, count_out=f"{out}_n")


def cross_fitted_surprise(df: DataFrame, folds: DataFrame, p: Pool, regime: str = "regime") -> DataFrame:
    """Outer-training rows scored by a fit on the earlier years of the same outer fold.

    Rows of a fold's first year, and rows without an outcome, have no surprise and no row here.
    """
    pairs = materialise(walk_forward_pairs(df, folds, p))
    keys = ["test_year", "inner_year"]
    sums = group_sums_by_pair(surprise_cells(df, p, regime), pairs, p)
    rows = inner_test_rows(df.where(F.col(p.value).isNotNull()), pairs, p)
    return apply_surprise(rows, sums, fit_surprise(sums, keys), p, regime, keys).where(F.col("surprise").isNotNull())


def thresholds(train_surprise: DataFrame, percentile: float = STRESS_PERCENTILE) -> DataFrame:
    q = exact_quantiles(train_surprise, by=["test_year"], value="surprise", probs=[percentile])
    return q.select("test_year", F.col("quantiles")[0].alias("threshold"))


def _labelled(df: DataFrame, folds: DataFrame, p: Pool, regime: str, percentile: float, also: Sequence[str] = ()) -> DataFrame:
    """Labels with further columns of their rows beside them."""
    train = materialise(cross_fitted_surprise(df, folds, p, regime).select("test_year", p.key, "surprise", *also))
    cut = materialise(thresholds(train, percentile))  # one row per fold
    sums = group_sums_by_fold(surprise_cells(df, p, regime), folds, p)
    test = apply_surprise(test_rows(df, folds, p), sums, fit_surprise(sums, ["test_year"]), p, regime, ["test_year"])
    cols = ["test_year", F.col(p.key).alias("event_key"), "surprise", *also]
    both = train.select(F.lit("train").alias("role"), *cols).unionByName(test.select(F.lit("test").alias("role"), *cols))
    return both.join(F.broadcast(cut), "test_year", "left").select(
        "test_year", "role", "event_key", "surprise", (F.col("surprise") >= F.col("threshold")).alias("label"), *also)


def stress_labels(df: DataFrame, folds: DataFrame, p: Pool, regime: str = "regime", percentile: float = STRESS_PERCENTILE) -> DataFrame:
    """(test_year, role, key, surprise, label). A missing surprise gives a missing label."""
    return _labelled(df, folds, p, regime, percentile)


def inner_holdout_labels(df: DataFrame, holdouts: DataFrame, folds: DataFrame, p: Pool, regime: str = "regime") -> DataFrame:
    """Labels for choosing hyperparameters: threshold and fits from the inner training rows
    only; the held-out year keeps only rows known at the outer origin."""
    usable = holdouts.where("usable").join(F.broadcast(folds.select("test_year", F.col("fit_origin").alias("__outer"))), "test_year")
    inner = materialise(usable.select(
        F.col("inner_year").alias("test_year"), F.least("inner_origin", "__outer").alias("fit_origin"),
        F.col("test_year").alias("outer_year"), F.col("__outer").alias("outer_origin")))
    labels = _labelled(df, inner.select("test_year", "fit_origin"), p, regime, STRESS_PERCENTILE, [p.safe])
    out = labels.join(F.broadcast(inner.drop("fit_origin")), "test_year")
    return out.where((F.col("role") == "train") | (F.col(p.safe) <= F.col("outer_origin"))).select(
        "outer_year", F.when(F.col("role") == "test", "validation").otherwise("train").alias("role"), "event_key", "label")


def percentile_thresholds(df: DataFrame, *, value: str, percentiles: Sequence[float] = (0.75, 0.80, 0.90, 0.95)) -> DataFrame:
    """(percentile, threshold, n_train, n_flagged, fraction_flagged) of one sample."""
    q = exact_quantiles(df, by=[], value=value, probs=list(percentiles))
    # One row with all thresholds beside every value, counted in one pass.
    rows = df.where(F.col(value).isNotNull()).select(value).join(F.broadcast(q), F.lit(True))
    counts = rows.agg(F.count("*").alias("n_train"), F.first("quantiles").alias("quantiles"), F.array(*[
        F.count_if(F.col(value) >= F.col("quantiles")[i]) for i in range(len(percentiles))]).alias("flagged"))
    each = counts.select("n_train", F.inline(F.array(*[
        F.struct(F.lit(float(x)).alias("percentile"), F.col("quantiles")[i].alias("threshold"), F.col("flagged")[i].alias("n_flagged"))
        for i, x in enumerate(percentiles)])))
    return each.where("n_train > 0").select("percentile", "threshold", "n_train", "n_flagged", (F.col("n_flagged") / F.col("n_train")).alias("fraction_flagged"))
