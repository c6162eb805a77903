"""Mean and recent-history forecasts for every fold of a backtest in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.folds import Pool, cells, cells_by_fold, cells_by_pair, test_rows
from ..operators.rolling import last_n_mean, safe_trailing_means
from ..session import materialise

PREDICTION_COLUMNS = ["event_key", "cutoff_view", "model_id", "test_year", "is_provisional", "segment", "is_repeat",
                      "actual", "forecast"]


def mean_levels(df: DataFrame, folds: DataFrame, p: Pool) -> DataFrame:
    """Training means at three levels per fold: (segment, repeat), segment and all.

    `level` is 2, 1 or 0; missing keys are NULL. One pass over the rows, then cells only.
    """
    scored = df.where(F.col(p.value).isNotNull())
    cell = cells(scored, p, [p.segment, p.repeat], [F.count("*").alias("__n"), F.sum(p.value).alias("__s")])
    joined = cells_by_fold(cell, folds, p, [p.segment, p.repeat], [F.sum("__n").alias("__n"), F.sum("__s").alias("__s")])
    sets = [["test_year", p.segment, p.repeat], ["test_year", p.segment], ["test_year"]]
    return joined.groupingSets(sets, "test_year", p.segment, p.repeat).agg(
        (F.lit(2) - F.grouping(p.segment) - F.grouping(p.repeat)).cast("int").alias("level"),
        F.sum("__n").alias("n"), (F.sum("__s") / F.sum("__n")).alias("mean"),
    )


def _with_level(rows: DataFrame, levels: DataFrame, level: int, keys: Sequence[str], out: str) -> DataFrame:
    """Left join of one level. The table of levels is written, so its size picks the join: a small one goes to every task."""
    right = levels.where(F.col("level") == level).select("test_year", *keys, F.col("mean").alias(out))
    return rows.join(right, ["test_year", *keys], "left")


def mean_forecasts(df: DataFrame, folds: DataFrame, p: Pool) -> DataFrame:
    """Test rows with the three mean forecasts, each falling back to the next wider level."""
    levels = materialise(mean_levels(df, folds, p))
    rows = test_rows(df, folds, p)
    rows = _with_level(rows, levels, 0, [], "global_mean")
    rows = _with_level(rows, levels, 1, [p.segment], "__m1")
    rows = _with_level(rows, levels, 2, [p.segment, p.repeat], "__m2")
    return rows.withColumn("segment_mean", F.coalesce("__m1", "global_mean")).withColumn(
        "segment_repeat_mean", F.coalesce("__m2", "__m1", "global_mean")).drop("__m1", "__m2")


def recent_candidates(df: DataFrame, p: Pool, n: int = 8) -> DataFrame:
    """The n latest scored rows of each (segment, year, safe date). Whatever a fold's origin,
    its last n training rows per segment are among them."""
    newest = Window.partitionBy(p.segment, p.year, p.safe).orderBy(F.col(p.on).desc(), F.col(p.key).desc())
    return (
        df.where(F.col(p.value).isNotNull()).select(p.segment, p.year, p.safe, p.on, p.key, p.value)
        .withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= n).drop("__rn")
    )


def recent_means(df: DataFrame, folds: DataFrame, p: Pool, n: int = 8) -> DataFrame:
    """Mean of the last n training rows per (fold, segment)."""
    joined = recent_candidates(df, p, n).join(
        F.broadcast(folds.select("test_year", "fit_origin")),
        (F.col(p.year) < F.col("test_year")) & (F.col(p.safe) <= F.col("fit_origin")))
    return last_n_mean(joined, by=["test_year", p.segment], order=[p.on, p.key], value=p.value, n=n,
                       out="recent_mean", count_out="n_recent")


def recent_means_by_pair(df: DataFrame, pairs: DataFrame, p: Pool, n: int = 8) -> DataFrame:
    """The same for folds inside folds."""
    joined = recent_candidates(df, p, n).join(
        F.broadcast(pairs),
        (F.col(p.year) < F.col("inner_year")) & (F.col(p.safe) <= F.least("fit_origin", "inner_origin")))
    return last_n_mean(joined, by=["test_year", "inner_year", p.segment], order=[p.on, p.key], value=p.value, n=n,
                       out="recent_mean", count_out="n_recent")


def global_means_by_pair(df: DataFrame, pairs: DataFrame, p: Pool) -> DataFrame:
    scored = df.where(F.col(p.value).isNotNull())
    cell = cells(scored, p, [], [F.count("*").alias("__n"), F.sum(p.value).alias("__s")])
    return cells_by_pair(cell, pairs, p, [], [(F.sum("__s") / F.sum("__n")).alias("global_mean")])


def baseline_forecasts(df: DataFrame, folds: DataFrame, p: Pool, *, cutoffs: dict[str, str], n: int = 8) -> DataFrame:
    """Test rows with global, segment, segment x repeat and frozen recent forecasts, and one
    adaptive forecast per cutoff view (`{view}__adaptive`).

    The adaptive candidate pool is every row; each row takes the latest n results safe at its
    own cutoff, and falls back to its fold's training mean. A repeated key raises: its forecasts
    could not be told apart.
    """
    if not df.groupBy(p.key).count().where("count > 1").isEmpty():
        raise ValueError(f"{p.key} is not unique")
    adaptive = safe_trailing_means(df, by=[p.segment], value=p.value, key=p.key, cutoffs=cutoffs, safe=p.safe, on=p.on, n=n)
    rows = mean_forecasts(adaptive, folds, p)
    rows = rows.join(materialise(recent_means(df, folds, p, n)), ["test_year", p.segment], "left")
    return rows.withColumns({
        "recent_frozen": F.coalesce("recent_mean", "global_mean"),
        **{f"{v}__adaptive": F.coalesce(f"{v}__mean", "global_mean") for v in cutoffs},
    }).drop("recent_mean")


def to_long(rows: DataFrame, models: dict[str, dict[str, str]], p: Pool) -> DataFrame:
    """One row per (key, cutoff view, model): the prediction table. models: view -> model -> column."""
    items = F.array(*[
        F.struct(F.lit(view).alias("cutoff_view"), F.lit(m).alias("model_id"), F.col(c).alias("forecast"))
        for view, columns in models.items() for m, c in columns.items()
    ])
    return rows.select(
        F.col(p.key).alias("event_key"), "test_year", "is_provisional", F.col(p.segment).alias("segment"),
        F.col(p.repeat).alias("is_repeat"), F.col(p.value).alias("actual"), F.inline(items),
    ).select(*PREDICTION_COLUMNS)
