"""The backtest over the supplied tables: folds, forecasts, intervals, labels, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..models import baselines as bl, intervals as iv, labels as la, shrinkage as sh
from ..operators import folds as fo
from ..session import materialise, staged
from . import analogs as an

POOL = fo.Pool()
CUTOFFS = {"announcement": "announcement_cutoff", "pre_event": "pre_event_cutoff"}
MEANS = {"global_mean": "global_mean", "segment_mean": "segment_mean", "segment_repeat_mean": "segment_repeat_mean",
         "recent_frozen": "recent_frozen", "shrinkage": "shrinkage"}
MODELS = {v: {**MEANS, "recent_adaptive": f"{v}__adaptive"} for v in CUTOFFS}


def folds(pool: DataFrame) -> DataFrame:
    return fo.fold_origins(pool, POOL, first_year=an.COMPLETE_YEARS[0], last_complete=an.COMPLETE_YEARS[1])


def staged_pool(spark, sf_dir) -> DataFrame:
    """The modelling pool, written once: folds, fits and test rows all read it."""
    return staged(spark, "pool", sf_dir, lambda: an.pool(spark, sf_dir))


def regime_pool(spark, sf_dir) -> DataFrame:
    """The pool with each row's safe trailing mean, written once."""
    return staged(spark, "regime_pool", sf_dir, lambda: la.with_safe_regime(staged_pool(spark, sf_dir), POOL))


def forecast_rows(spark, sf_dir) -> DataFrame:
    """Test rows of all folds with every baseline side by side."""
    pool = staged_pool(spark, sf_dir)
    f = folds(pool)
    rows = bl.baseline_forecasts(pool, f, POOL, cutoffs=CUTOFFS)
    return sh.shrinkage_forecasts(rows, sh.shrunk_means(pool, f, POOL), POOL)


def predictions(spark, sf_dir, places: int | None = None) -> DataFrame:
    """Long prediction table: both cutoffs, six models, five folds. The side-by-side rows are
    written once; every metric table reads them. `places` rounds outcome and forecasts there,
    once an event instead of once a model and cutoff."""
    columns = sorted({c for of in MODELS.values() for c in of.values()})
    rows = forecast_rows(spark, sf_dir).select(POOL.key, "test_year", "is_provisional", POOL.segment, POOL.repeat, POOL.value, *columns)
    if places is not None:
        rows = rows.withColumns({c: F.round(c, places) for c in (POOL.value, *columns)})
    return bl.to_long(materialise(rows), MODELS, POOL)


def interval_rows(spark, sf_dir) -> DataFrame:
    """Test rows with residual-quantile intervals around the frozen forecast."""
    pool = staged_pool(spark, sf_dir)
    f = folds(pool)
    rows = bl.mean_forecasts(pool, f, POOL).join(bl.recent_means(pool, f, POOL), ["test_year", "segment"], "left")
    rows = rows.withColumn("point", F.coalesce("recent_mean", "global_mean"))
    offsets = iv.residual_offsets(materialise(iv.walk_forward_residuals(pool, f, POOL)), POOL)
    out = iv.interval_forecasts(rows, offsets, POOL, point="point")
    return out.withColumnRenamed("primary_share", "actual")


LEVELS = {q: iv.level_column(q) for q in iv.LEVELS}
INTERVALS = {"50": ("q25", "q75"), "80": ("q10", "q90"), "90": ("q05", "q95")}


def scored_documents(spark, sf_dir) -> DataFrame:
    """labels beside a fixed score of the document: the classifier stand-in."""
    lab = an.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    doc = an.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 2000), 3)
    return lab.join(doc, "doc_id").select("doc_id", "lang", F.when(F.col("toxic") == 0, F.col("label")).alias("label"), score.alias("score"))
