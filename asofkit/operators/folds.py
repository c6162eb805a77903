"""Rolling-origin folds as a relation.

A fold is one row (test_year, fit_origin). Training membership is a range condition against
that row, so every fold of a backtest comes out of one plan. Models whose fit is a sum never
expand rows by folds: rows are first reduced to cells (group, year, safe date), whose number
depends on days and groups only, and the cells are matched to folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.digest import finish_digest, limb_sums, merge_limbs


@dataclass(frozen=True)
class Pool:
    """Column names of a modelling pool."""

    key: str = "event_key"
    segment: str = "segment"
    repeat: str = "is_repeat"
    on: str = "event_date"
    year: str = "event_year"
    cutoff: str = "announcement_cutoff"
    safe: str = "result_safe_date"
    value: str = "primary_share"
    amount: str = "amount"


MIN_INNER_YEARS = 2
MIN_INNER_TRAIN_ROWS = 50


def fold_origins(df: DataFrame, p: Pool, *, first_year: int, last_complete: int) -> DataFrame:
    """(test_year, fit_origin, is_provisional): origin is the earliest announcement of the
    test year. One row per year, so the relation is always small enough to broadcast."""
    years = df.where(F.col(p.year) >= first_year).groupBy(F.col(p.year).alias("test_year"))
    return years.agg(F.min(p.cutoff).alias("fit_origin")).withColumn(
        "is_provisional", F.col("test_year") > last_complete)


def _in_train(p: Pool, year: str = "test_year", origin: str = "fit_origin") -> Column:
    return (F.col(p.year) < F.col(year)) & (F.col(p.safe) <= F.col(origin))


def train_rows(df: DataFrame, folds: DataFrame, p: Pool) -> DataFrame:
    """Rows of every fold's training set. Only for models that need the rows themselves."""
    return df.join(F.broadcast(folds.select("test_year", "fit_origin")), _in_train(p))


def test_rows(df: DataFrame, folds: DataFrame, p: Pool) -> DataFrame:
    small = folds.withColumn("__y", F.col("test_year"))
    return df.join(F.broadcast(small), F.col(p.year) == F.col("__y")).drop("__y")


def fold_rows(df: DataFrame, folds: DataFrame, p: Pool) -> DataFrame:
    """(test_year, role, key) of all folds in one relation."""
    role = F.when(F.col(p.year) == F.col("test_year"), "test").when(_in_train(p), "train").otherwise("dropped")
    joined = df.join(F.broadcast(folds.select("test_year", "fit_origin")), F.col(p.year) <= F.col("test_year"))
    return joined.select("test_year", role.alias("role"), p.key)


def cells(df: DataFrame, p: Pool, groups: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Rows reduced to (groups, year, safe date)."""
    return df.groupBy(*groups, p.year, p.safe).agg(*aggs)


def cells_by_fold(cell: DataFrame, folds: DataFrame, p: Pool, groups: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Training aggregates of every fold from the cells."""
    joined = cell.join(F.broadcast(folds.select("test_year", "fit_origin")), _in_train(p))
    return joined.groupBy("test_year", *groups).agg(*aggs)


def fold_manifest(df: DataFrame, folds: DataFrame, p: Pool) -> DataFrame:
    """Per fold: origin, sizes, rows dropped by the availability rule, digests of both key sets."""
    hashed = df.withColumn("__h", F.sha2(F.col(p.key).cast("string"), 256))
    cell = cells(hashed, p, [], limb_sums(F.col("__h")))
    joined = cell.join(F.broadcast(folds), F.col(p.year) <= F.col("test_year"))
    role = F.when(F.col(p.year) == F.col("test_year"), "test").when(_in_train(p), "train").otherwise("dropped")
    by_role = joined.groupBy("test_year", "fit_origin", "is_provisional", role.alias("role")).agg(*merge_limbs())
    digest = finish_digest()
    pick = lambda r, c: F.max(F.when(F.col("role") == r, c))
    return by_role.groupBy("test_year", "fit_origin", "is_provisional").agg(
        F.coalesce(pick("train", F.col("limb0")), F.lit(0)).alias("n_train"),
        F.coalesce(pick("test", F.col("limb0")), F.lit(0)).alias("n_test"),
        F.coalesce(pick("dropped", F.col("limb0")), F.lit(0)).alias("n_dropped"),
        pick("train", digest).alias("train_digest"), pick("test", digest).alias("test_digest"),
    )


def fold_violations(members: DataFrame, df: DataFrame, folds: DataFrame, p: Pool) -> DataFrame:
    """Per fold: training rows that are late, and keys on both sides. Both must be zero."""
    facts = df.select(p.key, F.col(p.safe).alias("__safe"))
    train = members.where(F.col("role") == "train").join(facts, p.key).join(
        F.broadcast(folds.select("test_year", "fit_origin")), "test_year")
    late = train.groupBy("test_year").agg(F.count_if(F.col("__safe") > F.col("fit_origin")).alias("n_late"))
    test = members.where(F.col("role") == "test").select("test_year", p.key)
    both = members.where(F.col("role") == "train").join(test, ["test_year", p.key], "left_semi")
    overlap = both.groupBy("test_year").agg(F.count("*").alias("n_overlap"))
    return folds.select("test_year").join(late, "test_year", "left").join(overlap, "test_year", "left").select(
        "test_year", F.coalesce("n_late", F.lit(0)).alias("n_late"), F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"))


# ---------------------------------------------------------------- folds inside folds

def walk_forward_pairs(df: DataFrame, folds: DataFrame, p: Pool) -> DataFrame:
    """(test_year, fit_origin, inner_year, inner_origin) for each outer fold and each year of
    its training set but the earliest. The inner origin is the earliest announcement among
    the outer training rows of that year."""
    cell = cells(df, p, [], [F.min(p.cutoff).alias("__c")])
    joined = cell.join(F.broadcast(folds.select("test_year", "fit_origin")), _in_train(p))
    inner = joined.groupBy("test_year", "fit_origin", F.col(p.year).alias("inner_year")).agg(
        F.min("__c").alias("inner_origin"))
    first = Window.partitionBy("test_year")
    return inner.withColumn("__first", F.min("inner_year").over(first)).where(
        F.col("inner_year") > F.col("__first")).drop("__first")


def _in_inner_train(p: Pool) -> Column:
    return (F.col(p.year) < F.col("inner_year")) & (F.col(p.safe) <= F.least("fit_origin", "inner_origin"))


def cells_by_pair(cell: DataFrame, pairs: DataFrame, p: Pool, groups: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return cell.join(F.broadcast(pairs), _in_inner_train(p)).groupBy("test_year", "inner_year", *groups).agg(*aggs)


def inner_test_rows(df: DataFrame, pairs: DataFrame, p: Pool) -> DataFrame:
    """Outer training rows of each inner year."""
    return df.join(F.broadcast(pairs), (F.col(p.year) == F.col("inner_year")) & (F.col(p.safe) <= F.col("fit_origin")))


def inner_holdouts(df: DataFrame, folds: DataFrame, p: Pool) -> DataFrame:
    """Last training year of each fold as validation, with sizes and whether it is usable."""
    cell = cells(df, p, [], [F.count("*").alias("__n"), F.min(p.cutoff).alias("__c")])
    outer = cell.join(F.broadcast(folds.select("test_year", "fit_origin")), _in_train(p))
    span = outer.groupBy("test_year").agg(
        F.max(p.year).alias("inner_year"), F.count_distinct(p.year).alias("n_years"))
    joined = outer.join(F.broadcast(span), "test_year")
    origin = F.min(F.when(F.col(p.year) == F.col("inner_year"), F.col("__c"))).over(Window.partitionBy("test_year"))
    joined = joined.withColumn("inner_origin", origin)
    out = joined.groupBy("test_year", "n_years", "inner_year", "inner_origin").agg(
        F.coalesce(F.sum(F.when(_in_train(p, "inner_year", "inner_origin"), F.col("__n"))), F.lit(0)).alias("n_inner_train"),
        F.coalesce(F.sum(F.when(F.col(p.year) == F.col("inner_year"), F.col("__n"))), F.lit(0)).alias("n_inner_validation"),
    )
    reason = F.when(F.col("n_years") < MIN_INNER_YEARS, "too_few_years").when(
        F.col("n_inner_train") < MIN_INNER_TRAIN_ROWS, "too_few_rows")
    return out.withColumn("reason_unusable", reason).withColumn("usable", reason.isNull())


# ---------------------------------------------------------------- folds as marks on rows

@dataclass(frozen=True)
class FoldSpan:
    """One fold and its inner holdout (None where unusable)."""

    test_year: int
    fit_origin: date
    inner_year: int | None = None
    inner_origin: date | None = None


def fold_spans(folds: DataFrame, holdouts: DataFrame | None = None) -> list[FoldSpan]:
    """The fold relations, one row a year, as values that row conditions are built from."""
    inner = {} if holdouts is None else {r["test_year"]: (r["inner_year"], r["inner_origin"]) for r in holdouts.where("usable").select(
        "test_year", "inner_year", "inner_origin").collect()}
    return [FoldSpan(r["test_year"], r["fit_origin"], *inner.get(r["test_year"], ())) for r in folds.select("test_year", "fit_origin").orderBy("test_year").collect()]


def _marks(found: Sequence[Column]) -> Column:
    """The numbers that are not NULL, as an array. Taking NULL out as a set is compiled; array_compact calls a function per element."""
    return F.array_except(F.array(*found).cast("array<int>"), F.array(F.lit(None).cast("int")))


def trains(spans: Sequence[FoldSpan], p: Pool) -> Column:
    """The fits that a row trains, as an array: test_year for the fold's own fit, -test_year for the one on its inner training rows.

    Rows stay single however many folds there are.
    """
    outer = [F.when((F.col(p.year) < s.test_year) & (F.col(p.safe) <= s.fit_origin), F.lit(s.test_year)) for s in spans]
    inner = [F.when((F.col(p.year) < s.inner_year) & (F.col(p.safe) <= min(s.inner_origin, s.fit_origin)), F.lit(-s.test_year)) for s in spans if s.inner_year]
    return _marks([*outer, *inner])


def validates(spans: Sequence[FoldSpan], p: Pool) -> Column:
    """The folds whose inner holdout validates on this row."""
    held = [F.when((F.col(p.year) == s.inner_year) & (F.col(p.safe) <= s.fit_origin), F.lit(s.test_year)) for s in spans if s.inner_year]
    return _marks(held)
