"""A fit and transform protocol over folds and over folds inside folds, for models whose fit is mergeable.

An estimator reduces rows to cells (its groups x year x safe date) of partial sums, which may come from plain aggregates or from
`mapInArrow`. Cells are matched to folds and merged, so rows are neither copied per fold nor grouped per fold. Fitted parameters are a
relation keyed by the fold, and transforming is a join with them.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.folds import Pool, cells, cells_by_fold, cells_by_pair, inner_test_rows, test_rows, walk_forward_pairs
from . import shrinkage as sh, surprise as su

FOLD, PAIR = ("test_year",), ("test_year", "inner_year")


class Estimator(ABC):
    """`keys` below are the columns that name a fold: FOLD, or PAIR for folds inside folds."""

    groups: Sequence[str] = ()

    @abstractmethod
    def cells(self, rows: DataFrame, p: Pool) -> DataFrame:
        """Partial sums per (groups, year, safe date). Rows that the fit can not use are left out here."""

    @abstractmethod
    def merged(self) -> list[Column]:
        """Aggregates that add up cells to the columns that `fit` reads."""

    @abstractmethod
    def fit(self, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Parameters per (keys) or (keys, groups) from merged cells with the columns (keys, groups, sums)."""

    @abstractmethod
    def transform(self, rows: DataFrame, params: DataFrame, p: Pool, keys: Sequence[str]) -> DataFrame:
        """`rows` (with `keys`) beside their forecast; a row whose fold or group has no parameters stays, with NULL or a fallback."""


def fit_folds(df: DataFrame, folds: DataFrame, p: Pool, est: Estimator) -> DataFrame:
    return est.fit(cells_by_fold(est.cells(df, p), folds, p, list(est.groups), est.merged()), FOLD)


def fit_pairs(df: DataFrame, pairs: DataFrame, p: Pool, est: Estimator) -> DataFrame:
    return est.fit(cells_by_pair(est.cells(df, p), pairs, p, list(est.groups), est.merged()), PAIR)


def walk_forward(df: DataFrame, folds: DataFrame, p: Pool, est: Estimator) -> DataFrame:
    """The test rows of every fold, transformed by the fit on the fold's training rows."""
    return est.transform(test_rows(df, folds, p), fit_folds(df, folds, p, est), p, FOLD)


def walk_forward_inside(df: DataFrame, folds: DataFrame, p: Pool, est: Estimator) -> DataFrame:
    """The training rows of every fold, each year (but the first) transformed by a fit on the earlier years of the same fold."""
    pairs = walk_forward_pairs(df, folds, p)
    return est.transform(inner_test_rows(df, pairs, p), fit_pairs(df, pairs, p, est), p, PAIR)


class GroupMoments(Estimator):
    """Base for models of a group's count, sum and sum of squares of the outcome."""

    def __init__(self, groups: Sequence[str]):
        self.groups = tuple(groups)

    def cells(self, rows: DataFrame, p: Pool) -> DataFrame:
        v = F.col(p.value)
        return cells(rows.where(v.isNotNull()), p, list(self.groups), [F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")])

    def merged(self) -> list[Column]:
        return [F.sum(c).alias(c) for c in ("n", "s", "ss")]


class ShrunkMeans(GroupMoments):
    """Two-level shrinkage of (segment, repeat) means; `shrinkage` is the forecast."""

    def __init__(self, p: Pool):
        super().__init__((p.segment, p.repeat))
        self.pool = p

    def fit(self, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
        return sh.shrink(sums, self.pool, keys)

    def transform(self, rows: DataFrame, params: DataFrame, p: Pool, keys: Sequence[str]) -> DataFrame:
        return sh.shrinkage_forecasts(rows, params, p, keys=keys)


class Surprise(Estimator):
    """Group mean plus two slopes; `expected` is the forecast, `surprise` the outcome less it."""

    def __init__(self, p: Pool, regime: str):
        self.groups, self.regime, self.pool = (p.segment, p.repeat), regime, p

    def cells(self, rows: DataFrame, p: Pool) -> DataFrame:
        return su.surprise_cells(rows, p, self.regime)

    def merged(self) -> list[Column]:
        return su.merged_sums()

    def fit(self, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
        """One relation: a fold's parameters repeated beside the sums of each of its groups."""
        return sums.join(su.fit_surprise(sums, keys), list(keys))

    def transform(self, rows: DataFrame, params: DataFrame, p: Pool, keys: Sequence[str]) -> DataFrame:
        shared = [c for c in params.columns if c not in {*keys, *self.groups, *su.SUMS}]
        fold = params.groupBy(*keys).agg(*[F.first(c).alias(c) for c in shared])  # equal in all groups of a fold
        return su.apply_surprise(rows, params.select(*keys, *self.groups, *su.SUMS), fold, p, self.regime, list(keys))
