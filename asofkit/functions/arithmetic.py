"""Scalar feature arithmetic. NULL in, NULL out; a zero denominator gives NULL."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def total_of(*parts: Column | str) -> Column:
    """Plain sum, so one missing part makes the total missing."""
    return reduce(add, [_c(p) for p in parts])


def share(numerator: Column | str, denominator: Column | str) -> Column:
    return F.try_divide(_c(numerator), _c(denominator))


def net(long_side: Column | str, short_side: Column | str) -> Column:
    return _c(long_side) - _c(short_side)


def slope_bps(short_end: Column | str, long_end: Column | str) -> Column:
    return (_c(long_end) - _c(short_end)) * 100


def butterfly_bps(short_end: Column | str, belly: Column | str, long_end: Column | str) -> Column:
    return (_c(belly) * 2 - _c(short_end) - _c(long_end)) * 100


def imbalance(long_parts: list[str], short_parts: list[str]) -> Column:
    return total_of(*long_parts) - total_of(*short_parts)


def pct_change(now: Column | str, before: Column | str) -> Column:
    return (F.try_divide(_c(now), _c(before)) - 1) * 100


def inventory_ratio(inventory_millions: Column | str, amount: Column | str) -> Column:
    """Inventory quoted in millions over an amount quoted in single units."""
    return F.try_divide(_c(inventory_millions) * 1_000_000, _c(amount))


def clip(value: Column | str, low: float, high: float) -> Column:
    """Clip to [low, high]; NULL stays NULL (least/greatest would skip it)."""
    v = _c(value)
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def was_clipped(value: Column | str, low: float, high: float) -> Column:
    v = _c(value)
    return (v < F.lit(low)) | (v > F.lit(high))


def identity_changed(before: Column | str, after: Column | str) -> Column:
    """Release identity between two cutoffs: nothing later -> false, only later -> true."""
    b, a = _c(before), _c(after)
    return F.when(a.isNull(), F.lit(False)).when(b.isNull(), F.lit(True)).otherwise(a != b)


def sorted_levels(columns: list[str]) -> list[Column]:
    """Row-wise ascending sort of quantile columns (removes crossings)."""
    ordered = F.array_sort(F.array(*[F.col(c) for c in columns]))
    return [ordered.getItem(i).alias(c) for i, c in enumerate(columns)]
