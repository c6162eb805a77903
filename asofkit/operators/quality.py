"""Data-quality, coverage and profile tables. Each is one aggregation over the input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import leading_reason
from .quantiles import exact_quantiles


def missing_fractions(df: DataFrame, fields: Sequence[str], scopes: dict[str, Column]) -> DataFrame:
    """(scope, field, n, fraction_missing) for several row scopes in one pass."""
    aggs = []
    for scope, where in scopes.items():
        inside = F.coalesce(where, F.lit(False))
        aggs.append(F.count_if(inside).alias(f"{scope}|n"))
        aggs += [F.count_if(inside & F.col(f).isNull()).alias(f"{scope}|{f}") for f in fields]
    row = df.agg(*aggs)
    items = F.array(*[
        F.struct(F.lit(s).alias("scope"), F.lit(f).alias("field"), F.col(f"`{s}|n`").alias("n"),
                 F.try_divide(F.col(f"`{s}|{f}`"), F.col(f"`{s}|n`")).alias("fraction_missing"))
        for s in scopes for f in fields
    ])
    return row.select(F.inline(items))


def coverage_counts(df: DataFrame, *, groups: Sequence[str], members: DataFrame | None = None) -> DataFrame:
    """Counts per group; with `members` absent groups are listed with zero."""
    counts = df.groupBy(*groups).agg(F.count("*").alias("n"))
    if members is None:
        return counts
    return F.broadcast(members).join(counts, list(groups), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def flag_split(df: DataFrame, *, group: str, flag: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count_if(~F.col(flag)).alias("n_first"), F.count_if(F.col(flag)).alias("n_repeat"))


def exclusion_accounting(df: DataFrame, *, excluded: Column, classes: dict[str, Column]) -> DataFrame:
    """Excluded rows by class and how many no class accounts for."""
    ex = F.coalesce(excluded, F.lit(False))
    row = df.agg(
        F.count_if(ex).alias("n_excluded"),
        *[F.count_if(ex & F.coalesce(c, F.lit(False))).alias(n) for n, c in classes.items()],
    )
    known = sum((F.col(n) for n in classes), F.lit(0))
    return row.withColumn("n_unaccounted", F.col("n_excluded") - known)


def join_coverage(
    joined: DataFrame, *, by: Sequence[str], matched: str, age: str, series: Sequence[str]
) -> DataFrame:
    """Per group: rows, matched rows, median age and available values per series."""
    counts = joined.groupBy(*by).agg(
        F.count("*").alias("n_events"), F.count_if(matched).alias("n_matched"),
        *[F.count(c).alias(f"{c}_n_available") for c in series],
    )
    medians = exact_quantiles(joined, by=by, value=age, probs=[0.5]).select(
        *[F.col(c).alias(f"__m_{c}") for c in by], F.col("quantiles")[0].alias("median_age"))
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__m_{c}"))
    return counts.join(medians, condition, "left").drop(*[f"__m_{c}" for c in by])


def missing_reason_counts(df: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """(series, reason, n): value counts of the leading word of each series' reason."""
    items = F.array(*[F.struct(F.lit(s).alias("series"), F.col(c).alias("text")) for s, c in reasons.items()])
    long = df.select(F.inline(items)).withColumn("reason", leading_reason("text"))
    return long.where(F.col("reason").isNotNull()).groupBy("series", "reason").agg(F.count("*").alias("n"))


def series_coverage(long: DataFrame, *, keys: Sequence[str], observed: str, missing: str) -> DataFrame:
    n_missing = F.count_if(missing)
    return long.groupBy(*keys).agg(
        F.min(observed).alias("first_observed"), F.max(observed).alias("last_observed"),
        F.count("*").alias("n_observations"), n_missing.alias("n_missing"),
        (n_missing / F.count("*") * 100).alias("pct_missing"),
    )


def state_reconciliation(df: DataFrame, states: Sequence[tuple[str, Column]], *, other: str = "unclassified") -> DataFrame:
    """Exclusive states in order; every row falls into exactly one."""
    ladder = F.lit(other)
    for name, where in reversed(list(states)):
        ladder = F.when(where, F.lit(name)).otherwise(ladder)
    return df.groupBy(ladder.alias("state")).agg(F.count("*").alias("n"))


def distribution_profile(df: DataFrame, *, value: str, scopes: dict[str, Column]) -> DataFrame:
    """(scope_kind, scope_value, n, mean, std, min, median, max) for several groupings at once.

    Rows are tagged with each grouping's value and aggregated once; medians are exact.
    """
    tags = F.array(*[F.struct(F.lit(k).alias("scope_kind"), c.cast("string").alias("scope_value")) for k, c in scopes.items()])
    long = df.where(F.col(value).isNotNull()).select(F.col(value).alias("__x"), F.inline(tags))
    long = long.where(F.col("scope_value").isNotNull())
    keys = ["scope_kind", "scope_value"]
    stats = long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("__x").alias("mean"), F.stddev_samp("__x").alias("std"),
        F.min("__x").alias("min"), F.max("__x").alias("max"))
    medians = exact_quantiles(long, by=keys, value="__x", probs=[0.5])
    return stats.join(medians.select(*keys, F.col("quantiles")[0].alias("median")), keys)


def reconcile_ratio(df: DataFrame, *, reported: str, calculated: str, digits: int = 2) -> DataFrame:
    """Reported against recomputed ratio after half-even rounding of the recomputed one."""
    both = df.where(F.col(reported).isNotNull() & F.col(calculated).isNotNull())
    diff = F.abs(F.col(reported) - F.bround(F.col(calculated), digits))
    return both.agg(
        F.count("*").alias("n_compared"), F.max(diff).alias("max_abs_diff"), F.avg(diff).alias("mean_abs_diff"),
        F.count_if(diff <= 0.01).alias("n_within_0_01"), F.count_if(diff <= 0.02).alias("n_within_0_02"),
        F.count_if(diff > 0.02).alias("n_over_0_02"),
    )


def eligibility_summary(df: DataFrame, *, on: str, start: str, settled: Column, special: Column, small: Column) -> DataFrame:
    """Counts before and after each sample rule."""
    inside = F.col(on) >= F.lit(start).cast("date")
    s, x = F.coalesce(settled, F.lit(False)), F.coalesce(special, F.lit(False))
    return df.agg(
        F.count_if(~inside).alias("n_before_start"), F.count_if(inside & s).alias("n_settled"),
        F.count_if(inside & ~s).alias("n_pending"), F.count_if(inside & s & x).alias("n_special"),
        F.count_if(inside & s & ~x).alias("n_modelling"), F.count_if(inside & s & small).alias("n_small"),
    )


def tag_samples(df: DataFrame, *, on: str, start: str, amount: str, small_below: float, special: Column, tag: str) -> DataFrame:
    """Rows from the start date on, with the small flag and the special tag."""
    return df.where(F.col(on) >= F.lit(start).cast("date")).withColumns({
        "is_small": F.col(amount) < small_below,
        "special_tag": F.when(special, F.lit(tag)),
    })
