"""Leakage and integrity gates. Counts come from one job each; only counts reach the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F


def forbidden_columns(columns: Sequence[str], *, exact: Sequence[str], patterns: Sequence[str], allow: Sequence[str] = ()) -> dict[str, list[str]]:
    """Outcome columns among predictors, by name and by pattern (renamed outcomes)."""
    hits = sorted({c for c in columns if c not in allow and any(re.search(p, c, re.IGNORECASE) for p in patterns)})
    return {"exact": sorted(set(columns) & set(exact)), "pattern": hits}


def availability_summary(joined: DataFrame, *, cutoff: str, by: str, sources: dict[str, str], key: str = "event_key") -> DataFrame:
    """(view, source, n_matched, n_violations, max_lag_days) in one pass; `late_keys` names the offenders.

    A violation is a release whose safe date lies after the cutoff it was joined at.
    """
    items = F.array(*[F.struct(F.lit(n).alias("source"), F.col(c).alias("__safe")) for n, c in sources.items()])
    long = joined.select(by, key, F.col(cutoff).alias("__cutoff"), F.inline(items))
    late = F.col("__safe") > F.col("__cutoff")
    return long.groupBy(by, "source").agg(
        F.count("__safe").alias("n_matched"), F.count_if(late).alias("n_violations"),
        F.max(F.date_diff("__cutoff", "__safe")).alias("max_lag_days"),
    )


def late_keys(joined: DataFrame, *, cutoff: str, by: str, sources: dict[str, str], key: str = "event_key") -> DataFrame:
    """(view, source, key, days_late): one row per release that was joined before it was safe."""
    items = F.array(*[F.struct(F.lit(n).alias("source"), F.col(c).alias("__safe")) for n, c in sources.items()])
    long = joined.select(by, key, F.col(cutoff).alias("__cutoff"), F.inline(items))
    return long.where(F.col("__safe") > F.col("__cutoff")).select(by, "source", key, F.date_diff("__safe", "__cutoff").alias("days_late"))


def monotonicity(table: DataFrame, *, cutoffs: Sequence[str], earlier: str, later: str) -> DataFrame:
    """A later cutoff must never select an earlier release, nor lose one.

    `cutoffs` names the two cutoffs in order. Rows whose later cutoff lies before the earlier one are
    counted as reversed: nothing can be said about their releases, so the other counts leave them out.
    """
    first, second = (F.col(c) for c in cutoffs)
    ordered = F.coalesce(second >= first, F.lit(False))
    return table.agg(
        F.count("*").alias("n_events"), F.count_if(second < first).alias("n_cutoffs_reversed"),
        F.count_if(ordered & (F.col(later) < F.col(earlier))).alias("n_earlier"),
        F.count_if(ordered & F.col(earlier).isNotNull() & F.col(later).isNull()).alias("n_lost"))


def key_audit(table: DataFrame, canonical: DataFrame, *, key: Sequence[str], unique: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, repeated unique keys, and keys only on one side, in one row."""
    per_key = table.groupBy(*unique).agg(F.count("*").alias("__c"))
    sizes = per_key.groupBy(*key).agg(F.sum("__c").alias("__rows"), F.count_if(F.col("__c") > 1).alias("__dup"))
    other = canonical.select(*key).distinct().withColumn("__there", F.lit(True))
    both = sizes.join(other, list(key), "full_outer")
    return both.agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("n_rows"), F.count("__rows").alias("n_keys"),
        F.coalesce(F.sum("__dup"), F.lit(0)).alias("n_duplicate_keys"),
        F.count_if(F.col("__there").isNull()).alias("n_extra"), F.count_if(F.col("__rows").isNull()).alias("n_missing"))


def one_to_one(left: DataFrame, right: DataFrame, *, key: str) -> DataFrame:
    """Inner join whose right side must be unique by key and whose sides must hold the same keys; anything else raises."""
    audit = key_audit(left, right, key=[key], unique=[key]).first()
    if audit["n_extra"] or audit["n_missing"]:
        raise ValueError(f"key sets differ: {audit['n_extra']} keys without a partner, {audit['n_missing']} missing")
    once = F.assert_true(F.count("*") == 1, F.concat(F.lit("repeated key "), F.col(key).cast("string")))
    values = [c for c in right.columns if c != key]
    checked = right.groupBy(key).agg(*[F.first(c).alias(c) for c in values], once.alias("__ok"))
    return left.join(checked.where(F.col("__ok").isNull()).drop("__ok"), key)


def changed_rows(base: DataFrame, other: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Rows of `base` that `other` lacks or holds with another value. Extra keys are allowed."""
    body = [c for c in base.columns if c not in key]
    a = base.select(*key, F.struct(*body).alias("__a"))
    b = other.select(*key, F.struct(*body).alias("__b"))
    return a.join(b, list(key), "left").agg(F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_changed"))


def require_equal(base: DataFrame, other: DataFrame, *, key: Sequence[str], what: str) -> None:
    """Raise when a perturbed rebuild changed any row of the base."""
    n = changed_rows(base, other, key=key).first()["n_changed"]
    if n:
        raise AssertionError(f"{what}: {n} rows changed")


def input_order_invariance(build: Callable[..., DataFrame], inputs: dict[str, DataFrame], *, key: Sequence[str], seed: int = 7) -> None:
    """Shuffle each input in turn; the result must not change."""
    base = build(**inputs)
    for name in inputs:
        mixed = {**inputs, name: inputs[name].repartition(5).orderBy(F.rand(seed))}
        require_equal(base, build(**mixed), key=key, what=f"order of {name}")


def future_row_invariance(build: Callable[..., DataFrame], inputs: dict[str, DataFrame], futures: dict[str, DataFrame], *, key: Sequence[str]) -> None:
    """Append far-future rows to each input in turn; history must not change."""
    base = build(**inputs)
    for name, rows in futures.items():
        require_equal(base, build(**{**inputs, name: inputs[name].unionByName(rows, allowMissingColumns=True)}), key=key,
                      what=f"future rows in {name}")


def outcome_poisoning(build: Callable[..., DataFrame], inputs: dict[str, DataFrame], *, table: str, outcomes: Sequence[str], key: Sequence[str]) -> None:
    """Scramble outcome columns of one input; predictors must not change."""
    base = build(**inputs)
    bad = inputs[table].withColumns({c: F.hash(F.col(c)).cast("double") for c in outcomes})
    require_equal(base, build(**{**inputs, table: bad}), key=key, what="poisoned outcomes")


def matrix_gates(*, key: Sequence[str], required: Sequence[str], contract: Sequence[str], forbidden: Sequence[str]) -> list[Callable[[DataFrame], str | None]]:
    """Gates for a staged predictor matrix: columns equal the contract both ways, no outcome
    column, no missing identifier, no repeated key."""

    def columns(df: DataFrame) -> str | None:
        have, want = set(df.columns), set(contract)
        return f"columns differ from the contract: {sorted(have ^ want)}" if have != want else None

    def outcomes(df: DataFrame) -> str | None:
        found = forbidden_columns(df.columns, exact=forbidden, patterns=[])["exact"]
        return f"outcome columns present: {found}" if found else None

    def identifiers(df: DataFrame) -> str | None:
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
        bad = [c for c in required if row[c]]
        return f"missing identifiers in {bad}" if bad else None

    def repeated(df: DataFrame) -> str | None:
        n = df.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).first()["n"]
        return f"{n} repeated keys" if n else None

    return [columns, outcomes, identifiers, repeated]
