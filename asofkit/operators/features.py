"""Event features made from joined releases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arithmetic import identity_changed
from .asof import asof_join


def case_of(selector: str, values: dict[str, Column | str]) -> Column:
    """Value by the row's own selector; NULL for unmapped selectors."""
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(F.col(selector) == name, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def matched_pick(df: DataFrame, *, segment: str, mapping: dict[str, str], order: Sequence[str], suffix: str = "") -> DataFrame:
    """The row's own label among wide columns, with the labels just below and above it."""
    at = {label: i for i, label in enumerate(order)}
    column = lambda label: F.col(f"`{label}{suffix}`")
    below = {s: order[at[v] - 1] for s, v in mapping.items() if at[v] > 0}
    above = {s: order[at[v] + 1] for s, v in mapping.items() if at[v] + 1 < len(order)}
    cols: dict[str, Column] = {}
    for name, labels in (("matched", mapping), ("lower", below), ("higher", above)):
        cols[f"{name}_label"] = case_of(segment, dict(labels)).cast("string")
        cols[f"{name}_level"] = case_of(segment, {s: column(v) for s, v in labels.items()}).cast("double")
    return df.withColumns(cols)


def missing_reason(matched: str, value: str, observed: str, *, regime_start: str | None = None,
                   none: str = "no_release_before_cutoff", source: str = "source_reported_missing") -> Column:
    """Why a joined value is missing: nothing published yet, series not started, or missing at source."""
    gone = F.col(value).isNull()
    early = F.col(observed) < F.lit(regime_start).cast("date") if regime_start else F.lit(False)
    return (
        F.when(~F.col(matched), F.lit(none))
        .when(early & (gone | F.lit(regime_start is not None)), F.lit("regime_not_started"))
        .when(gone, F.lit(source))
    )


def matched_positions(
    df: DataFrame, *, segment: str, primary: dict[str, str], all_codes: dict[str, Sequence[str]], presence: str,
    values: Sequence[str], matched: str,
) -> DataFrame:
    """Primary contract's values plus two separate axes.

    Axis one: was any report available at the cutoff. Axis two: does the segment have a
    direct contract, and did that contract carry data. Column names are `{code}__{value}`.
    """
    code = case_of(segment, dict(primary)).cast("string")
    others = {s: ",".join(c for c in codes if c != primary.get(s)) for s, codes in all_codes.items()}
    present = case_of(segment, {s: F.col(f"`{c}__{presence}`") for s, c in primary.items() if f"{c}__{presence}" in df.columns})
    have = F.col(matched)
    status = F.when(code.isNull(), "no_direct_contract").when(~have | present.isNull(), "mapped_but_unavailable").otherwise("available")
    reason = F.when(code.isNull(), "no_direct_contract").when(~have, "no_report_before_cutoff")
    picks = {
        f"matched_{v}": case_of(segment, {s: F.col(f"`{c}__{v}`") for s, c in primary.items() if f"{c}__{v}" in df.columns}).cast("double")
        for v in values
    }
    return df.withColumns({
        "direct_code": code, "secondary_codes": case_of(segment, {s: v for s, v in others.items() if v}).cast("string"),
        "report_available": have, "source_status": F.when(have, "matched").otherwise("no_report_before_cutoff"),
        "direct_status": status, "direct_missing_reason": reason, **picks,
    })


def naive_versus_safe(events: DataFrame, releases: DataFrame, *, cutoff: str, safe: str, naive: str, observed: str) -> DataFrame:
    """Events for which joining on the publication date would have used a release too early."""
    rel = releases.select(observed, safe, naive)
    good = asof_join(events, rel.select(F.col(observed).alias("safe_observed"), F.col(safe).alias("__s")), cutoff=cutoff, safe="__s",
                     tie=["safe_observed"], matched="__ms", keep=["safe_observed"])
    both = asof_join(good, rel.select(F.col(observed).alias("naive_observed"), F.col(naive).alias("__p")), cutoff=cutoff, safe="__p",
                     tie=["naive_observed"], matched="__mn", keep=["naive_observed"])
    differs = F.col("naive_observed").isNotNull() & ~F.col("naive_observed").eqNullSafe(F.col("safe_observed"))
    return both.where(differs).drop("__ms", "__mn")


def cutoff_updates(table: DataFrame, *, key: Sequence[str], first: str, second: str, cutoffs: dict[str, str],
                   identities: dict[str, str], changes: Sequence[str]) -> DataFrame:
    """What changed between two cutoffs: gap in days, new releases, value changes."""
    return table.select(
        *key, F.date_diff(cutoffs[second], cutoffs[first]).alias("gap_days"),
        *[identity_changed(f"{first}__{c}", f"{second}__{c}").alias(out) for out, c in identities.items()],
        *[(F.col(f"{second}__{c}") - F.col(f"{first}__{c}")).alias(f"{c}_change") for c in changes],
    )


def worked_example(
    events: DataFrame, releases: DataFrame, *, key: str, on: str, first: str, second: str, safe: str, observed: str,
    values: Sequence[str], n: int = 4,
) -> DataFrame:
    """The last event matched at both cutoffs, its n latest candidate releases, and why each
    was or was not chosen."""
    rel = releases.select(observed, safe)
    hit = asof_join(events, rel.select(F.col(observed).alias("__o1"), F.col(safe).alias("__s1")), cutoff=first, safe="__s1", tie=["__o1"],
                    matched="__m1", keep=["__o1"])
    hit = asof_join(hit, rel.select(F.col(observed).alias("__o2"), F.col(safe).alias("__s2")), cutoff=second, safe="__s2", tie=["__o2"],
                    matched="__m2", keep=["__o2"])
    one = hit.where("__m1 AND __m2").orderBy(F.col(on).desc(), F.col(key).desc()).limit(1)
    cand = releases.select(observed, safe, *values).join(F.broadcast(one), F.col(observed) <= F.col(on))
    a, b = F.col(observed) == F.col("__o1"), F.col(observed) == F.col("__o2")
    why = F.when(a | b, F.lit(None)).when(F.col(safe) > F.col(first), "not_yet_safe").otherwise("newer_release_preferred")
    return cand.orderBy(F.col(observed).desc()).limit(n).select(
        key, observed, safe, *values, a.alias("chosen_announcement"), b.alias("chosen_pre_event"), why.alias("rejected_because"))
