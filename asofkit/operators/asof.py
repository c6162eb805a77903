"""Backward as-of joins.

Releases are few per day, events are many. The match therefore runs on the *distinct*
(group, cutoff day) pairs of the events, which is bounded by groups x days whatever the
event count is, and the events then pick their match up by an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise

_PROBE = 1


def _check_clash(left: DataFrame, names: Sequence[str]) -> None:
    clash = sorted(set(left.columns) & set(names))
    if clash:
        raise ValueError(f"as-of join: columns already present on the left side: {clash}")


def asof_lookup(
    days: DataFrame, releases: DataFrame, *, day: str, safe: str, tie: Sequence[str],
    by: Sequence[str] = (), strict: bool = False, out: str = "release",
) -> DataFrame:
    """For every (by, day) row the latest release with safe <= day (or < day when strict).

    Releases sharing a safe date are settled by the largest `tie`. Both inputs are small
    (one row per group and day), so one window per group is cheap.
    """
    payload = [c for c in releases.columns if c not in by]
    usable = releases.where(F.col(safe).isNotNull())
    for c in tie:
        usable = usable.where(F.col(c).isNotNull())
    per_day = usable.groupBy(*by, F.col(safe).alias("__t")).agg(
        F.max_by(F.struct(*payload), F.struct(*[F.col(c) for c in tie])).alias(out)
    )
    release_side, probe_side = (_PROBE, 0) if strict else (0, _PROBE)
    left = per_day.withColumn("__side", F.lit(release_side)).withColumn("__probe", F.lit(False))
    right = days.where(F.col(day).isNotNull()).select(
        *by, F.col(day).alias("__t"), F.lit(None).cast(per_day.schema[out].dataType).alias(out),
        F.lit(probe_side).alias("__side"), F.lit(True).alias("__probe"),
    )
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.select(right.columns).unionByName(right)
    return (
        both.withColumn(out, F.last(out, ignorenulls=True).over(w))
        .where(F.col("__probe") & F.col(out).isNotNull())
        .select(*by, F.col("__t").alias(day), out)
    )


def asof_join(
    events: DataFrame, releases: DataFrame, *, cutoff: str, safe: str, tie: Sequence[str],
    by: Sequence[str] = (), strict: bool = False, matched: str = "asof_matched", keep: Sequence[str] | None = None, days: DataFrame | None = None,
) -> DataFrame:
    """Attach to every event the latest release safely known at its cutoff.

    Left rows are never dropped or repeated; a NULL cutoff stays unmatched; releases without
    a safe date are ignored. Inclusive by default, strict for "earlier than this day" joins.
    The lookup is written first: while it is small (days, or a few groups x days) the planner
    sends it to every task and the events are not shuffled by their days. `days` may give the
    events' distinct (by, cutoff) pairs, so that several joins do not each look for them.
    """
    names = list(keep) if keep is not None else [c for c in releases.columns if c not in by]
    _check_clash(events, [*names, matched])
    right = releases.select(*dict.fromkeys([*by, *names, safe, *tie]))
    probes = events.select(*by, cutoff).distinct() if days is None else days
    lookup = asof_lookup(probes.withColumnRenamed(cutoff, "__day"), right, day="__day", safe=safe, tie=tie, by=by, strict=strict, out="__release")
    keyed = materialise(lookup.select(*[F.col(c).alias(f"__by_{c}") for c in by], "__day", "__release"))
    condition = F.col(cutoff) == F.col("__day")
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    joined = events.join(keyed, condition, "left")
    return joined.select(
        *[F.col(c) for c in events.columns],
        *[F.col(f"__release.{c}").alias(c) for c in names],
        F.col("__release").isNotNull().alias(matched),
    )


def asof_join_timestamps(
    events: DataFrame, releases: DataFrame, *, at: str, safe: str, by: Sequence[str], tie: Sequence[str],
    bucket: str = "day", strict: bool = False, matched: str = "asof_matched",
) -> DataFrame:
    """Keyed as-of join on timestamps that survives a hot key.

    The timeline is cut into buckets. Inside a bucket both sides are merged by a window over
    (key, bucket); across buckets only the last release of each bucket is carried. A key with
    a third of all rows is thus spread over as many tasks as it has buckets.
    """
    names = [c for c in releases.columns if c not in by]
    _check_clash(events, [*names, matched])
    usable = releases.where(F.col(safe).isNotNull())
    packed = usable.select(*by, F.col(safe).alias("__t"), F.struct(*names).alias("__release"),
                           F.struct(*tie).alias("__tie"))
    packed = packed.withColumn("__bucket", F.date_trunc(bucket, "__t"))
    last_in_bucket = packed.groupBy(*by, "__bucket").agg(
        F.max_by("__release", F.struct("__t", "__tie")).alias("__release")
    )
    event_bucket = F.date_trunc(bucket, F.col(at))
    probes = events.where(F.col(at).isNotNull()).select(*by, event_bucket.alias("__bucket")).distinct()
    order = Window.partitionBy(*by).orderBy("__bucket", "__is_probe").rowsBetween(Window.unboundedPreceding, 0)
    # probes sort before the releases of their own bucket, so the carry is strictly earlier
    carry = (
        last_in_bucket.withColumn("__is_probe", F.lit(1))
        .unionByName(probes.withColumn("__release", F.lit(None).cast(packed.schema["__release"].dataType))
                     .withColumn("__is_probe", F.lit(0)))
        .withColumn("__carry", F.last("__release", ignorenulls=True).over(order))
        .where(F.col("__is_probe") == 0).select(*by, "__bucket", "__carry")
    )
    left = events.select(
        *by, F.col(at).alias("__t"), F.struct(*[F.col(c) for c in events.columns]).alias("__event"),
    ).withColumn("__bucket", F.date_trunc(bucket, F.col("__t")))
    carry = carry.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__bucket").alias("__kb"), "__carry")
    same = F.col("__bucket") == F.col("__kb")
    for c in by:  # a missing key is a key, as in the windows
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    left = left.join(carry, same, "left").drop("__kb", *[f"__k_{c}" for c in by])
    release_side, probe_side = (1, 0) if strict else (0, 1)
    merged = left.withColumn("__side", F.lit(probe_side)).unionByName(
        packed.withColumn("__side", F.lit(release_side)), allowMissingColumns=True
    )
    w = Window.partitionBy(*by, "__bucket").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("__found", F.last("__release", ignorenulls=True).over(w)).where(
        F.col("__event").isNotNull()
    )
    best = F.coalesce("__found", "__carry")
    return found.withColumn("__best", best).select(
        "__event.*", *[F.col(f"__best.{c}").alias(c) for c in names], F.col("__best").isNotNull().alias(matched)
    )


def melt_cutoffs(events: DataFrame, cutoffs: dict[str, str], view: str = "cutoff_view", out: str = "cutoff") -> DataFrame:
    """One row per (event, cutoff view), so one as-of join serves every cutoff."""
    pairs = F.array(*[F.struct(F.lit(n).alias(view), F.col(c).alias(out)) for n, c in cutoffs.items()])
    others = [c for c in events.columns if c not in cutoffs.values()]
    return events.select(*others, F.inline(pairs))


def asof_join_cutoffs(
    events: DataFrame, releases: DataFrame, *, cutoffs: dict[str, str], safe: str, tie: Sequence[str],
    values: Sequence[str], by: Sequence[str] = (),
) -> DataFrame:
    """Releases known at several cutoffs, as `{view}__{value}` columns; no row is repeated.

    One lookup table serves all cutoffs, so the events are never reshuffled to come back to
    one row each.
    """
    right = releases.select(*dict.fromkeys([*by, *values, safe, *tie]))
    days = F.explode(F.array(*[F.col(c) for c in cutoffs.values()])).alias("__day")
    lookup = materialise(asof_lookup(events.select(*by, days).distinct(), right, day="__day", safe=safe, tie=tie, by=by, out="__release"))
    out = events
    for view, column in cutoffs.items():
        keyed = lookup.select(*[F.col(c).alias(f"__by_{c}") for c in by], "__day",
                              *[F.col(f"__release.{v}").alias(f"{view}__{v}") for v in values])
        condition = F.col(column) == F.col("__day")
        for c in by:
            condition = condition & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
        out = out.join(keyed, condition, "left").drop("__day", *[f"__by_{c}" for c in by])
    return out


def vintage_snapshot(vintages: DataFrame, *, by: Sequence[str], observed: str, value: str, yoy_lag: int) -> DataFrame:
    """Per vintage: latest non-missing observation and the value `yoy_lag` grid rows before it."""
    w = Window.partitionBy(*by).orderBy(observed)
    lagged = vintages.select(
        *by, observed, value, F.lag(value, yoy_lag).over(w).alias("__yoy"), F.lag(observed, yoy_lag).over(w).alias("__yoy_obs")
    )
    latest = lagged.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.max_by(F.struct(F.col(observed).alias("current_observed"), F.col(value).alias("current_value"),
                          F.col("__yoy_obs").alias("yoy_observed"), F.col("__yoy").alias("yoy_value")), F.col(observed)).alias("__latest")
    )
    return latest.select(*by, "__latest.*")


def vintage_asof_join(
    events: DataFrame, index: DataFrame, snapshot: DataFrame, *, cutoff: str, vintage: Sequence[str],
    safe: str, tie: Sequence[str], by: Sequence[str] = (), expected: str | None = None,
) -> DataFrame:
    """Two-step vintage join: pick the vintage known at the cutoff, then read its snapshot.

    A vintage with no observation still matches (with a reason) and hides older vintages.
    """
    releases = index.join(snapshot, [*by, *vintage], "left")
    out = asof_join(events, releases, cutoff=cutoff, safe=safe, tie=tie, by=by, matched="vintage_matched")
    has_value = F.col("vintage_matched") & F.col("current_value").isNotNull()
    out = (
        out.withColumn("vintage_lag_days", F.date_diff(F.col(cutoff), F.col(safe)))
        .withColumn("observation_age_days", F.date_diff(F.col(cutoff), F.col("current_observed")))
        .withColumn("level_yoy_change", F.col("current_value") - F.col("yoy_value"))
        .withColumn("pct_yoy_change", (F.try_divide(F.col("current_value"), F.col("yoy_value")) - 1) * 100)
        .withColumn(
            "missing_reason",
            F.when(~F.col("vintage_matched"), F.lit("no_vintage_before_cutoff"))
            .when(~has_value, F.lit("vintage_without_observation")),
        )
    )
    if expected:
        out = out.withColumn(
            "source_gap", F.coalesce(has_value & (F.col("current_observed") < F.col(expected)), F.lit(False))
        )
    return out
