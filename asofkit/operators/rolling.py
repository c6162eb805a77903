"""Past-only window features.

Two families. Series features run on long series tables (one row per series and date), so a
window partition holds one series' dates. Event features first reduce events to one slot per
(group, date), or carry a bounded tail between date chunks, so a group that owns a third of
all events is still split over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import asof_join_cutoffs


# ---------------------------------------------------------------- series features

def _series_chunk(df: DataFrame, on: str) -> Column:
    """Default pieces of a series: calendar years of a day or time, else 4,096 steps of a number."""
    kind = df.schema[on].dataType.typeName()
    return F.year(on) if kind in ("date", "timestamp", "timestamp_ntz") else F.floor(F.col(on) / 4096)


def _in_chunks(df: DataFrame, by: Sequence[str], on: str, value: str, n: int, chunk: Column | None):
    """`df` with the n rows before each chunk put in front of it (`__before`), and the window over one chunk.

    A window that looks back n rows at most gives every row of a chunk what the window over the whole series gives, and a long series
    is as many tasks as it has chunks. `chunk` must not decrease along `on`.
    """
    marked = df.withColumn("__chunk", chunk if chunk is not None else _series_chunk(df, on))
    tails = _carried_tails(marked.select(*by, "__chunk", on, value), by, [on], F.struct(on, value), n)
    before = tails.select(*by, "__chunk", F.explode("__carry").alias("__row")).select(*by, "__chunk", f"__row.{on}", f"__row.{value}", F.lit(True).alias("__before"))
    rows = marked.withColumn("__before", F.lit(False)).unionByName(before, allowMissingColumns=True)
    return rows, Window.partitionBy(*by, "__chunk").orderBy(on)


def _out_of_chunks(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("__before")).drop("__chunk", "__before")


def lag_changes(df: DataFrame, *, by: Sequence[str], on: str, value: str, lags: dict[int, str], chunk: Column | None = None) -> DataFrame:
    """x - x[n observed rows earlier] for each n. Series run in chunks, see `_in_chunks`."""
    rows, w = _in_chunks(df, by, on, value, max(lags), chunk)
    return _out_of_chunks(rows.select("*", *[(F.col(value) - F.lag(value, n).over(w)).alias(out) for n, out in lags.items()]))


def past_zscore(
    df: DataFrame, *, by: Sequence[str], on: str, value: str, out: str, window: int = 52, min_periods: int = 13, chunk: Column | None = None,
) -> DataFrame:
    """(x - mean) / std over up to `window` strictly earlier rows; NULL before min_periods. Series run in chunks."""
    rows, inside = _in_chunks(df, by, on, value, window, chunk)
    w = inside.rowsBetween(-window, -1)
    enough = F.count(value).over(w) >= min_periods
    score = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return _out_of_chunks(rows.withColumn(out, F.when(enough, score)))


def realised_volatility(
    df: DataFrame, *, by: Sequence[str], on: str, value: str, windows: dict[int, str], scale: float = 100.0, chunk: Column | None = None,
) -> DataFrame:
    """Std of the n changes before today's, all n needed. Series run in chunks."""
    rows, w = _in_chunks(df, by, on, value, max(windows) + 1, chunk)
    step = rows.withColumn("__step", (F.col(value) - F.lag(value, 1).over(w)) * scale)
    cols = []
    for n, out in windows.items():
        frame = w.rowsBetween(-n, -1)
        cols.append(F.when(F.count("__step").over(frame) >= n, F.stddev_samp("__step").over(frame)).alias(out))
    return _out_of_chunks(step.select("*", *cols).drop("__step"))


# ---------------------------------------------------------------- one slot per (group, date)

def _join_slots(df: DataFrame, slots: DataFrame, keys: Sequence[str], outs: Sequence[str]) -> DataFrame:
    """Null-safe left join of slot results back to the rows."""
    right = slots.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *outs)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(right, condition, "left").drop(*[f"__k_{k}" for k in keys])


def slot_features(
    df: DataFrame, *, on: str, by: Sequence[str] = (), value: str | None = None, sums: dict[int, str] | None = None,
    flag: str | None = None, count_out: str | None = None, tie: Sequence[str] = (), previous: dict[str, str] | None = None,
) -> DataFrame:
    """Features of a group's earlier dates, from one aggregation to a slot per (group, date).

    sums: sum of `value` over the w slots before today, per w. flag: flagged rows on earlier
    dates. previous: values of the latest row of the slot before today. Rows sharing a day
    see the same past and never each other.
    """
    aggs, w = [], Window.partitionBy(*by).orderBy(on)
    picks: list[Column] = []
    outs: list[str] = []
    if sums:
        aggs.append(F.coalesce(F.sum(value), F.lit(0.0)).alias("__sum"))
        picks += [F.sum("__sum").over(w.rowsBetween(-n, -1)).alias(out) for n, out in sums.items()]
        outs += list(sums.values())
    if flag:
        aggs.append(F.count_if(flag).alias("__n"))
        picks.append(F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(count_out))
        outs.append(count_out)
    if previous:
        aggs.append(F.max_by(F.struct(*previous), F.struct(*tie)).alias("__last"))
        picks += [F.lag(F.col(f"__last.{c}"), 1).over(w).alias(out) for c, out in previous.items()]
        outs += list(previous.values())
    slots = df.groupBy(*by, on).agg(*aggs).select(*by, on, *picks)
    return _join_slots(df, slots, [*by, on], outs)


def distinct_date_sum(
    df: DataFrame, *, on: str, value: str, windows: dict[int, str], by: Sequence[str] = ()
) -> DataFrame:
    """Sum over the previous w distinct dates of the group, today excluded. An all-missing
    day counts as a slot worth zero."""
    return slot_features(df, on=on, by=by, value=value, sums=windows)


def prior_flag_count(df: DataFrame, *, by: Sequence[str], on: str, flag: str, out: str) -> DataFrame:
    """Flagged rows of the same key on strictly earlier dates; 0 at first."""
    return slot_features(df, on=on, by=by, flag=flag, count_out=out)


def previous_in_group(
    df: DataFrame, *, by: Sequence[str], on: str, tie: Sequence[str], take: dict[str, str]
) -> DataFrame:
    """Values of the latest strictly earlier row of the group; same-day rows never match.

    Ties inside the earlier day go to the largest `tie`.
    """
    return slot_features(df, on=on, by=by, tie=tie, previous=take)


def trailing_days_mean(
    df: DataFrame, *, on: str, value: str, out: str, days: int = 365, by: Sequence[str] = ()
) -> DataFrame:
    """Mean over the last `days` calendar days, today included, from per-day sums."""
    slots = df.groupBy(*by, on).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    slots = slots.withColumn("__d", F.unix_date(on))
    w = Window.partitionBy(*by).orderBy("__d").rangeBetween(-(days - 1), 0)
    slots = slots.select(*by, on, F.try_divide(F.sum("__s").over(w), F.sum("__n").over(w)).alias(out))
    return _join_slots(df, slots, [*by, on], [out])


# ---------------------------------------------------------------- bounded history in row order

def _carried_tails(marked: DataFrame, by: Sequence[str], order: Sequence[str], item: Column, n: int) -> DataFrame:
    """(by, __chunk, __carry): the n rows before each chunk, oldest first. Every chunk sends
    on at most n rows; the row limit is applied before the shuffle."""
    newest = Window.partitionBy(*by, "__chunk").orderBy(*[F.col(c).desc() for c in order])
    tails = (
        marked.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= n)
        .groupBy(*by, "__chunk")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__rn")).alias("__pos"), item.alias("item")))),
                         lambda s: s["item"]).alias("__tail"))
    )
    earlier = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(-n, -1)
    before = F.flatten(F.collect_list("__tail").over(earlier))
    return tails.select(*by, "__chunk", F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), n).alias("__carry"))


def preceding_rows(
    df: DataFrame, *, by: Sequence[str], order: Sequence[str], take: Sequence[str], n: int,
    chunk: Column | None = None, out: str = "history",
) -> DataFrame:
    """Attach the n rows before each row of its group as an array, oldest first.

    `chunk` must not decrease along `order`; it defaults to the first order column. Only the
    last n rows of every chunk travel to later chunks, so no task needs a whole group.
    `order` must end in a unique key.
    """
    marked = df.withColumn("__chunk", chunk if chunk is not None else F.col(order[0]))
    item = F.struct(*[F.col(c) for c in take])
    carries = _carried_tails(marked.select(*dict.fromkeys([*by, "__chunk", *order, *take])), by, order, item, n)
    rows = _join_slots(marked, carries, [*by, "__chunk"], ["__carry"])
    local = Window.partitionBy(*by, "__chunk").orderBy(*order).rowsBetween(-n, -1)
    rows = rows.withColumn("__all", F.concat("__carry", F.collect_list(item).over(local)))
    size = F.size("__all")
    return rows.withColumn(
        out, F.slice("__all", F.greatest(size - n + 1, F.lit(1)), n)
    ).drop("__chunk", "__carry", "__all")


def array_mean(items: Column, field: str) -> Column:
    """Mean of a field over an array of structs, missing values skipped; NULL when none."""
    values = F.filter(F.transform(items, lambda s: s[field]), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(values))


def order_trailing_mean(
    df: DataFrame, *, by: Sequence[str], order: Sequence[str], value: str, out: str, window: int = 8, chunk: Column | None = None,
) -> DataFrame:
    """Mean of the `window` rows before this one in (date, key) order, missing values skipped.

    Order-safe only: it ignores when each earlier result became known. Sums run inside date
    chunks; the first rows of a chunk add sums of the rows carried from before it.
    """
    marked = df.withColumn("__chunk", chunk if chunk is not None else F.col(order[0]))
    narrow = marked.select(*dict.fromkeys([*by, "__chunk", *order, value]))
    carries = _carried_tails(narrow, by, order, F.col(value), window)
    # entry k: sum and count of the last k carried values
    last = lambda k: F.filter(F.slice("__carry", F.greatest(F.size("__carry") - k + 1, F.lit(1)), k), lambda x: x.isNotNull())
    steps = F.sequence(F.lit(0), F.lit(window))
    sums = F.transform(steps, lambda k: F.aggregate(last(k), F.lit(0.0), lambda acc, x: acc + x))
    counts = F.transform(steps, lambda k: F.size(last(k)))
    carries = carries.select(*by, "__chunk", sums.alias("__cs"), counts.alias("__cn"))
    rows = _join_slots(marked, carries, [*by, "__chunk"], ["__cs", "__cn"])
    inside = Window.partitionBy(*by, "__chunk").orderBy(*order)
    frame = inside.rowsBetween(-window, -1)
    short = F.greatest(F.lit(window) - (F.row_number().over(inside) - 1), F.lit(0))
    total = F.coalesce(F.sum(value).over(frame), F.lit(0.0)) + F.element_at("__cs", short + 1)
    number = F.count(value).over(frame) + F.element_at("__cn", short + 1)
    return rows.withColumn(out, F.try_divide(total, number)).drop("__chunk", "__cs", "__cn")


def safe_trailing_means(
    pool: DataFrame, *, by: Sequence[str], value: str, key: str, cutoffs: dict[str, str], safe: str, on: str, n: int = 8,
) -> DataFrame:
    """Mean over the n latest same-group results known at each row's own cutoff, for several
    cutoffs at once: `{view}__mean` and `{view}__n`.

    A candidate needs a value and safe date <= cutoff (equality counts). The row itself is
    taken out *after* the n latest are chosen.

    Per (group, safe date) only the n latest candidates survive (a group-limited window, so
    each map task forwards at most n rows per day); the running list of n is then built over
    days and looked up by an as-of join on distinct (group, cutoff) pairs.
    """
    newest = Window.partitionBy(*by, safe).orderBy(F.col(on).desc(), F.col(key).desc())
    top = (
        pool.where(F.col(value).isNotNull() & F.col(safe).isNotNull())
        .select(*by, safe, on, key, value)
        .withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= n)
    )
    item = F.struct((-F.col("__rn")).alias("pos"), F.col(key).alias("k"), F.col(value).alias("v"))
    per_day = top.groupBy(*by, safe).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    running = Window.partitionBy(*by).orderBy(safe).rowsBetween(-(n - 1), 0)
    per_day = per_day.withColumn("__all", F.flatten(F.collect_list("__items").over(running)))
    per_day = per_day.select(
        *by, F.col(safe).alias("__known"),
        F.slice("__all", F.greatest(F.size("__all") - n + 1, F.lit(1)), n).alias("last"))
    per_day = per_day.select("*", array_mean(F.col("last"), "v").alias("mean"), F.size("last").alias("n"))
    joined = asof_join_cutoffs(pool, per_day, cutoffs=cutoffs, safe="__known", tie=["__known"], by=by, values=["last", "mean", "n"])
    outs = []
    for view, cutoff in cutoffs.items():
        # a row can only be among its own candidates when its result was safe at its cutoff
        own = F.coalesce(F.col(value).isNotNull() & (F.col(safe) <= F.col(cutoff)), F.lit(False))
        others = F.filter(F.col(f"{view}__last"), lambda s: s["k"] != F.col(key))
        outs.append(F.when(own, array_mean(others, "v")).otherwise(F.col(f"{view}__mean")).alias(f"{view}__mean"))
        outs.append(F.when(own, F.size(others)).otherwise(F.coalesce(f"{view}__n", F.lit(0))).alias(f"{view}__n"))
    return joined.select(*pool.columns, *outs)


def safe_trailing_mean(
    pool: DataFrame, *, by: Sequence[str], value: str, key: str, cutoff: str, safe: str, on: str,
    n: int = 8, out: str | None = None, count_out: str | None = None,
) -> DataFrame:
    """The same for one cutoff, under the names given."""
    out = out or f"{value}_safe_trailing_mean"
    count_out = count_out or f"{value}_safe_trailing_n"
    if {out, count_out} & set(pool.columns):
        raise ValueError(f"safe_trailing_mean: {out} or {count_out} already present")
    found = safe_trailing_means(pool, by=by, value=value, key=key, cutoffs={"at": cutoff}, safe=safe, on=on, n=n)
    return found.withColumnsRenamed({"at__mean": out, "at__n": count_out})


def last_n_mean(
    df: DataFrame, *, by: Sequence[str], order: Sequence[str], value: str, n: int, out: str, count_out: str
) -> DataFrame:
    """Mean of the last n rows per group; the row limit is applied before the shuffle."""
    newest = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return (
        df.where(F.col(value).isNotNull()).select(*by, *order, value)
        .withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= n)
        .groupBy(*by).agg(F.avg(value).alias(out), F.count(value).alias(count_out))
    )


def availability_violations(
    df: DataFrame, *, by: Sequence[str], order: Sequence[str], safe: str, cutoffs: dict[str, str],
    key: str, window: int = 8, describe: Sequence[str] = (), chunk: Column | None = None,
) -> DataFrame:
    """Earlier rows of the group whose result was not yet safe at this row's cutoff.

    One row per (event, cutoff view, lag) with the negative gap in days.
    """
    take = list(dict.fromkeys([safe, *order, *describe]))
    marked = df.withColumn("__chunk", chunk if chunk is not None else F.col(order[0]))
    marked = marked.select(*dict.fromkeys([*by, "__chunk", key, *take, *cutoffs.values()]))
    item = F.struct(*[F.col(c) for c in take])
    tails = _carried_tails(marked.select(*dict.fromkeys([*by, "__chunk", *take])), by, order, item, window)
    before = tails.select(*by, "__chunk", F.explode("__carry").alias("__row")).select(*by, "__chunk", "__row.*", F.lit(True).alias("__before"))
    rows = marked.withColumn("__before", F.lit(False)).unionByName(before, allowMissingColumns=True)
    inside = Window.partitionBy(*by, "__chunk").orderBy(*order)
    # narrow rows are sorted; the earlier rows only come beside a row when it leaves the window
    held = rows.select("*", *[F.lag(item, n).over(inside).alias(f"__p{n}") for n in range(1, window + 1)]).where(~F.col("__before"))
    gap = lambda c, n: F.date_diff(F.col(c), F.col(f"__p{n}.{safe}"))
    late = [F.when(gap(c, n) < 0, F.struct(F.lit(v).alias("cutoff_view"), F.lit(n).alias("lag"), gap(c, n).alias("gap_days"), F.col(f"__p{n}").alias("__prev")))
            for v, c in cutoffs.items() for n in range(1, window + 1)]
    held = held.select(*by, key, F.inline(F.array_compact(F.array(*late))))
    return held.select(
        *by, key, "cutoff_view", "lag", "gap_days",
        *[F.col(f"__prev.{c}").alias(f"previous_{c}") for c in dict.fromkeys([*order, *describe])],
    )


def largest_gap(df: DataFrame, *, by: Sequence[str], on: str, threshold: int) -> DataFrame:
    """Largest gap between consecutive dates of a group, with endpoints, where > threshold.
    The first such gap wins a tie."""
    days = df.where(F.col(on).isNotNull()).select(*by, on).distinct()
    w = Window.partitionBy(*by).orderBy(on)
    gaps = days.withColumn("__prev", F.lag(on, 1).over(w)).where(F.col("__prev").isNotNull())
    gaps = gaps.withColumn("__gap", F.date_diff(on, "__prev"))
    best = gaps.groupBy(*by).agg(
        F.max_by(F.struct(F.col("__gap").alias("max_gap_days"), F.col("__prev").alias("gap_start"),
                          F.col(on).alias("gap_end")),
                 F.struct("__gap", (-F.unix_date(on)).alias("first"))).alias("__best")
    )
    return best.select(*by, "__best.*").where(F.col("max_gap_days") > threshold)
