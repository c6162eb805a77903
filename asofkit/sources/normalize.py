"""Raw string rows -> typed tables, with every anomaly counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import (
    invalid_date, invalid_number, null_token, observation_period_date, parse_date, parse_number,
    vintage_period, vintage_year,
)


def schema_drift(columns: Sequence[str], expected: Sequence[str]) -> dict[str, list[str]]:
    have, want = set(columns), set(expected)
    return {"new_columns": sorted(have - want), "missing_columns": sorted(want - have)}


def unlisted_keys(selected: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Selected ids the source no longer lists."""
    return selected.select(key).distinct().join(live.select(key), key, "left_anti")


def normalize_events(
    raw: DataFrame, *, dates: Sequence[str], numbers: Sequence[str], categories: Sequence[str], token: str = "null",
) -> DataFrame:
    """Typed columns beside `<field>_raw` text twins; category tokens mapped to NULL."""
    typed: dict[str, Column] = {}
    for c in dates:
        typed[c], typed[f"{c}_raw"] = parse_date(c, token), F.col(c)
    for c in numbers:
        typed[c], typed[f"{c}_raw"] = parse_number(c, token), F.col(c)
    for c in categories:
        typed[c] = null_token(c, token)
    return raw.withColumns(typed)


def event_anomalies(
    raw: DataFrame, *, dates: Sequence[str], numbers: Sequence[str], allowed: dict[str, Sequence[str]], token: str = "null",
) -> DataFrame:
    """(field, problem, n): invalid dates and numbers and unexpected category values."""
    counts = [F.count_if(invalid_date(c, token)).alias(f"invalid_date|{c}") for c in dates]
    counts += [F.count_if(invalid_number(c, token)).alias(f"invalid_number|{c}") for c in numbers]
    counts += [
        F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values, token)).alias(f"unexpected_category|{c}")
        for c, values in allowed.items()
    ]
    row = raw.agg(*counts)
    long = row.select(F.explode(F.create_map(*[x for c in row.columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("k", "n"))
    parts = F.split("k", r"\|")
    return long.select(parts[1].alias("field"), parts[0].alias("problem"), "n").where(F.col("n") > 0)


def classify_events(
    df: DataFrame, *, kind: str, kinds: Sequence[str], repeat: str, indexed: str, floating: str, term: str, total: str,
) -> DataFrame:
    """Universe flag, repeat flag, segment of the universe and availability of results."""
    universe = F.coalesce(
        F.col(kind).isin(*kinds) & (F.col(indexed) == "No") & (F.col(floating) == "No"), F.lit(False)
    )
    return df.withColumns({
        "is_repeat": F.coalesce(F.col(repeat) == "Yes", F.lit(False)),
        "in_universe": universe,
        "segment": F.when(universe, F.col(term)),
        "results_available": F.col(total).isNotNull(),
    })


def normalize_series(records: DataFrame, metadata: DataFrame, *, token: str = "*") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects). Rows carry a typed value, its raw text, whether and why it is missing,
    and metadata by (keyid, period); ids the metadata does not know are rejected, not guessed.

    metadata(keyid, period, ...) is a registry of at most a few hundred rows.
    """
    typed = records.withColumns({
        "period": F.coalesce("period", F.lit("CURRENT")),
        "observed": F.try_to_timestamp("asofdate", F.lit("yyyy-MM-dd")).cast("date"),
        "value_raw": F.col("value"),
        "value": parse_number("value", token),
        "is_missing": parse_number("value", token).isNull(),
        "missing_reason": F.when(F.col("value") == token, F.lit("withheld_by_source")),
    })
    keys = ["keyid", "period"]
    rows = typed.join(F.broadcast(metadata), keys)
    rejects = typed.join(F.broadcast(metadata.select(*keys)), keys, "left_anti").groupBy("keyid").agg(
        F.count("*").alias("n_rows"))
    return rows, rejects


def normalize_positions(
    records: DataFrame, *, numbers: Sequence[str], key: Sequence[str], known: DataFrame
) -> DataFrame:
    """Typed fields with raw twins, plus whether the key is known and how often it occurs."""
    typed = records.withColumns(
        {c: parse_number(c, "") for c in numbers} | {f"{c}_raw": F.col(c) for c in numbers}
    )
    counted = typed.groupBy(*key).agg(F.count("*").alias("n_same_key"))
    typed = typed.join(counted, list(key), "left")
    flagged = F.broadcast(known.select(key[0]).distinct().withColumn("is_known", F.lit(True)))
    return typed.join(flagged, key[0], "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def unpivot_rates(
    wide: DataFrame, *, on: str, labels: dict[str, float], regime_change: str, special: dict[str, str],
    names: tuple[str, str] = ("old_method", "new_method"), special_names: tuple[str, str] = ("composite", "direct"),
) -> DataFrame:
    """One row per (date, maturity): trimmed text, value, missing flag and reason, years, regime.

    special maps a maturity to the date its own second regime begins; that label is joined
    to the curve-wide one by '+'.
    """
    present = [c for c in labels if c in wide.columns]
    long = wide.unpivot([on], present, "maturity", "value_raw")
    years = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    value = F.nullif(F.trim("value_raw"), F.lit("")).try_cast("double")
    curve = F.when(F.col(on) >= F.lit(regime_change).cast("date"), names[1]).otherwise(names[0])
    second = F.lit(None).cast("string")
    for label, since in special.items():
        second = F.when(
            F.col("maturity") == label,
            F.when(F.col(on) >= F.lit(since).cast("date"), special_names[1]).otherwise(special_names[0]),
        ).otherwise(second)
    return long.select(
        on, "maturity", years[F.col("maturity")].alias("maturity_years"), value.alias("value"),
        F.trim("value_raw").alias("value_raw"), F.concat_ws("+", curve, second).alias("regime"),
        value.isNull().alias("is_missing"), F.when(value.isNull(), "empty_at_source").alias("missing_reason"),
    )


def parse_wide_dates(wide: DataFrame, *, text: str, out: str, known: Sequence[str], fmt: str = "MM/dd/yyyy") -> tuple[DataFrame, DataFrame]:
    """(typed, report) of a text CSV: typed date, and counts of invalid dates, of dates that
    occur more than once and of columns nobody knows."""
    typed = wide.withColumn(out, F.try_to_timestamp(F.col(text), F.lit(fmt)).cast("date"))
    unknown = [c for c in wide.columns if c not in {*known, text, "source_year"}]
    per_day = typed.groupBy(out).agg(F.count("*").alias("n"))
    report = per_day.agg(
        F.coalesce(F.sum(F.when(F.col(out).isNull(), F.col("n"))), F.lit(0)).alias("n_invalid_dates"),
        F.count_if(F.col(out).isNotNull() & (F.col("n") > 1)).alias("n_duplicate_dates"),
    ).withColumn("unknown_columns", F.lit(",".join(sorted(unknown))))
    return typed, report


def melt_vintage_matrix(
    matrix: DataFrame, *, period: str, prefix: str, vintage_frequency: str, observation_frequency: str
) -> tuple[DataFrame, list[str]]:
    """Vintage matrix (periods x vintage columns) -> long rows, plus unrecognised columns."""
    import re

    pattern = r"\d{2}M\d{1,2}" if vintage_frequency == "monthly" else r"\d{2}Q\d"
    good = [c for c in matrix.columns if re.fullmatch(re.escape(prefix) + pattern, c)]
    unknown = sorted(set(matrix.columns) - set(good) - {period})
    long = matrix.select(period, F.posexplode(F.array(*[F.col(c).cast("string") for c in good])).alias("__at", "__value"))
    long = long.withColumn("__column", F.element_at(F.lit(good), F.col("__at") + 1))
    label = F.substring(F.col("__column"), len(prefix) + 1, 16)
    return long.select(
        F.lit(prefix).alias("variable"), F.col(period).alias("observation_period"),
        observation_period_date(period, observation_frequency).alias("observed"),
        label.alias("vintage_label"), vintage_year(label).alias("vintage_year"),
        vintage_period(label, vintage_frequency).alias("vintage_period"),
        F.col("__value").try_cast("double").alias("value"),
    ), unknown


def grid_gaps(long: DataFrame, *, by: Sequence[str], observed: str, months: int = 1) -> DataFrame:
    """Missing periods between the first and last of an evenly spaced grid."""
    span = F.months_between(F.max(observed), F.min(observed)) / months + 1
    return long.where(F.col(observed).isNotNull()).groupBy(*by).agg(
        (F.round(span).cast("bigint") - F.count_distinct(observed)).alias("n_gaps"),
    )


def pivot_first(long: DataFrame, *, index: Sequence[str], entity: str, entities: Sequence, value: str, prefix: str = "") -> DataFrame:
    """First non-missing value per (index, entity); the entity list is explicit."""
    wide = long.groupBy(*index).pivot(entity, list(entities)).agg(F.first(value, ignorenulls=True))
    return wide.select(*index, *[F.col(f"`{e}`").alias(f"{prefix}{e}") for e in entities])


def pivot_unique(long: DataFrame, *, index: str, entity: str, entities: Sequence, values: Sequence[str]) -> DataFrame:
    """`{entity}__{value}` columns for several values; a repeated (index, entity) is an error
    raised by the job itself."""
    once = F.assert_true(F.count("*") <= 1, F.concat(F.lit("duplicate rows for "), F.col(index).cast("string")))
    cells = long.where(F.col(entity).isin(*entities)).groupBy(index, entity).agg(
        *[F.first(v).alias(v) for v in values], once.alias("__ok"))
    cells = cells.where(F.col("__ok").isNull())
    wide = cells.groupBy(index).pivot(entity, list(entities)).agg(*[F.first(v).alias(v) for v in values])
    name = (lambda e, v: f"{e}_{v}") if len(values) > 1 else (lambda e, v: str(e))
    return wide.select(index, *[F.col(f"`{name(e, v)}`").alias(f"{e}__{v}") for e in entities for v in values])


def combine_regimes(df: DataFrame, sources: Sequence[Column], out: str) -> DataFrame:
    """First present of several disjoint regimes; two at once is an error raised by the job."""
    present = sum((s.isNotNull().cast("int") for s in sources), F.lit(0))
    checked = F.when(present > 1, F.raise_error(F.lit(f"{out}: overlapping regimes")).cast("double"))
    return df.withColumn(out, F.coalesce(checked, *sources))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """All members of keys that occur more than once. Keys are counted first, so a hot key
    costs one row in the join and AQE can split its matches."""
    repeated = df.groupBy(*key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)
    return df.join(repeated, list(key))


def regime_label(day: Column | str, starts: Sequence[tuple[str, str]]) -> Column:
    """Piecewise label: (first day, label) pairs in ascending order."""
    d = F.col(day) if isinstance(day, str) else day
    label = F.lit(None).cast("string")
    for since, name in starts:
        label = F.when(d >= F.lit(since).cast("date"), F.lit(name)).otherwise(label)
    return label


def with_vintage_release_dates(
    long: DataFrame, calendar: DataFrame, *, frequency: str, day: int, precision: str
) -> DataFrame:
    """Nominal and safe date of each vintage: the given day, clamped to the month's length; a
    quarterly vintage is dated in its middle month."""
    from ..functions.dates import clamped_day
    from ..operators.calendar import with_next_business_day

    month = F.col("vintage_period") if frequency == "monthly" else F.col("vintage_period") * 3 - 1
    dated = long.withColumns({
        "nominal_published_date": clamped_day(F.col("vintage_year"), month, day), "availability_precision": F.lit(precision)})
    return with_next_business_day(dated, calendar, "nominal_published_date", "safe_date")


def vintage_index(long: DataFrame) -> DataFrame:
    """One row per vintage."""
    cols = ["vintage_label", "vintage_year", "vintage_period", "nominal_published_date", "safe_date", "availability_precision"]
    return long.groupBy("vintage_label").agg(*[F.first(c).alias(c) for c in cols[1:]])
