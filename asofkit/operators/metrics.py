"""Metric tables over long prediction tables. Scopes and groupings are rows, not loops."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .quantiles import bounded_quantiles, exact_quantiles

SCOPES = ("complete", "complete_plus_provisional", "provisional")


def scored(pred: DataFrame) -> DataFrame:
    return pred.where(F.col("actual").isNotNull() & F.col("forecast").isNotNull())


def attempted_versus_scored(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    gone = F.count_if(F.col("actual").isNull())
    return pred.groupBy(*by).agg(
        F.count("*").alias("n_attempted"), F.count("actual").alias("n_scored"), gone.alias("n_excluded"),
        F.when(gone > 0, "missing_actual").otherwise("n/a").alias("reason"))


def with_scopes(pred: DataFrame, breakdowns: Sequence[str] = ()) -> DataFrame:
    """Tag rows with every scope they count in: pooled scopes, and `complete` by breakdown.

    The provisional year is in no pooled scope that does not name it.
    """
    prov = F.col("is_provisional")
    tag = lambda kind, value, where: F.when(where, F.struct(F.lit(kind).alias("scope"), value.cast("string").alias("scope_value")))
    tags = [
        tag("complete", F.lit("all"), ~prov), tag("complete_plus_provisional", F.lit("all"), F.lit(True)),
        tag("provisional", F.lit("all"), prov), *[tag(b, F.col(b), ~prov) for b in breakdowns],
    ]
    return pred.select("*", F.inline(F.array_compact(F.array(*tags))))


def error_metrics(
    pred: DataFrame, by: Sequence[str], *, scale: float = 100.0, fine: Sequence[str] | None = None,
    expand: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """n, MAE, median AE, RMSE, bias and R2 against the group's own mean.

    R2 is NULL below two rows; for constant actuals it is 1 when the errors are all zero, else 0.
    For rows that count in several groups see `exact_quantiles` on `fine` and `expand`.
    """
    own = list(fine) if fine is not None else list(by)
    err = (F.col("forecast") - F.col("actual")) * scale
    rows = scored(pred).select(*own, "actual", err.alias("__e"), F.abs(err).alias("__a"))
    y = F.col("actual")
    cells = rows.groupBy(*own).agg(
        F.count("*").alias("__n"), F.sum("__a").alias("__sa"), F.sum("__e").alias("__se"), F.sum(F.col("__e") * F.col("__e")).alias("__see"),
        F.sum(y).alias("__sy"), F.var_pop(y).alias("__vy"), F.min(y).alias("__lo"), F.max(y).alias("__hi"))
    cells = cells.withColumn("__my", F.col("__sy") / F.col("__n"))
    if expand is not None:
        cells = expand(cells)
    n, mean = F.sum("__n"), F.sum("__sy") / F.sum("__n")
    within = F.sum(F.col("__vy") * F.col("__n"))
    between = F.sum(F.col("__n") * F.col("__my") * F.col("__my")) - n * mean * mean
    sse, sst = F.sum("__see") / (scale * scale), within + between
    r2 = F.when(n >= 2, F.when(F.min("__lo") == F.max("__hi"), F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(sse, sst)))
    stats = cells.groupBy(*by).agg(
        n.alias("n"), (F.sum("__sa") / n).alias("mae"), F.sqrt(F.sum("__see") / n).alias("rmse"), (F.sum("__se") / n).alias("bias"),
        r2.alias("r2_own_mean"))
    med = exact_quantiles(rows, by=by, value="__a", probs=[0.5], fine=fine, expand=expand)
    return stats.join(med.select(*by, F.col("quantiles")[0].alias("median_ae")), list(by))


def pair_with_benchmark(pred: DataFrame, benchmark: str, *, key: Sequence[str] = ("event_key", "cutoff_view", "test_year")) -> DataFrame:
    """Every other model's rows beside the benchmark's row of the same key.

    Unpaired rows are kept with NULL on the missing side so that they can be counted.
    """
    base = pred.where(F.col("model_id") == benchmark).select(
        *key, F.col("actual").alias("benchmark_actual"), F.col("forecast").alias("benchmark_forecast"))
    return pred.where(F.col("model_id") != benchmark).join(base, list(key), "left")


def r2_versus_benchmark(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = paired.where(F.col("actual").isNotNull() & F.col("benchmark_forecast").isNotNull())
    sq = lambda f: (F.col(f) - F.col("actual")) * (F.col(f) - F.col("actual"))
    base = F.sum(sq("benchmark_forecast"))
    return rows.groupBy(*by).agg((1 - F.try_divide(F.sum(sq("forecast")), F.nullif(base, F.lit(0.0)))).alias("r2_benchmark"))


def paired_comparison(paired: DataFrame, by: Sequence[str], *, scale: float = 100.0) -> DataFrame:
    """MAE of both sides on identical rows, mean difference, and wins, losses and ties.

    n_unpaired and n_actual_differs must be zero for the comparison to be valid.
    """
    rows = paired.where(F.col("actual").isNotNull())
    a = F.abs(F.col("forecast") - F.col("actual")) * scale
    b = F.abs(F.col("benchmark_forecast") - F.col("benchmark_actual")) * scale
    d = a - b
    return rows.groupBy(*by).agg(
        F.count(d).alias("n"), F.avg(a).alias("mae_model"), F.avg(b).alias("mae_benchmark"), F.avg(d).alias("mean_difference"),
        F.count_if(d < 0).alias("n_model_better"), F.count_if(d > 0).alias("n_benchmark_better"), F.count_if(d == 0).alias("n_tied"),
        F.count_if(F.col("benchmark_forecast").isNull()).alias("n_unpaired"),
        F.count_if(F.col("actual") != F.col("benchmark_actual")).alias("n_actual_differs"))


def require_paired(table: DataFrame) -> None:
    """Gate: raise when any row had no partner or another outcome."""
    bad = table.agg(F.sum("n_unpaired").alias("u"), F.sum("n_actual_differs").alias("d")).first()
    if bad["u"] or bad["d"]:
        raise AssertionError(f"paired comparison: {bad['u']} unpaired rows, {bad['d']} differing outcomes")


def paired_cutoffs(pred: DataFrame, first: str, second: str, by: Sequence[str], *, scale: float = 100.0) -> DataFrame:
    """The same model at two cutoffs on the same rows."""
    key = ["event_key", "model_id", "test_year"]
    base = pred.where(F.col("cutoff_view") == first).select(
        *key, F.col("actual").alias("benchmark_actual"), F.col("forecast").alias("benchmark_forecast"))
    return paired_comparison(pred.where(F.col("cutoff_view") == second).join(base, key, "left"), by, scale=scale)


def error_distribution(pred: DataFrame, by: Sequence[str], *, scale: float = 100.0) -> DataFrame:
    """n, mean, median, std (n > 1) and bias-corrected skew (n > 2) of the signed error."""
    rows = scored(pred).select(*by, ((F.col("forecast") - F.col("actual")) * scale).alias("__e"))
    n = F.count("*")
    skew = F.skewness("__e") * F.sqrt(n * (n - 1)) / (n - 2)
    stats = rows.groupBy(*by).agg(
        n.alias("n"), F.avg("__e").alias("mean_error"), F.when(n > 1, F.stddev_samp("__e")).alias("std_error"),
        F.when(n > 2, skew).alias("skew_error"))
    med = exact_quantiles(rows, by=by, value="__e", probs=[0.5]).select(*by, F.col("quantiles")[0].alias("median_error"))
    return stats.join(med, list(by))


def case_studies(paired: DataFrame, by: Sequence[str], *, scale: float = 100.0) -> DataFrame:
    """(rule, event_key, gain) per group: largest gain, largest loss, closest to the median gain.

    Ties: the largest gain takes the last key, the others the first. The medians, one row per
    group, are written first, so that they go to the rows and rows are not shuffled by group.
    """
    gain = (F.abs(F.col("benchmark_forecast") - F.col("actual")) - F.abs(F.col("forecast") - F.col("actual"))) * scale
    # rounded so that equal gains stay equal whatever the order of summation above them
    rows = paired.where(F.col("actual").isNotNull()).select(*by, "event_key", F.round(gain, 9).alias("gain"))
    med = materialise(exact_quantiles(rows, by=by, value="gain", probs=[0.5]).select(*by, F.col("quantiles")[0].alias("__m")))
    rows = rows.join(med, list(by)) if by else rows.join(F.broadcast(med), F.lit(True))
    item = F.struct("event_key", "gain")
    picks = rows.groupBy(*by).agg(
        F.max_by(item, F.struct("gain", "event_key")).alias("largest_gain"),
        F.min_by(item, F.struct("gain", "event_key")).alias("largest_loss"),
        F.min_by(item, F.struct(F.abs(F.col("gain") - F.col("__m")), F.col("event_key"))).alias("closest_to_median"))
    rules = ["largest_gain", "largest_loss", "closest_to_median"]
    return picks.select(*by, F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"{r}.event_key").alias("event_key"), F.col(f"{r}.gain").alias("gain")) for r in rules])))


# ---------------------------------------------------------------- quantile forecasts

def pinball(actual: Column, forecast: Column, level: float) -> Column:
    d = actual - forecast
    return F.greatest(F.lit(level) * d, F.lit(level - 1) * d)


def probabilistic_metrics(
    rows: DataFrame, by: Sequence[str], *, levels: dict[float, str], intervals: dict[str, tuple[str, str]], scale: float = 100.0,
) -> DataFrame:
    """Mean pinball loss per level and pooled; inclusive coverage and mean width per interval."""
    known = rows.where(F.col("actual").isNotNull())
    losses = {c: pinball(F.col("actual"), F.col(c), q) * scale for q, c in levels.items()}
    pooled = sum(losses.values(), F.lit(0.0)) / len(losses)
    cov = []
    for name, (lo, hi) in intervals.items():
        cov.append(F.avg(F.col("actual").between(F.col(lo), F.col(hi)).cast("double")).alias(f"coverage_{name}"))
        cov.append(F.avg((F.col(hi) - F.col(lo)) * scale).alias(f"width_{name}"))
    return known.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.avg(x).alias(f"pinball_{c}") for c, x in losses.items()],
        F.avg(pooled).alias("pinball_mean"), *cov)


def clip_fraction(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with any quantile on a clip bound (numpy closeness: rtol 1e-5, atol 1e-8)."""
    touch = F.lit(False)
    for c in columns:
        touch = touch | (F.abs(F.col(c)) <= 1e-8) | (F.abs(F.col(c) - 1) <= 1e-8 + 1e-5)
    hit = F.count_if(touch)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), hit.alias("n_touching"), (hit / F.count("*")).alias("fraction_touching"))


def coverage_trend(by_year: DataFrame, by: Sequence[str], *, year: str, coverage: str, k: int = 3) -> DataFrame:
    """Mean coverage of the first and the last k years; groups with fewer than 2k are left out."""
    up = F.row_number().over(Window.partitionBy(*by).orderBy(year))
    total = F.count("*").over(Window.partitionBy(*by))
    t = by_year.select(*by, year, coverage, up.alias("__i"), total.alias("__n")).where(F.col("__n") >= 2 * k)
    early, late = F.col("__i") <= k, F.col("__i") > F.col("__n") - k
    mean = lambda where: F.avg(F.when(where, F.col(coverage)))
    return t.groupBy(*by).agg(mean(early).alias("early_coverage"), mean(late).alias("late_coverage"),
                              (mean(late) - mean(early)).alias("drift"))


# ---------------------------------------------------------------- classifier

def classifier_metrics(rows: DataFrame, by: Sequence[str], *, proba: str, label: str, baseline: str | None = None, decided: str | None = None) -> DataFrame:
    """Prevalence, Brier score, no-skill Brier and the confusion counts. Unlabelled rows are
    outside; a group without labels has no row."""
    known = rows.where(F.col(label).isNotNull())
    y = F.col(label).cast("double")
    brier = F.avg((F.col(proba) - y) * (F.col(proba) - y))
    aggs = [F.count("*").alias("n"), F.count_if(F.col(label).cast("boolean")).alias("n_positive"), F.avg(y).alias("prevalence"),
            brier.alias("brier")]
    if baseline:
        flat = F.avg((F.col(baseline) - y) * (F.col(baseline) - y))
        aggs += [flat.alias("no_skill_brier"), (brier > flat).alias("worse_than_no_skill")]
    if decided:
        d, a = F.col(decided).cast("boolean"), F.col(label).cast("boolean")
        aggs += [F.count_if(d & a).alias("true_positive"), F.count_if(d & ~a).alias("false_positive"),
                 F.count_if(~d & ~a).alias("true_negative"), F.count_if(~d & a).alias("false_negative")]
    return known.groupBy(*by).agg(*aggs)


def average_precision(rows: DataFrame, by: Sequence[str], *, proba: str, label: str, chunk: Column | None = None) -> DataFrame:
    """Step-wise area under precision-recall; NULL unless both classes occur.

    Rows are reduced to distinct scores. Running counts are taken inside score chunks, and
    the totals of higher chunks are carried, so no task ranks all scores. `chunk` must not
    decrease with the score; the default cuts [0, 1] into 4096.
    """
    part = chunk if chunk is not None else F.floor(F.col(proba) * 4096)
    per_score = rows.where(F.col(label).isNotNull()).groupBy(*by, part.alias("__c"), F.col(proba).alias("__s")).agg(
        F.count("*").alias("__sn"), F.sum(F.col(label).cast("long")).alias("__sp"))
    per_chunk = per_score.groupBy(*by, "__c").agg(F.sum("__sn").alias("__cn"), F.sum("__sp").alias("__cp"))
    above = Window.partitionBy(*by).orderBy(F.col("__c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carry = per_chunk.select(
        *by, "__c", F.coalesce(F.sum("__cn").over(above), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__cp").over(above), F.lit(0)).alias("__p0"),
        F.sum("__cn").over(whole).alias("__all_n"), F.sum("__cp").over(whole).alias("__all_p"))
    down = Window.partitionBy(*by, "__c").orderBy(F.col("__s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = per_score.join(carry, [*by, "__c"])
    n, p = F.col("__n0") + F.sum("__sn").over(down), F.col("__p0") + F.sum("__sp").over(down)
    t = t.withColumn("__term", F.col("__sp") * (p / n))
    both = (F.max("__all_p") > 0) & (F.max("__all_p") < F.max("__all_n"))
    return t.groupBy(*by).agg(F.when(both, F.try_divide(F.sum("__term"), F.max("__all_p"))).alias("average_precision"))


def calibration_table(rows: DataFrame, by: Sequence[str], *, proba: str, label: str, bins: int = 5) -> DataFrame:
    """Quantile bins (repeated edges dropped, right-closed): n, mean score, observed rate.
    Groups with fewer rows than bins are left out."""
    known = rows.where(F.col(label).isNotNull())
    edges = exact_quantiles(known, by=by, value=proba, probs=[i / bins for i in range(bins + 1)], out="__e")
    size = known.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= bins)
    cuts = F.array_distinct("__e")
    inner = F.slice(cuts, 2, F.greatest(F.size(cuts) - 2, F.lit(0)))
    edges = edges.select(*by, inner.alias("__cuts"))
    # one row per group, written first: it goes to the rows, which are not shuffled by group
    edges = materialise(edges.join(size.select(*by), list(by)) if by else edges.join(F.broadcast(size), F.lit(True)))
    t = known.join(edges, list(by)) if by else known.join(F.broadcast(edges), F.lit(True))
    at = F.size(F.filter("__cuts", lambda e: e < F.col(proba)))
    return t.groupBy(*by, at.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(proba).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed_rate"))


def sufficiency_gate(labels: DataFrame, by: Sequence[str], *, year: str, label: str, min_pooled: int = 30, min_year: int = 5) -> DataFrame:
    """Per group: pooled positives against the minimum, and which years may be reported alone."""
    per_year = labels.groupBy(*by, year).agg(
        F.count(label).alias("__n"), F.count_if(F.coalesce(F.col(label).cast("boolean"), F.lit(False))).alias("__p"))
    ok = F.col("__p") >= min_year
    years = lambda where: F.array_sort(F.collect_list(F.when(where, F.col(year))))
    return per_year.groupBy(*by).agg(
        F.sum("__p").alias("pooled_positives"), F.sum("__n").alias("pooled_labelled"), (F.sum("__p") >= min_pooled).alias("passes"),
        F.concat_ws(",", years(ok).cast("array<string>")).alias("years_reported"),
        F.concat_ws(",", years(~ok).cast("array<string>")).alias("years_suppressed"))


# ---------------------------------------------------------------- decisions over year tables

def decision_rule(paired: DataFrame) -> DataFrame:
    """A challenger meets the bar when, at every cutoff and against every benchmark, its pooled
    MAE is lower and it wins more years than it does not.

    paired(model_id, benchmark, cutoff_view, test_year, n, mae_model, mae_benchmark,
    n_model_better, n_benchmark_better) of complete years.
    """
    pooled = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    wins = F.count_if(F.col("n_model_better") > F.col("n_benchmark_better"))
    per = paired.groupBy("model_id", "benchmark", "cutoff_view").agg(
        (pooled("mae_model") < pooled("mae_benchmark")).alias("beats_mae"), (wins > F.count("*") - wins).alias("beats_years"))
    return per.groupBy("model_id").agg(
        F.count("*").alias("n_comparisons"), F.count_if("beats_mae").alias("n_beats_mae"), F.count_if("beats_years").alias("n_beats_years"),
        F.every(F.col("beats_mae") & F.col("beats_years")).alias("meets_bar"))


def year_ranges(years: DataFrame, by: Sequence[str], year: str) -> DataFrame:
    """Consecutive years collapsed to `a-b`, joined by commas."""
    w = Window.partitionBy(*by).orderBy(year)
    runs = years.select(*by, year).distinct().withColumn("__run", F.col(year) - F.row_number().over(w)).groupBy(*by, "__run").agg(
        F.min(year).alias("__a"), F.max(year).alias("__b"))
    text = F.when(F.col("__a") == F.col("__b"), F.col("__a").cast("string")).otherwise(F.concat_ws("-", "__a", "__b"))
    runs = runs.select(*by, F.struct("__a", text.alias("t")).alias("__run"))
    return runs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("__run")), lambda s: s["t"]), ", ").alias("years"))


def win_pattern(paired: DataFrame, by: Sequence[str], year: str = "test_year") -> DataFrame:
    """Years won, lost and tied on row wins, as collapsed ranges."""
    outcome = F.when(F.col("n_model_better") > F.col("n_benchmark_better"), "won").when(
        F.col("n_model_better") < F.col("n_benchmark_better"), "lost").otherwise("tied")
    tagged = paired.select(*by, year, outcome.alias("outcome"))
    counts = tagged.groupBy(*by, "outcome").agg(F.count("*").alias("n_years"))
    return counts.join(year_ranges(tagged, [*by, "outcome"], year), [*by, "outcome"])


def block_bootstrap(values: DataFrame, by: Sequence[str], *, value: str, order: str, n_boot: int = 10_000, seed: int = 42,
                    interval: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Percentile interval of the mean of year values under resampling of whole years.

    Draws come from a hash of (seed, group, draw, position), so they are the same on every
    run and cluster. Groups of one year get no interval.
    """
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    years = materialise(values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"), pos.alias("__i")))
    size = years.groupBy(*by).agg(F.count("*").alias("n_years"), F.avg("__v").alias("point"))
    spark = values.sparkSession
    draws = spark.range(n_boot).withColumnRenamed("id", "__b")
    # groups x years is a metric-table size; draws are spread over the cluster
    slots = F.broadcast(years.select(*by, F.col("__i").alias("__slot")).join(size.select(*by, "n_years"), list(by)))
    picked = draws.join(slots, F.lit(True)).withColumn(
        "__i", F.pmod(F.xxhash64(F.lit(seed), *by, "__b", "__slot"), F.col("n_years")).cast("int"))
    means = picked.join(F.broadcast(years), [*by, "__i"]).groupBy(*by, "__b").agg(F.avg("__v").alias("__m"))
    q = bounded_quantiles(means, by=by, value="__m", probs=list(interval))
    many = F.col("n_years") >= 2
    return size.join(q, list(by), "left").select(
        *by, "n_years", "point", F.when(many, F.col("quantiles")[0]).alias("low"), F.when(many, F.col("quantiles")[1]).alias("high"))


# ---------------------------------------------------------------- top rows and chart data

def extremes(df: DataFrame, *, value: str, key: str, n: int, keep: Sequence[str]) -> DataFrame:
    """The n highest and the n lowest rows, ties by key."""
    rows = df.where(F.col(value).isNotNull()).select(key, value, *keep)
    rank = F.row_number().over(Window.partitionBy("side").orderBy("__o", key))
    top = rows.orderBy(F.col(value).desc(), F.col(key)).limit(n).withColumn("side", F.lit("highest")).withColumn("__o", -F.col(value))
    low = rows.orderBy(F.col(value), F.col(key)).limit(n).withColumn("side", F.lit("lowest")).withColumn("__o", F.col(value))
    return top.unionByName(low).withColumn("rank", rank).drop("__o")


def largest_revision(vintages: DataFrame, *, vintage: str, observed: str, value: str) -> DataFrame:
    """The observation whose first and last published values differ most; later date wins ties."""
    ends = vintages.where(F.col(value).isNotNull()).groupBy(observed).agg(
        F.min_by(value, vintage).alias("first_value"), F.max_by(value, vintage).alias("last_value"),
        F.min(vintage).alias("first_vintage"), F.max(vintage).alias("last_vintage"))
    ends = ends.where(F.col("first_value") != F.col("last_value"))
    return ends.orderBy(F.abs(F.col("last_value") - F.col("first_value")).desc(), F.col(observed).desc()).limit(1)


def histogram(df: DataFrame, by: Sequence[str], *, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; the last bin includes the upper edge."""
    at = F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    inside = F.col(value).between(low, high)
    return df.where(inside).groupBy(*by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
