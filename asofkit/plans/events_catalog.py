"""Queries over business time, event features and rolling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates as dt
from ..operators import asof, calendar as cal, rolling as ro
from . import analogs as an
from .oracle import sql, weekdays_to

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


# ---------------------------------------------------------------- flagship

_FLAGSHIP = sql("evc wkrel", """
, slots AS (SELECT segment, announce_date, sum(amount) AS s,
    arg_max(amount, event_key) AS last_amount, arg_max(event_date, event_key) AS last_event
  FROM ev GROUP BY 1, 2),
w AS (SELECT segment, announce_date,
    sum(s) OVER (PARTITION BY segment ORDER BY announce_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS sum_4,
    sum(s) OVER (PARTITION BY segment ORDER BY announce_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS sum_8,
    lag(last_amount) OVER (PARTITION BY segment ORDER BY announce_date) AS prev_amount,
    lag(last_event) OVER (PARTITION BY segment ORDER BY announce_date) AS prev_event FROM slots)
SELECT e.event_key, e.segment, e.announce_date, round(sum_4, 2) AS segment_sum_4, round(sum_8, 2) AS segment_sum_8,
  prev_amount AS previous_amount, e.event_date - prev_event AS days_since_previous,
  a.observed AS announcement_observed, a.value_A AS announcement_value_a,
  p.observed AS pre_event_observed, p.value_A AS pre_event_value_a
FROM evc e JOIN w USING (segment, announce_date)
ASOF LEFT JOIN wkrel a ON a.safe_date <= e.announcement_cutoff
ASOF LEFT JOIN wkrel p ON p.safe_date <= e.pre_event_cutoff
""")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing supply, previous event and the release known at each cutoff, per event."""
    ev = an.events_with_cutoffs(spark, sf_dir).drop("entity_id", "is_repeat", "result_safe_date")
    feats = ro.slot_features(
        ev, by=["segment"], on="announce_date", value="amount", sums={4: "segment_sum_4", 8: "segment_sum_8"},
        tie=["event_key"], previous={"amount": "previous_amount", "event_date": "previous_event_date"})
    wide = asof.asof_join_cutoffs(
        feats, an.weekly_releases(spark, sf_dir), safe="safe_date", tie=["observed"], values=["observed", "value_A"],
        cutoffs={"announcement": "announcement_cutoff", "pre_event": "pre_event_cutoff"})
    return wide.select(
        "event_key", "segment", "announce_date",
        F.round("segment_sum_4", 2).alias("segment_sum_4"), F.round("segment_sum_8", 2).alias("segment_sum_8"),
        "previous_amount", F.date_diff("event_date", "previous_event_date").cast("bigint").alias("days_since_previous"),
        F.col("announcement__observed").alias("announcement_observed"),
        F.col("announcement__value_A").alias("announcement_value_a"),
        F.col("pre_event__observed").alias("pre_event_observed"),
        F.col("pre_event__value_A").alias("pre_event_value_a"),
    )


query("point_in_time_features", _FLAGSHIP)(flagship)


# ---------------------------------------------------------------- business time

@query("business_calendar", sql("evc cal", """
SELECT event_date AS day, count(*) AS n_events, bool_or(is_h) AS is_holiday, bool_or(is_bd) AS is_business_day,
  any_value(nbd) AS next_business_day, any_value(pbd) AS previous_business_day
FROM ev JOIN cal ON day = event_date GROUP BY 1"""))
def business_calendar(spark, sf_dir):
    days = an.events(spark, sf_dir).groupBy(F.col("event_date").alias("day")).agg(F.count("*").alias("n_events"))
    return days.join(F.broadcast(an.calendar(spark)), "day", "left")


@query("event_cutoffs", sql("evc", """
SELECT event_key, announcement_cutoff, pre_event_cutoff, result_safe_date FROM evc"""))
def event_cutoffs(spark, sf_dir):
    return an.events_with_cutoffs(spark, sf_dir).select(
        "event_key", "announcement_cutoff", "pre_event_cutoff", "result_safe_date")


@query("weekly_release_dates", sql("wkrel", "SELECT observed, published_date, safe_date FROM wkrel"))
def weekly_release_dates(spark, sf_dir):
    return an.weekly_releases(spark, sf_dir).select("observed", "published_date", "safe_date")


_OVERRIDES = [("1996-01-09", "1996-02-02", "exact", "notice"), ("1998-12-29", "1999-01-19", "exact", "notice"),
              ("2000-03-07", "2000-03-24", "reconstructed", "cadence")]
_WINDOWS = [("closure-1996", "1996-01-01", "1996-02-06"), ("outage-2000", "2000-03-01", "2000-04-01")]


@query("release_calendar_overrides", sql("ct cal", f"""
, ovr(observed, actual, prec, src) AS (VALUES {", ".join(f"(DATE '{a}', DATE '{b}', '{c}', '{d}')" for a, b, c, d in _OVERRIDES)}),
win(name, lo, hi) AS (VALUES {", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in _WINDOWS)}),
d AS (SELECT DISTINCT observed FROM ct),
x AS (SELECT d.observed, o.*, w.name, CASE WHEN c.is_h THEN c.nbd ELSE c.day END AS std
  FROM d JOIN cal c ON c.day = d.observed + 3 LEFT JOIN ovr o ON o.observed = d.observed
  LEFT JOIN win w ON d.observed BETWEEN lo AND hi),
y AS (SELECT observed, CASE WHEN actual IS NOT NULL THEN actual WHEN name IS NOT NULL THEN NULL ELSE std END AS nominal_published_date,
  CASE WHEN actual IS NOT NULL THEN actual WHEN name IS NOT NULL THEN observed + 60 ELSE std END AS anchor,
  CASE WHEN actual IS NOT NULL THEN prec WHEN name IS NOT NULL THEN 'window_fallback' ELSE 'standard_rule' END AS availability_precision,
  CASE WHEN actual IS NOT NULL THEN src WHEN name IS NOT NULL THEN 'window:' || name ELSE 'standard' END AS release_rule FROM x)
SELECT y.observed, nominal_published_date, nbd AS safe_date, availability_precision, release_rule
FROM y LEFT JOIN cal ON day = anchor"""))
def release_calendar_overrides(spark, sf_dir):
    days = an.contracts_long(spark, sf_dir).select("observed").distinct()
    overrides = spark.createDataFrame(_OVERRIDES, "observed string, actual_published string, precision string, source string")
    overrides = overrides.withColumn("observed", F.col("observed").cast("date")).withColumn(
        "actual_published", F.col("actual_published").cast("date"))
    windows = spark.createDataFrame(_WINDOWS, "window_name string, window_start string, window_end string")
    windows = windows.withColumn("window_start", F.col("window_start").cast("date")).withColumn(
        "window_end", F.col("window_end").cast("date"))
    return cal.with_overridden_release_dates(days, an.calendar(spark), "observed", overrides=overrides, windows=windows)


@query("event_ages_and_parts", sql("evc", f"""
SELECT event_key, CAST(month(event_date) AS INTEGER) AS event_month, CAST(quarter(event_date) AS INTEGER) AS event_quarter,
  CAST(isodow(event_date) - 1 AS INTEGER) AS event_weekday, CAST(isodow(announce_date) - 1 AS INTEGER) AS announce_weekday,
  CAST(event_date - announce_date AS INTEGER) AS gap_days,
  CAST(greatest({weekdays_to('result_safe_date')} - {weekdays_to('announce_date')}, 0) AS INTEGER) AS age_weekdays
FROM evc"""))
def event_ages_and_parts(spark, sf_dir):
    ev = an.events_with_cutoffs(spark, sf_dir)
    return ev.select(
        "event_key", *dt.calendar_parts("event_date", "event"), F.weekday("announce_date").alias("announce_weekday"),
        F.date_diff("event_date", "announce_date").alias("gap_days"),
        dt.weekday_count("announce_date", "result_safe_date").alias("age_weekdays"),
    )


@query("market_dates", sql("", """
SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS market_date,
  CAST(ts AS DATE) AS utc_date FROM events"""))
def market_dates(spark, sf_dir):
    e = an.table(spark, sf_dir, "events")
    return e.select("event_id", dt.today_in("America/New_York", F.col("ts")).alias("market_date"),
                    F.col("ts").cast("date").alias("utc_date"))


# ---------------------------------------------------------------- event windows

@query("trailing_supply", sql("ev", """
, s AS (SELECT announce_date, sum(amount) AS s FROM ev GROUP BY 1),
w AS (SELECT announce_date,
  sum(s) OVER (ORDER BY announce_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS a,
  sum(s) OVER (ORDER BY announce_date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING) AS b FROM s),
g AS (SELECT segment, announce_date, sum(amount) AS s FROM ev GROUP BY 1, 2),
v AS (SELECT segment, announce_date,
  sum(s) OVER (PARTITION BY segment ORDER BY announce_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS c,
  sum(s) OVER (PARTITION BY segment ORDER BY announce_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS d FROM g)
SELECT event_key, round(a, 2) AS all_8, round(b, 2) AS all_26, round(c, 2) AS segment_4, round(d, 2) AS segment_8
FROM ev JOIN w USING (announce_date) JOIN v USING (segment, announce_date)"""))
def trailing_supply(spark, sf_dir):
    ev = an.events(spark, sf_dir)
    out = ro.distinct_date_sum(ev, on="announce_date", value="amount", windows={8: "all_8", 26: "all_26"})
    out = ro.distinct_date_sum(out, on="announce_date", value="amount", by=["segment"],
                               windows={4: "segment_4", 8: "segment_8"})
    return out.select("event_key", *[F.round(c, 2).alias(c) for c in ("all_8", "all_26", "segment_4", "segment_8")])


@query("previous_same_group", sql("ev", """
SELECT e.event_key, arg_max(p.amount, (p.announce_date, p.event_key)) AS previous_amount,
  round(e.amount - arg_max(p.amount, (p.announce_date, p.event_key)), 2) AS amount_change,
  CAST(e.event_date - arg_max(p.event_date, (p.announce_date, p.event_key)) AS INTEGER) AS days_since_previous
FROM ev e LEFT JOIN ev p ON p.segment = e.segment AND p.announce_date < e.announce_date
  AND p.announce_date > e.announce_date - 60
GROUP BY e.event_key, e.amount, e.event_date"""))
def previous_same_group(spark, sf_dir):
    out = ro.previous_in_group(an.events(spark, sf_dir), by=["segment"], on="announce_date", tie=["event_key"],
                               take={"amount": "previous_amount", "event_date": "__prev_date"})
    return out.select("event_key", "previous_amount",
                      F.round(F.col("amount") - F.col("previous_amount"), 2).alias("amount_change"),
                      F.date_diff("event_date", "__prev_date").alias("days_since_previous"))


@query("prior_repeat_count", sql("ev", """
SELECT e.event_key, count(p.event_key) AS n_prior_repeats FROM ev e LEFT JOIN ev p
ON p.entity_id = e.entity_id AND p.is_repeat AND p.announce_date < e.announce_date GROUP BY 1"""))
def prior_repeat_count(spark, sf_dir):
    out = ro.prior_flag_count(an.events(spark, sf_dir), by=["entity_id"], on="announce_date", flag="is_repeat",
                              out="n_prior_repeats")
    return out.select("event_key", "n_prior_repeats")


@query("order_trailing_mean", sql("pool", """
SELECT event_key, round(avg(primary_share) OVER (PARTITION BY segment ORDER BY event_date, event_key
  ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 8) AS trailing_mean FROM pool"""))
def order_trailing_mean(spark, sf_dir):
    out = ro.order_trailing_mean(an.pool(spark, sf_dir), by=["segment"], order=["event_date", "event_key"],
                                 value="primary_share", out="trailing_mean", chunk=an.event_chunk())
    return out.select("event_key", F.round("trailing_mean", 8).alias("trailing_mean"))


@query("safe_trailing_mean", sql("pool", """
, cand AS (SELECT segment, result_safe_date AS known, event_date, event_key,
    list({'k': event_key, 'v': primary_share}) OVER (PARTITION BY segment ORDER BY result_safe_date, event_date, event_key
      ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS items FROM pool WHERE primary_share IS NOT NULL),
last AS (SELECT segment, known, arg_max(items, (event_date, event_key)) AS items FROM cand GROUP BY 1, 2),
hit AS (SELECT p.event_key, list_filter(coalesce(l.items, []), lambda x: x.k <> p.event_key) AS used
  FROM pool p ASOF LEFT JOIN last l ON l.segment = p.segment AND l.known <= p.announcement_cutoff)
SELECT event_key, round(list_avg(list_transform(used, lambda x: x.v)), 8) AS trailing_mean, CAST(len(used) AS INTEGER) AS n_used
FROM hit"""))
def safe_trailing_mean(spark, sf_dir):
    out = ro.safe_trailing_mean(an.pool(spark, sf_dir), by=["segment"], value="primary_share", key="event_key",
                                cutoff="announcement_cutoff", safe="result_safe_date", on="event_date",
                                out="trailing_mean", count_out="n_used")
    return out.select("event_key", F.round("trailing_mean", 8).alias("trailing_mean"), "n_used")


@query("trailing_year_mean", sql("ev", """
SELECT e.event_key, m AS mean_365d_cents FROM ev e JOIN (
  SELECT d.segment, d.event_date, sum(s.s) / sum(s.n) AS m
  FROM (SELECT DISTINCT segment, event_date FROM ev) d
  JOIN (SELECT segment, event_date, sum(CAST(round(amount * 100) AS BIGINT)) AS s, count(*) AS n FROM ev GROUP BY 1, 2) s
    ON s.segment = d.segment AND s.event_date BETWEEN d.event_date - 364 AND d.event_date
  GROUP BY 1, 2) q USING (segment, event_date)"""))
def trailing_year_mean(spark, sf_dir):
    cents = an.events(spark, sf_dir).withColumn("cents", F.round(F.col("amount") * 100).cast("bigint"))
    out = ro.trailing_days_mean(cents, on="event_date", value="cents", by=["segment"], out="mean_365d_cents")
    return out.select("event_key", "mean_365d_cents")


_VIEWS = {"announcement": "announcement_cutoff", "pre_event": "pre_event_cutoff"}


@query("availability_violations", sql("pool", """
, l AS (SELECT event_key, segment, event_date, announcement_cutoff, pre_event_cutoff, n,
    lag(result_safe_date, n) OVER (PARTITION BY segment, n ORDER BY event_date, event_key) AS ps,
    lag(event_date, n) OVER (PARTITION BY segment, n ORDER BY event_date, event_key) AS pd,
    lag(event_key, n) OVER (PARTITION BY segment, n ORDER BY event_date, event_key) AS pk
  FROM pool, (SELECT CAST(range AS INTEGER) AS n FROM range(1, 9)) r),
c AS (SELECT *, 'announcement' AS cutoff_view, announcement_cutoff AS cutoff FROM l
      UNION ALL SELECT *, 'pre_event', pre_event_cutoff FROM l)
SELECT segment, event_key, cutoff_view, n AS lag, CAST(cutoff - ps AS INTEGER) AS gap_days,
  pd AS previous_event_date, pk AS previous_event_key FROM c WHERE cutoff - ps < 0"""))
def availability_violations(spark, sf_dir):
    return ro.availability_violations(
        an.pool(spark, sf_dir).drop("entity_id"), by=["segment"], order=["event_date", "event_key"], safe="result_safe_date",
        cutoffs=_VIEWS, key="event_key", window=8, chunk=an.event_chunk())


@query("availability_risk_summary", sql("pool", """
, l AS (SELECT event_key, announcement_cutoff, pre_event_cutoff, n,
    lag(result_safe_date, n) OVER (PARTITION BY segment, n ORDER BY event_date, event_key) AS ps
  FROM pool, (SELECT CAST(range AS INTEGER) AS n FROM range(1, 9)) r),
c AS (SELECT event_key, n, 'announcement' AS cutoff_view, announcement_cutoff - ps AS gap FROM l
      UNION ALL SELECT event_key, n, 'pre_event', pre_event_cutoff - ps FROM l)
SELECT cutoff_view, n AS lag, count(*) AS n_violations, count(DISTINCT event_key) AS n_events,
  CAST(min(gap) AS INTEGER) AS min_gap_days FROM c WHERE gap < 0 GROUP BY GROUPING SETS ((cutoff_view), (n), ())
"""))
def availability_risk_summary(spark, sf_dir):
    """Violations per cutoff view, per lag and in all. An event's violations lie side by side, so each event is one row before any shuffle."""
    v = availability_violations(spark, sf_dir)
    groups = [F.struct(F.lit(c).alias("cutoff_view"), F.lit(None).cast("int").alias("lag")) for c in _VIEWS]
    groups += [F.struct(F.lit(None).cast("string").alias("cutoff_view"), F.lit(n).alias("lag")) for n in range(1, 9)]
    groups += [F.struct(F.lit(None).cast("string").alias("cutoff_view"), F.lit(None).cast("int").alias("lag"))]
    among = [*[F.col("cutoff_view") == c for c in _VIEWS], *[F.col("lag") == n for n in range(1, 9)], F.lit(True)]
    per_event = v.groupBy("event_key").agg(*[a for i, w in enumerate(among) for a in (F.count_if(w).alias(f"n{i}"), F.min(F.when(w, F.col("gap_days"))).alias(f"g{i}"))])
    sums = per_event.agg(*[a for i in range(len(among)) for a in (F.sum(f"n{i}").alias(f"n{i}"), F.count_if(F.col(f"n{i}") > 0).alias(f"e{i}"), F.min(f"g{i}").alias(f"g{i}"))])
    rows = [F.struct(g["cutoff_view"].alias("cutoff_view"), g["lag"].alias("lag"), F.col(f"n{i}").alias("n_violations"), F.col(f"e{i}").alias("n_events"),
                     F.col(f"g{i}").alias("min_gap_days")) for i, g in enumerate(groups)]
    return sums.select(F.inline(F.array(*rows))).where("n_violations > 0")


# ---------------------------------------------------------------- series windows

@query("series_lag_changes", sql("wk", """
SELECT series, observed, round(value - lag(value, 1) OVER w, 2) AS change_1, round(value - lag(value, 4) OVER w, 2) AS change_4,
  round(value - lag(value, 13) OVER w, 2) AS change_13 FROM wk WINDOW w AS (PARTITION BY series ORDER BY observed)"""))
def series_lag_changes(spark, sf_dir):
    out = ro.lag_changes(an.weekly_long(spark, sf_dir), by=["series"], on="observed", value="value",
                         lags={1: "change_1", 4: "change_4", 13: "change_13"})
    return out.select("series", "observed", *[F.round(c, 2).alias(c) for c in ("change_1", "change_4", "change_13")])


@query("past_zscore", sql("wk", """
SELECT series, observed, CASE WHEN count(value) OVER w >= 13 THEN
  round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) END AS zscore
FROM wk WINDOW w AS (PARTITION BY series ORDER BY observed ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)"""))
def past_zscore(spark, sf_dir):
    out = ro.past_zscore(an.weekly_long(spark, sf_dir), by=["series"], on="observed", value="value", out="zscore")
    return out.select("series", "observed", F.round("zscore", 6).alias("zscore"))


@query("realised_volatility", sql("dy", """
, s AS (SELECT *, (value - lag(value) OVER (PARTITION BY series ORDER BY observed)) * 100 AS step,
   (value - lag(value, 5) OVER (PARTITION BY series ORDER BY observed)) * 100 AS c5 FROM dy)
SELECT series, observed, round(step, 6) AS change_1, round(c5, 6) AS change_5,
  CASE WHEN count(step) OVER (PARTITION BY series ORDER BY observed ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) >= 5 THEN
   round(stddev_samp(step) OVER (PARTITION BY series ORDER BY observed ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 5) END AS vol_5,
  CASE WHEN count(step) OVER (PARTITION BY series ORDER BY observed ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 20 THEN
   round(stddev_samp(step) OVER (PARTITION BY series ORDER BY observed ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 5) END AS vol_20
FROM s"""))
def realised_volatility(spark, sf_dir):
    d = ro.lag_changes(an.daily_long(spark, sf_dir), by=["series"], on="observed", value="value",
                       lags={1: "change_1", 5: "change_5"})
    d = ro.realised_volatility(d, by=["series"], on="observed", value="value", windows={5: "vol_5", 20: "vol_20"})
    return d.select("series", "observed", *[F.round(F.col(c) * 100, 6).alias(c) for c in ("change_1", "change_5")],
                    *[F.round(c, 5).alias(c) for c in ("vol_5", "vol_20")])


@query("largest_gap", sql("ev", """
, d AS (SELECT DISTINCT entity_id, event_date FROM ev),
g AS (SELECT entity_id, event_date AS gap_end, lag(event_date) OVER (PARTITION BY entity_id ORDER BY event_date) AS gap_start FROM d)
SELECT entity_id, CAST(gap_end - gap_start AS INTEGER) AS max_gap_days, gap_start, gap_end FROM g WHERE gap_end - gap_start > 150
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY gap_end - gap_start DESC, gap_end) = 1
"""))
def largest_gap(spark, sf_dir):
    return ro.largest_gap(an.events(spark, sf_dir), by=["entity_id"], on="event_date", threshold=150)
