"""Queries over as-of joins, the predictor matrix and its gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arithmetic as ar, dates as dt
from ..operators import asof, calendar as cal, features as fe, gates as ga, quality as qu, rolling as ro
from ..session import materialise
from ..sources import normalize as no
from . import analogs as an, matrix as mx
from .oracle import cte, sql, weekdays_to

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


CUTOFFS = {"announcement": "announcement_cutoff", "pre_event": "pre_event_cutoff"}

cte("evm", "evc", """
SELECT event_key, segment, is_repeat, event_date, amount, 'announcement' AS cutoff_view, announcement_cutoff AS cutoff FROM evc
UNION ALL SELECT event_key, segment, is_repeat, event_date, amount, 'pre_event', pre_event_cutoff FROM evc
""")


@query("asof_release_join", sql("evc wkrel", """
SELECT event_key, r.observed, r.safe_date, r.value_A, CAST(announcement_cutoff - r.observed AS INTEGER) AS age_days,
  r.observed IS NOT NULL AS asof_matched,
  CASE WHEN r.observed IS NULL THEN 'no_release_before_cutoff' WHEN nullif(r.value_N, CASE WHEN r.observed < DATE '1996-01-01' THEN r.value_N END) IS NULL
    AND r.observed < DATE '1996-01-01' THEN 'regime_not_started' END AS reason_n
FROM evc ASOF LEFT JOIN wkrel r ON r.safe_date <= announcement_cutoff"""))
def asof_release_join(spark, sf_dir):
    rel = mx.weekly(spark, sf_dir)
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", "announcement_cutoff")
    out = asof.asof_join(ev, rel, cutoff="announcement_cutoff", safe="safe_date", tie=["observed"])
    reason = fe.missing_reason("asof_matched", "value_N", "observed", regime_start="1996-01-01", none="no_release_before_cutoff")
    return out.select("event_key", "observed", "safe_date", "value_A",
                      F.date_diff("announcement_cutoff", "observed").alias("age_days"), "asof_matched", reason.alias("reason_n"))


@query("asof_daily_join", sql("evc dy cal", f"""
, d AS (SELECT dy.*, nbd AS safe_date FROM dy JOIN cal ON day = observed),
w AS (SELECT observed, max(safe_date) AS safe_date, max(CASE WHEN series = 'A' THEN value END) AS a, max(CASE WHEN series = 'R' THEN value END) AS r FROM d GROUP BY 1),
u AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY safe_date ORDER BY observed DESC) = 1)
SELECT event_key, observed, a AS value_A, r AS value_R, CAST(pre_event_cutoff - observed AS INTEGER) AS age_days,
  CASE WHEN observed IS NOT NULL THEN CAST(greatest({weekdays_to('pre_event_cutoff')} - {weekdays_to('observed')}, 0) AS INTEGER) END AS age_weekdays
FROM evc ASOF LEFT JOIN u ON u.safe_date <= pre_event_cutoff """))
def asof_daily_join(spark, sf_dir):
    wide = no.pivot_first(an.daily_long(spark, sf_dir), index=["observed"], entity="series", entities=an.FLAGS, value="value", prefix="value_")
    daily = cal.with_next_business_day(wide, an.calendar(spark), "observed", "safe_date")
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", "pre_event_cutoff")
    out = asof.asof_join(ev, daily, cutoff="pre_event_cutoff", safe="safe_date", tie=["observed"])
    age = F.date_diff("pre_event_cutoff", "observed")
    return out.select(
        "event_key", "observed", "value_A", "value_R", age.alias("age_days"),
        F.when(F.col("asof_matched"), dt.weekday_count("observed", "pre_event_cutoff")).alias("age_weekdays"))


@query("asof_by_key", sql("evc ct cal", """
, r AS (SELECT contract, observed, open_interest, nbd AS safe_date FROM ct JOIN cal ON day = observed + 3),
e AS (SELECT event_key, CAST(entity_id % 6 AS INTEGER) AS contract, announcement_cutoff FROM evc)
SELECT event_key, e.contract, r.observed, r.open_interest FROM e
ASOF LEFT JOIN r ON r.contract = e.contract AND r.safe_date <= e.announcement_cutoff"""))
def asof_by_key(spark, sf_dir):
    ct = an.contracts_long(spark, sf_dir).withColumn("friday", F.date_add("observed", 3))
    rel = cal.with_next_business_day(ct, an.calendar(spark), "friday", "safe_date").select("contract", "observed", "open_interest", "safe_date")
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", (F.col("entity_id") % 6).cast("int").alias("contract"), "announcement_cutoff")
    out = asof.asof_join(ev, rel, cutoff="announcement_cutoff", safe="safe_date", tie=["observed"], by=["contract"])
    return out.select("event_key", "contract", "observed", "open_interest")


@query("asof_timestamps_by_user", sql("", """
WITH p AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts AS known, value, event_id AS rid FROM events WHERE event_type = 'click')
SELECT p.event_id, r.known, r.value FROM p ASOF LEFT JOIN r ON r.user_id = p.user_id AND r.known < p.ts"""))
def asof_timestamps_by_user(spark, sf_dir):
    e = an.table(spark, sf_dir, "events")
    probes = e.where(F.col("event_type") == "purchase").select("event_id", "ts", "user_id")
    clicks = e.where(F.col("event_type") == "click").select("user_id", F.col("ts").alias("known"), "value", F.col("event_id").alias("rid"))
    out = asof.asof_join_timestamps(probes, clicks, at="ts", safe="known", by=["user_id"], tie=["rid"], bucket="hour", strict=True)
    return out.select("event_id", "known", "value")


cte("vsnap", "vint cal", """
SELECT vintage, observed AS current_observed, value AS current_value, yoy_observed, yoy_value, nominal, nbd AS safe_date FROM (
  SELECT *, lag(value, 12) OVER (PARTITION BY vintage ORDER BY observed) AS yoy_value,
    lag(observed, 12) OVER (PARTITION BY vintage ORDER BY observed) AS yoy_observed,
    least(vintage + 24, last_day(vintage)) AS nominal FROM vint) q JOIN cal ON day = nominal
QUALIFY row_number() OVER (PARTITION BY vintage ORDER BY observed DESC) = 1
""")


@query("vintage_snapshot", sql("vsnap", "SELECT vintage, current_observed, current_value, yoy_observed, yoy_value FROM vsnap"))
def vintage_snapshot(spark, sf_dir):
    return asof.vintage_snapshot(an.vintages_long(spark, sf_dir), by=["vintage"], observed="observed", value="value", yoy_lag=12)


@query("vintage_asof_join", sql("evc vsnap", """
SELECT event_key, vintage, current_observed, current_value, CAST(announcement_cutoff - safe_date AS INTEGER) AS vintage_lag_days,
  CAST(announcement_cutoff - current_observed AS INTEGER) AS observation_age_days, round(current_value - yoy_value, 2) AS level_yoy_change,
  round((current_value / yoy_value - 1) * 100, 6) AS pct_yoy_change, CASE WHEN vintage IS NULL THEN 'no_vintage_before_cutoff' END AS missing_reason,
  coalesce(current_observed < vintage - INTERVAL 1 MONTH, false) AS source_gap
FROM evc ASOF LEFT JOIN vsnap ON safe_date <= announcement_cutoff"""))
def vintage_asof_join(spark, sf_dir):
    v = an.vintages_long(spark, sf_dir)
    snap = asof.vintage_snapshot(v, by=["vintage"], observed="observed", value="value", yoy_lag=12)
    y, m = F.year("vintage"), F.month("vintage")
    index = v.select("vintage").distinct().withColumn("nominal", dt.clamped_day(y, m, 25)).withColumn(
        "expected", dt.expected_latest_period(y, m, "monthly"))
    index = cal.with_next_business_day(index, an.calendar(spark), "nominal", "safe_date")
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", "announcement_cutoff")
    out = asof.vintage_asof_join(ev, index, snap, cutoff="announcement_cutoff", vintage=["vintage"], safe="safe_date",
                                 tie=["nominal"], expected="expected")
    return out.select("event_key", "vintage", "current_observed", "current_value", "vintage_lag_days", "observation_age_days",
                      F.round("level_yoy_change", 2).alias("level_yoy_change"), F.round("pct_yoy_change", 6).alias("pct_yoy_change"),
                      "missing_reason", "source_gap")


@query("vintage_asof_all_variables", sql("evc cal", """
, c AS (SELECT l_returnflag AS variable, CAST(date_trunc('month', o_orderdate) AS DATE) AS booked, CAST(date_trunc('month', l_shipdate) AS DATE) AS observed,
    sum(l_quantity) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
v AS (SELECT variable, vintage, observed, sum(q) AS value FROM c JOIN (SELECT DISTINCT booked AS vintage FROM c) m
    ON booked <= vintage AND observed <= vintage GROUP BY 1, 2, 3),
s AS (SELECT variable, vintage, arg_max(value, observed) AS value, nbd AS safe_date FROM v JOIN cal ON day = vintage + 24 GROUP BY 1, 2, nbd)
SELECT event_key, a.value AS "A__level", n.value AS "N__level", r.value AS "R__level" FROM evc
ASOF LEFT JOIN (SELECT * FROM s WHERE variable = 'A') a ON a.safe_date <= announcement_cutoff
ASOF LEFT JOIN (SELECT * FROM s WHERE variable = 'N') n ON n.safe_date <= announcement_cutoff
ASOF LEFT JOIN (SELECT * FROM s WHERE variable = 'R') r ON r.safe_date <= announcement_cutoff"""))
def vintage_asof_all_variables(spark, sf_dir):
    snap = mx.variable_snapshots(spark, sf_dir)
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", "announcement_cutoff")
    long = ev.select("*", F.explode(F.array(*[F.lit(v) for v in an.FLAGS])).alias("variable"))
    hit = asof.asof_join(long, snap, cutoff="announcement_cutoff", safe="safe_date", tie=["vintage"], by=["variable"], keep=["value"])
    return hit.groupBy("event_key").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(f"{v}__level") for v in an.FLAGS])


@query("naive_versus_safe", sql("evc wkrel", """
SELECT event_key, s.observed AS safe_observed, n.observed AS naive_observed FROM evc
ASOF LEFT JOIN wkrel s ON s.safe_date <= announcement_cutoff
ASOF LEFT JOIN wkrel n ON n.published_date <= announcement_cutoff
WHERE n.observed IS NOT NULL AND s.observed IS DISTINCT FROM n.observed"""))
def naive_versus_safe(spark, sf_dir):
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", "announcement_cutoff")
    return fe.naive_versus_safe(ev, mx.weekly(spark, sf_dir), cutoff="announcement_cutoff", safe="safe_date", naive="published_date",
                                observed="observed").select("event_key", "safe_observed", "naive_observed")


@query("join_table_both_cutoffs", sql("evc wkrel", """
SELECT event_key, a.observed AS announcement__observed, a.value_A AS announcement__value_A, p.observed AS pre_event__observed, p.value_A AS pre_event__value_A
FROM evc ASOF LEFT JOIN wkrel a ON a.safe_date <= announcement_cutoff ASOF LEFT JOIN wkrel p ON p.safe_date <= pre_event_cutoff"""))
def join_table_both_cutoffs(spark, sf_dir):
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", *CUTOFFS.values())
    out = asof.asof_join_cutoffs(ev, mx.weekly(spark, sf_dir), cutoffs=CUTOFFS, safe="safe_date", tie=["observed"], values=["observed", "value_A"])
    return out.drop(*CUTOFFS.values())


@query("between_cutoff_updates", sql("evc wkrel", """
SELECT event_key, CAST(pre_event_cutoff - announcement_cutoff AS INTEGER) AS gap_days,
  CASE WHEN p.observed IS NULL THEN false WHEN a.observed IS NULL THEN true ELSE a.observed <> p.observed END AS new_release,
  round(p.value_A - a.value_A, 2) AS value_A_change
FROM evc ASOF LEFT JOIN wkrel a ON a.safe_date <= announcement_cutoff ASOF LEFT JOIN wkrel p ON p.safe_date <= pre_event_cutoff"""))
def between_cutoff_updates(spark, sf_dir):
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", *CUTOFFS.values())
    table = asof.asof_join_cutoffs(ev, mx.weekly(spark, sf_dir), cutoffs=CUTOFFS, safe="safe_date", tie=["observed"], values=["observed", "value_A"])
    out = fe.cutoff_updates(table, key=["event_key"], first="announcement", second="pre_event", cutoffs=CUTOFFS,
                            identities={"new_release": "observed"}, changes=["value_A"])
    return out.withColumn("value_A_change", F.round("value_A_change", 2))


@query("join_coverage", sql("evc wkrel", """
SELECT segment, count(*) AS n_events, count(r.observed) AS n_matched, median(announcement_cutoff - r.observed) AS median_age,
  count(r.value_A) AS "value_A_n_available", count(r.value_R) AS "value_R_n_available"
FROM evc ASOF LEFT JOIN wkrel r ON r.safe_date <= announcement_cutoff GROUP BY 1"""))
def join_coverage(spark, sf_dir):
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", "segment", "announcement_cutoff")
    j = asof.asof_join(ev, mx.weekly(spark, sf_dir), cutoff="announcement_cutoff", safe="safe_date", tie=["observed"])
    j = j.withColumn("age", F.date_diff("announcement_cutoff", "observed"))
    return qu.join_coverage(j, by=["segment"], matched="asof_matched", age="age", series=["value_A", "value_R"])


@query("missing_reason_breakdown", sql("evc wkrel", """
, j AS (SELECT r.observed FROM evc ASOF LEFT JOIN wkrel r ON r.safe_date <= announcement_cutoff),
x AS (SELECT 'value_A' AS series, CASE WHEN observed IS NULL THEN 'no_release_before_cutoff' WHEN observed < DATE '1995-06-01' THEN 'regime_not_started' END AS reason FROM j
UNION ALL SELECT 'value_N', CASE WHEN observed IS NULL THEN 'no_release_before_cutoff' WHEN observed < DATE '1997-01-01' THEN 'regime_not_started' END FROM j)
SELECT series, reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY 1, 2"""))
def missing_reason_breakdown(spark, sf_dir):
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", "announcement_cutoff")
    rel = mx.weekly(spark, sf_dir)
    for c, start in (("value_A", "1995-06-01"), ("value_N", "1997-01-01")):
        rel = rel.withColumn(c, F.when(F.col("observed") >= F.lit(start).cast("date"), F.col(c)))
    j = asof.asof_join(ev, rel, cutoff="announcement_cutoff", safe="safe_date", tie=["observed"])
    for c, start in (("value_A", "1995-06-01"), ("value_N", "1997-01-01")):
        j = j.withColumn(f"{c}_reason", F.concat(fe.missing_reason("asof_matched", c, "observed", regime_start=start,
                                                                   none="no_release_before_cutoff"), F.lit(f" (starts {start})")))
    return qu.missing_reason_counts(j, {c: f"{c}_reason" for c in ("value_A", "value_N")})


@query("segment_matched_pick", sql("evc dy cal", """
, w AS (SELECT observed, max(CASE WHEN series = 'A' THEN value END) AS a, max(CASE WHEN series = 'N' THEN value END) AS n,
    max(CASE WHEN series = 'R' THEN value END) AS r FROM dy GROUP BY 1),
u AS (SELECT w.*, nbd AS safe_date FROM w JOIN cal ON day = observed QUALIFY row_number() OVER (PARTITION BY nbd ORDER BY observed DESC) = 1)
SELECT event_key, CASE WHEN segment IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'A' WHEN segment = '2-HIGH' THEN 'N' WHEN segment = '3-MEDIUM' THEN 'R' END AS matched_label,
  CASE WHEN segment IN ('1-URGENT', '4-NOT SPECIFIED') THEN a WHEN segment = '2-HIGH' THEN n WHEN segment = '3-MEDIUM' THEN r END AS matched_level,
  CASE WHEN segment = '2-HIGH' THEN 'A' WHEN segment = '3-MEDIUM' THEN 'N' END AS lower_label,
  CASE WHEN segment = '2-HIGH' THEN a WHEN segment = '3-MEDIUM' THEN n END AS lower_level,
  CASE WHEN segment IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'N' WHEN segment = '2-HIGH' THEN 'R' END AS higher_label,
  CASE WHEN segment IN ('1-URGENT', '4-NOT SPECIFIED') THEN n WHEN segment = '2-HIGH' THEN r END AS higher_level,
  round((r - a) * 100, 6) AS slope_bps, round((2 * n - a - r) * 100, 6) AS butterfly_bps
FROM evc ASOF LEFT JOIN u ON u.safe_date <= announcement_cutoff"""))
def segment_matched_pick(spark, sf_dir):
    wide = no.pivot_first(an.daily_long(spark, sf_dir), index=["observed"], entity="series", entities=an.FLAGS, value="value")
    daily = cal.with_next_business_day(wide, an.calendar(spark), "observed", "safe_date")
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", "segment", "announcement_cutoff")
    j = asof.asof_join(ev, daily, cutoff="announcement_cutoff", safe="safe_date", tie=["observed"])
    out = fe.matched_pick(j, segment="segment", mapping=mx.SEGMENT_LABEL, order=an.FLAGS)
    return out.select("event_key", "matched_label", "matched_level", "lower_label", "lower_level", "higher_label", "higher_level",
                      F.round(ar.slope_bps("A", "R"), 6).alias("slope_bps"), F.round(ar.butterfly_bps("A", "N", "R"), 6).alias("butterfly_bps"))


@query("segment_matched_positions", sql("evc ct cal", """
, r AS (SELECT c.observed, nbd AS safe_date, max(CASE WHEN contract = 0 THEN open_interest END) AS o0, max(CASE WHEN contract = 1 THEN open_interest END) AS o1,
    max(CASE WHEN contract = 4 AND c.observed >= DATE '1996-01-01' THEN open_interest END) AS o4,
    max(CASE WHEN contract = 0 THEN long_qty - short_qty END) AS n0, max(CASE WHEN contract = 1 THEN long_qty - short_qty END) AS n1,
    max(CASE WHEN contract = 4 AND c.observed >= DATE '1996-01-01' THEN long_qty - short_qty END) AS n4
  FROM ct c JOIN cal ON day = c.observed + 3 GROUP BY 1, 2),
j AS (SELECT event_key, segment, r.* FROM evc ASOF LEFT JOIN r ON r.safe_date <= announcement_cutoff),
k AS (SELECT *, CASE segment WHEN '1-URGENT' THEN '0' WHEN '2-HIGH' THEN '1' WHEN '4-NOT SPECIFIED' THEN '4' END AS code,
  CASE segment WHEN '1-URGENT' THEN o0 WHEN '2-HIGH' THEN o1 WHEN '4-NOT SPECIFIED' THEN o4 END AS oi,
  CASE segment WHEN '1-URGENT' THEN n0 WHEN '2-HIGH' THEN n1 WHEN '4-NOT SPECIFIED' THEN n4 END AS net FROM j)
SELECT event_key, code AS direct_code, CASE segment WHEN '2-HIGH' THEN '2,3' END AS secondary_codes, observed IS NOT NULL AS report_available,
  CASE WHEN observed IS NULL THEN 'no_report_before_cutoff' ELSE 'matched' END AS source_status,
  CASE WHEN code IS NULL THEN 'no_direct_contract' WHEN oi IS NULL THEN 'mapped_but_unavailable' ELSE 'available' END AS direct_status,
  CASE WHEN code IS NULL THEN 'no_direct_contract' WHEN observed IS NULL THEN 'no_report_before_cutoff' END AS direct_missing_reason,
  oi AS matched_open_interest, net AS matched_net, round(net / nullif(oi, 0), 8) AS matched_net_share FROM k"""))
def segment_matched_positions(spark, sf_dir):
    j = mx.positions_joined(spark, sf_dir, "announcement_cutoff")
    out = fe.matched_positions(j, segment="segment", primary=mx.PRIMARY_CONTRACT, all_codes=mx.CONTRACTS_OF, presence="open_interest",
                               values=["open_interest", "net"], matched="asof_matched")
    return out.select("event_key", "direct_code", "secondary_codes", "report_available", "source_status", "direct_status",
                      "direct_missing_reason", "matched_open_interest", "matched_net",
                      F.round(ar.share("matched_net", "matched_open_interest"), 8).alias("matched_net_share"))


@query("position_states", sql("evc ct cal", """
, r AS (SELECT DISTINCT c.observed, nbd AS safe_date FROM ct c JOIN cal ON day = c.observed + 3),
j AS (SELECT segment, r.observed FROM evc ASOF LEFT JOIN r ON r.safe_date <= announcement_cutoff)
SELECT CASE WHEN segment IN ('3-MEDIUM', '5-LOW') AND observed IS NULL THEN 'no_contract_no_report' WHEN segment IN ('3-MEDIUM', '5-LOW') THEN 'no_contract'
  WHEN observed IS NULL THEN 'no_report' ELSE 'matched' END AS state, count(*) AS n FROM j GROUP BY 1"""))
def position_states(spark, sf_dir):
    j = mx.positions_joined(spark, sf_dir, "announcement_cutoff")
    mapped, have = F.col("segment").isin(*mx.PRIMARY_CONTRACT), F.col("asof_matched")
    return qu.state_reconciliation(j, [("no_contract_no_report", ~mapped & ~have), ("no_contract", ~mapped), ("no_report", ~have), ("matched", have)])


@query("inventory_ratio", sql("evc wkrel", """
SELECT event_key, CASE WHEN segment IN ('1-URGENT', '4-NOT SPECIFIED') THEN value_A WHEN segment = '2-HIGH' THEN value_N WHEN segment = '3-MEDIUM' THEN value_R END AS inventory,
  round(CASE WHEN segment IN ('1-URGENT', '4-NOT SPECIFIED') THEN value_A WHEN segment = '2-HIGH' THEN value_N WHEN segment = '3-MEDIUM' THEN value_R END * 1000000 / amount, 2) AS ratio,
  round(value_A + value_N - value_R, 2) AS imbalance, round(ln(1 + amount), 9) AS log_amount
FROM evc ASOF LEFT JOIN wkrel ON safe_date <= announcement_cutoff"""))
def inventory_ratio(spark, sf_dir):
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", "segment", "amount", "announcement_cutoff")
    j = asof.asof_join(ev, mx.weekly(spark, sf_dir), cutoff="announcement_cutoff", safe="safe_date", tie=["observed"])
    pick = fe.case_of("segment", {s: F.col(f"value_{v}") for s, v in mx.SEGMENT_LABEL.items()})
    return j.select("event_key", pick.alias("inventory"), F.round(ar.inventory_ratio(pick, "amount"), 2).alias("ratio"),
                    F.round(ar.imbalance(["value_A", "value_N"], ["value_R"]), 2).alias("imbalance"),
                    F.round(F.log1p("amount"), 9).alias("log_amount"))


@query("position_feature_table", sql("ct", """
SELECT contract, observed, long_qty - short_qty AS net, round(long_qty / nullif(open_interest, 0), 8) AS long_share, round(short_qty / nullif(open_interest, 0), 8) AS short_share,
  (long_qty - short_qty) - lag(long_qty - short_qty, 1) OVER w AS net_change_1, (long_qty - short_qty) - lag(long_qty - short_qty, 4) OVER w AS net_change_4
FROM ct WINDOW w AS (PARTITION BY contract ORDER BY observed)"""))
def position_feature_table(spark, sf_dir):
    ct = an.contracts_long(spark, sf_dir).withColumn("net", ar.net("long_qty", "short_qty"))
    out = ro.lag_changes(ct, by=["contract"], on="observed", value="net", lags={1: "net_change_1", 4: "net_change_4"})
    return out.select("contract", "observed", "net", F.round(ar.share("long_qty", "open_interest"), 8).alias("long_share"),
                      F.round(ar.share("short_qty", "open_interest"), 8).alias("short_share"), "net_change_1", "net_change_4")


@query("worked_example", sql("evc wkrel", """
, m AS (SELECT e.event_key, e.event_date, e.announcement_cutoff, a.observed AS oa, p.observed AS op FROM evc e
  ASOF LEFT JOIN wkrel a ON a.safe_date <= announcement_cutoff ASOF LEFT JOIN wkrel p ON p.safe_date <= pre_event_cutoff),
c AS (SELECT * FROM m WHERE oa IS NOT NULL AND op IS NOT NULL ORDER BY event_date DESC, event_key DESC LIMIT 1)
SELECT event_key, observed, safe_date, value_A, observed = oa AS chosen_announcement, observed = op AS chosen_pre_event,
  CASE WHEN observed = oa OR observed = op THEN NULL WHEN safe_date > announcement_cutoff THEN 'not_yet_safe' ELSE 'newer_release_preferred' END AS rejected_because
FROM c JOIN wkrel ON observed <= event_date ORDER BY observed DESC LIMIT 4"""))
def worked_example(spark, sf_dir):
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", "event_date", *CUTOFFS.values())
    return fe.worked_example(ev, mx.weekly(spark, sf_dir), key="event_key", on="event_date", first="announcement_cutoff",
                             second="pre_event_cutoff", safe="safe_date", observed="observed", values=["value_A"], n=4)


# ---------------------------------------------------------------- matrix and gates

cte("mtx", "evm wkrel vsnap", """
SELECT event_key, cutoff_view, cutoff, segment, is_repeat, round(ln(1 + amount), 9) AS log_amount, w.observed AS weekly_observed, w.safe_date AS weekly_safe,
  w.value_A AS weekly_a, w.value_R AS weekly_r, v.vintage AS macro_vintage, v.safe_date AS macro_safe, v.current_value AS macro_level
FROM evm e ASOF LEFT JOIN wkrel w ON w.safe_date <= e.cutoff ASOF LEFT JOIN vsnap v ON v.safe_date <= e.cutoff
""")


@query("predictor_matrix", sql("mtx", """
SELECT event_key, cutoff_view, segment, is_repeat, log_amount, weekly_a, weekly_r, macro_level FROM mtx"""))
def predictor_matrix(spark, sf_dir):
    return mx.predictor_matrix(mx.joined(spark, sf_dir))


@query("audit_table", sql("mtx", """
SELECT event_key, cutoff_view, weekly_observed AS "weekly__observed", weekly_safe AS "weekly__safe_date", macro_vintage AS "macro__vintage", macro_safe AS "macro__safe_date" FROM mtx"""))
def audit_table(spark, sf_dir):
    return mx.audit_table(mx.joined(spark, sf_dir))


@query("target_table", sql("outc", """
SELECT event_key, round(primary_share, 9) AS primary_share, round(direct_share, 9) AS direct_share, round(indirect_share, 9) AS indirect_share,
  public_total FROM outc WHERE results_available"""))
def target_table(spark, sf_dir):
    o = an.outcomes(spark, sf_dir).where("results_available")
    return o.select("event_key", *[F.round(c, 9).alias(c) for c in ("primary_share", "direct_share", "indirect_share")], "public_total")


@query("modelling_frame", sql("mtx outc", """
SELECT m.event_key, cutoff_view, log_amount, weekly_a, round(primary_share, 9) AS primary_share FROM mtx m JOIN outc o ON o.event_key = m.event_key WHERE results_available"""))
def modelling_frame(spark, sf_dir):
    """Pending events are set apart first; what is left must have the same keys on both sides."""
    done = an.outcomes(spark, sf_dir).where("results_available").select("event_key")
    matrix = mx.predictor_matrix(mx.joined(spark, sf_dir)).join(done, "event_key", "left_semi")
    return ga.one_to_one(matrix, target_table(spark, sf_dir), key="event_key").select(
        "event_key", "cutoff_view", "log_amount", "weekly_a", "primary_share")


@query("availability_audit", sql("mtx", """
SELECT cutoff_view, 'weekly' AS source, count(weekly_safe) AS n_matched, count_if(weekly_safe > cutoff) AS n_violations, CAST(max(cutoff - weekly_safe) AS INTEGER) AS max_lag_days FROM mtx GROUP BY 1
UNION ALL SELECT cutoff_view, 'macro', count(macro_safe), count_if(macro_safe > cutoff), CAST(max(cutoff - macro_safe) AS INTEGER) FROM mtx GROUP BY 1"""))
def availability_audit(spark, sf_dir):
    return ga.availability_summary(mx.joined(spark, sf_dir), cutoff="cutoff", by="cutoff_view",
                                   sources={"weekly": "weekly__safe_date", "macro": "macro__safe_date"})


@query("availability_late_keys", sql("mtx", """
SELECT cutoff_view, 'weekly' AS source, event_key, CAST(weekly_safe - (cutoff - 9) AS INTEGER) AS days_late FROM mtx WHERE event_key % 97 = 0 AND weekly_safe > cutoff - 9
UNION ALL SELECT cutoff_view, 'macro', event_key, CAST(macro_safe - (cutoff - 9) AS INTEGER) FROM mtx WHERE event_key % 97 = 0 AND macro_safe > cutoff - 9"""))
def availability_late_keys(spark, sf_dir):
    """The same audit on a table spoiled on purpose: every 97th event was joined nine days too late."""
    spoiled = mx.joined(spark, sf_dir).withColumn("cutoff", F.when(F.expr("event_key % 97 = 0"), F.date_sub("cutoff", 9)).otherwise(F.col("cutoff")))
    return ga.late_keys(spoiled, cutoff="cutoff", by="cutoff_view", sources={"weekly": "weekly__safe_date", "macro": "macro__safe_date"})


@query("cutoff_monotonicity", sql("evc wkrel", """
SELECT count(*) AS n_events, count_if(pre_event_cutoff < announcement_cutoff) AS n_cutoffs_reversed,
  count_if(pre_event_cutoff >= announcement_cutoff AND p.observed < a.observed) AS n_earlier,
  count_if(pre_event_cutoff >= announcement_cutoff AND a.observed IS NOT NULL AND p.observed IS NULL) AS n_lost
FROM evc ASOF LEFT JOIN wkrel a ON a.safe_date <= announcement_cutoff ASOF LEFT JOIN wkrel p ON p.safe_date <= pre_event_cutoff"""))
def cutoff_monotonicity(spark, sf_dir):
    ev = an.events_with_cutoffs(spark, sf_dir).select("event_key", *CUTOFFS.values())
    t = asof.asof_join_cutoffs(ev, mx.weekly(spark, sf_dir), cutoffs=CUTOFFS, safe="safe_date", tie=["observed"], values=["observed"])
    return ga.monotonicity(t, cutoffs=CUTOFFS.values(), earlier="announcement__observed", later="pre_event__observed")


@query("key_set_audit", sql("mtx outc", """
SELECT (SELECT count(*) FROM mtx) AS n_rows, (SELECT count(DISTINCT event_key) FROM mtx) AS n_keys, 0 AS n_duplicate_keys,
  (SELECT count(*) FROM (SELECT event_key FROM outc WHERE NOT results_available)) AS n_extra, 0 AS n_missing"""))
def key_set_audit(spark, sf_dir):
    m = mx.predictor_matrix(mx.joined(spark, sf_dir))
    return ga.key_audit(m, target_table(spark, sf_dir), key=["event_key"], unique=["event_key", "cutoff_view"])


@query("matrix_digests")
def matrix_digests(spark, sf_dir):
    from ..sources.sinks import content_digest

    return content_digest(mx.predictor_matrix(mx.joined(spark, sf_dir)))


@query("publishable_matrix", sql("mtx", "SELECT cutoff_view, count(*) AS n, count(weekly_a) AS n_weekly FROM mtx GROUP BY 1"))
def publishable_matrix(spark, sf_dir):
    """Gates run on the staged copy; only then does it become current."""
    import uuid

    from ..session import scratch_dir
    from ..sources.sinks import publish, read_current

    root = f"{scratch_dir(spark)}/matrix-{uuid.uuid4().hex}"
    matrix = mx.predictor_matrix(mx.joined(spark, sf_dir))
    publish(matrix, root, gates=ga.matrix_gates(key=["event_key", "cutoff_view"], required=["event_key", "segment"],
                                                 contract=mx.CONTRACT, forbidden=mx.FORBIDDEN), partition_by=["cutoff_view"])
    return read_current(spark, root).groupBy("cutoff_view").agg(F.count("*").alias("n"), F.count("weekly_a").alias("n_weekly"))
