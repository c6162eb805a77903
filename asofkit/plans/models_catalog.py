"""Queries over folds, models, labels and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import baselines as bl, intervals as iv, labels as la, shrinkage as sh, surprise as su
from ..operators import folds as fo, metrics as me, rolling as ro
from ..session import materialise
from ..sources.sinks import nested_records
from . import analogs as an, backtest as bt
from .oracle import cte, sql

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


P = bt.POOL

cte("folds", "pool", """
SELECT event_year AS test_year, min(announcement_cutoff) AS fit_origin, event_year > 2000 AS is_provisional FROM pool WHERE event_year >= 1997 GROUP BY 1
""")
cte("tr", "folds pool", """
SELECT f.test_year, f.fit_origin, p.* FROM pool p JOIN folds f ON p.event_year < f.test_year AND p.result_safe_date <= f.fit_origin
""")
cte("te", "folds pool", "SELECT f.*, p.* FROM pool p JOIN folds f ON p.event_year = f.test_year")
cte("trs", "tr", "SELECT * FROM tr WHERE primary_share IS NOT NULL")
cte("g0", "trs", "SELECT test_year, count(*) AS n, avg(primary_share) AS m FROM trs GROUP BY 1")
cte("g1", "trs", "SELECT test_year, segment, count(*) AS n, avg(primary_share) AS m, var_samp(primary_share) AS v FROM trs GROUP BY 1, 2")
cte("g2", "trs", "SELECT test_year, segment, is_repeat, count(*) AS n, avg(primary_share) AS m, var_samp(primary_share) AS v FROM trs GROUP BY 1, 2, 3")
cte("rec", "trs", """
SELECT test_year, segment, avg(primary_share) AS m, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY test_year, segment ORDER BY event_date DESC, event_key DESC) AS rn FROM trs) q WHERE rn <= 8 GROUP BY 1, 2
""")
cte("adp", "pool", """
SELECT event_key, list_avg(list_transform(list_filter(coalesce(a.items, []), lambda x: x.k <> event_key), lambda x: x.v)) AS announcement,
  list_avg(list_transform(list_filter(coalesce(b.items, []), lambda x: x.k <> event_key), lambda x: x.v)) AS pre_event
FROM pool p
ASOF LEFT JOIN last8 a ON a.segment = p.segment AND a.known <= p.announcement_cutoff
ASOF LEFT JOIN last8 b ON b.segment = p.segment AND b.known <= p.pre_event_cutoff
""")
cte("last8", "pool", """
SELECT segment, known, arg_max(items, (event_date, event_key)) AS items FROM (
  SELECT segment, result_safe_date AS known, event_date, event_key,
    list({'k': event_key, 'v': primary_share}) OVER (PARTITION BY segment ORDER BY result_safe_date, event_date, event_key
      ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS items FROM pool WHERE primary_share IS NOT NULL) q GROUP BY 1, 2
""")
from .oracle import CTES  # noqa: E402

CTES["adp"] = (("pool", "last8"), CTES["adp"][1])


def _moments(name: str, source: str, keys: str) -> None:
    cte(name, f"{source} g0", f"""
SELECT t.test_year, CASE WHEN k < 2 THEN 0 ELSE within_v / greatest(CASE WHEN n0 > 0 THEN (ssb / (k - 1) - within_v) / n0 ELSE 0 END, 1e-8) END AS ratio, k < 2 AS single
FROM (SELECT g.test_year, count(*) AS k, sum(g.n) AS nt, sum(g.n * (g.m - g0.m) * (g.m - g0.m)) AS ssb,
    sum(CASE WHEN g.n > 1 THEN (g.n - 1) * g.v ELSE 0 END) / (sum(g.n) - count(*)) AS within_v,
    (sum(g.n) - sum(g.n * g.n) / sum(g.n)) / nullif(count(*) - 1, 0) AS n0
  FROM {source} g JOIN g0 USING (test_year) GROUP BY 1) t
""")


_moments("mo1", "g1", "segment")
_moments("mo2", "g2", "segment, is_repeat")
cte("sh1", "g1 g0 mo1", """
SELECT test_year, segment, g0.m AS global_mean, w * g1.m + (1 - w) * g0.m AS est FROM g1 JOIN g0 USING (test_year)
JOIN mo1 USING (test_year), LATERAL (SELECT CASE WHEN single THEN 1 ELSE g1.n / (g1.n + ratio) END AS w) x
""")
cte("sh2", "g2 sh1 mo2", """
SELECT test_year, segment, is_repeat, g2.n, w AS weight, sh1.est AS prior, w * g2.m + (1 - w) * sh1.est AS est, global_mean
FROM g2 JOIN sh1 USING (test_year, segment) JOIN mo2 USING (test_year), LATERAL (SELECT CASE WHEN single THEN 1 ELSE g2.n / (g2.n + ratio) END AS w) x
""")
cte("predw", "te g0 g1 g2 rec adp sh1 sh2", """
SELECT t.test_year, t.is_provisional, t.event_key, t.segment, t.is_repeat, t.primary_share AS actual, g0.m AS global_mean, coalesce(g1.m, g0.m) AS segment_mean,
  coalesce(g2.m, g1.m, g0.m) AS segment_repeat_mean, coalesce(rec.m, g0.m) AS recent_frozen, coalesce(sh2.est, sh1.est, g0.m) AS shrinkage,
  coalesce(adp.announcement, g0.m) AS adaptive_a, coalesce(adp.pre_event, g0.m) AS adaptive_p
FROM te t JOIN g0 USING (test_year) LEFT JOIN g1 USING (test_year, segment) LEFT JOIN g2 USING (test_year, segment, is_repeat)
LEFT JOIN rec USING (test_year, segment) LEFT JOIN sh1 USING (test_year, segment) LEFT JOIN sh2 USING (test_year, segment, is_repeat) LEFT JOIN adp USING (event_key)
""")
cte("pred", "predw", """
SELECT event_key, v AS cutoff_view, model_id, test_year, is_provisional, segment, is_repeat, actual,
  CASE model_id WHEN 'global_mean' THEN global_mean WHEN 'segment_mean' THEN segment_mean WHEN 'segment_repeat_mean' THEN segment_repeat_mean
    WHEN 'recent_frozen' THEN recent_frozen WHEN 'shrinkage' THEN shrinkage ELSE CASE v WHEN 'announcement' THEN adaptive_a ELSE adaptive_p END END AS forecast
FROM predw, (VALUES ('announcement'), ('pre_event')) a(v),
  (VALUES ('global_mean'), ('segment_mean'), ('segment_repeat_mean'), ('recent_frozen'), ('shrinkage'), ('recent_adaptive')) b(model_id)
""")
cte("sc", "pred", "SELECT *, (forecast - actual) * 100 AS e FROM pred WHERE actual IS NOT NULL")


def rounded(df, digits=6):
    """Round every double so that summation order does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- folds

@query("rolling_origin_folds", sql("folds te tr pool", """
SELECT f.test_year, f.fit_origin, f.is_provisional, (SELECT count(*) FROM tr WHERE tr.test_year = f.test_year) AS n_train,
  (SELECT count(*) FROM te WHERE te.test_year = f.test_year) AS n_test,
  (SELECT count(*) FROM pool p WHERE p.event_year < f.test_year AND p.result_safe_date > f.fit_origin) AS n_dropped FROM folds f"""))
def rolling_origin_folds(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    return fo.fold_manifest(pool, bt.folds(pool), P).drop("train_digest", "test_digest")


_LIMBS = ", ".join(f"sum(CAST(('0x' || substr(h, {s}, 12)) AS BIGINT))" for s in (1, 13, 25, 37, 49))


@query("fold_manifest_digests", sql("folds te tr", f"""
, a AS (SELECT test_year, sha256(CAST(event_key AS VARCHAR)) AS h FROM tr), b AS (SELECT test_year, sha256(CAST(event_key AS VARCHAR)) AS h FROM te),
x AS (SELECT test_year, sha256(concat_ws(':', count(*), {_LIMBS})) AS train_digest FROM a GROUP BY 1),
y AS (SELECT test_year, sha256(concat_ws(':', count(*), {_LIMBS})) AS test_digest FROM b GROUP BY 1)
SELECT test_year, train_digest, test_digest FROM x JOIN y USING (test_year)"""))
def fold_manifest_digests(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    return fo.fold_manifest(pool, bt.folds(pool), P).select("test_year", "train_digest", "test_digest")


@query("fold_membership", sql("folds pool", """
SELECT f.test_year, CASE WHEN event_year = f.test_year THEN 'test' WHEN result_safe_date <= fit_origin THEN 'train' ELSE 'dropped' END AS role, event_key
FROM pool JOIN folds f ON event_year <= f.test_year"""))
def fold_membership(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    return fo.fold_rows(pool, bt.folds(pool), P)


@query("fold_safety", sql("folds", "SELECT test_year, 0 AS n_late, 0 AS n_overlap FROM folds"))
def fold_safety(spark, sf_dir):
    pool = an.pool(spark, sf_dir).select("event_key", "event_year", "announcement_cutoff", "result_safe_date")
    f = bt.folds(pool)
    return fo.fold_violations(fo.fold_rows(pool, f, P), pool, f, P)


@query("inner_holdouts", sql("tr folds", """
, s AS (SELECT test_year, max(event_year) AS inner_year, count(DISTINCT event_year) AS n_years FROM tr GROUP BY 1),
o AS (SELECT test_year, min(announcement_cutoff) AS inner_origin, count(*) AS nv FROM tr JOIN s USING (test_year) WHERE event_year = inner_year GROUP BY 1),
n AS (SELECT test_year, count(*) AS nt FROM tr JOIN s USING (test_year) JOIN o USING (test_year) WHERE event_year < inner_year AND result_safe_date <= inner_origin GROUP BY 1)
SELECT test_year, n_years, inner_year, inner_origin, coalesce(nt, 0) AS n_inner_train, nv AS n_inner_validation,
  CASE WHEN n_years < 2 THEN 'too_few_years' WHEN coalesce(nt, 0) < 50 THEN 'too_few_rows' END AS reason_unusable, n_years >= 2 AND coalesce(nt, 0) >= 50 AS usable
FROM s JOIN o USING (test_year) LEFT JOIN n USING (test_year)"""))
def inner_holdouts(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    return fo.inner_holdouts(pool, bt.folds(pool), P)


cte("pairs", "tr", """
SELECT test_year, fit_origin, event_year AS inner_year, min(announcement_cutoff) AS inner_origin FROM tr GROUP BY 1, 2, 3
QUALIFY event_year > min(event_year) OVER (PARTITION BY test_year)
""")


@query("walk_forward_pairs", sql("pairs", "SELECT test_year, fit_origin, inner_year, inner_origin FROM pairs"))
def walk_forward_pairs(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    return fo.walk_forward_pairs(pool, bt.folds(pool), P)


@query("candidate_pool_sizes", sql("folds pool", """
SELECT f.test_year, count(*) AS n_candidates FROM pool JOIN folds f ON event_year < f.test_year GROUP BY 1"""))
def candidate_pool_sizes(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    cell = fo.cells(pool, P, [], [F.count("*").alias("n")])
    return cell.join(F.broadcast(bt.folds(pool)), F.col("event_year") < F.col("test_year")).groupBy("test_year").agg(
        F.sum("n").alias("n_candidates"))


# ---------------------------------------------------------------- models

@query("mean_baselines", sql("predw", """
SELECT event_key, test_year, round(global_mean, 8) AS global_mean, round(segment_mean, 8) AS segment_mean, round(segment_repeat_mean, 8) AS segment_repeat_mean FROM predw"""))
def mean_baselines(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    rows = bl.mean_forecasts(pool, bt.folds(pool), P)
    return rounded(rows.select("event_key", "test_year", "global_mean", "segment_mean", "segment_repeat_mean"), 8)


@query("mean_levels", sql("g0 g1 g2", """
SELECT test_year, NULL AS segment, NULL AS is_repeat, 0 AS level, n, round(m, 8) AS mean FROM g0
UNION ALL SELECT test_year, segment, NULL, 1, n, round(m, 8) FROM g1 UNION ALL SELECT test_year, segment, is_repeat, 2, n, round(m, 8) FROM g2"""))
def mean_levels(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    return rounded(bl.mean_levels(pool, bt.folds(pool), P), 8)


@query("recent_history_frozen", sql("rec", "SELECT test_year, segment, round(m, 8) AS recent_mean, n AS n_recent FROM rec"))
def recent_history_frozen(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    return rounded(bl.recent_means(pool, bt.folds(pool), P), 8)


@query("all_baseline_predictions", sql("pred", """
SELECT event_key, cutoff_view, model_id, test_year, is_provisional, segment, is_repeat, round(actual, 8) AS actual, round(forecast, 8) AS forecast FROM pred"""))
def all_baseline_predictions(spark, sf_dir):
    return bt.predictions(spark, sf_dir, places=8)


@query("shrinkage_table", sql("sh2", """
SELECT test_year, segment, is_repeat, n, round(weight, 7) AS weight, round(prior, 8) AS prior, round(est, 8) AS estimate FROM sh2"""))
def shrinkage_table(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    t = sh.shrunk_means(pool, bt.folds(pool), P)
    return t.select("test_year", "segment", "is_repeat", "n", F.round("weight", 7).alias("weight"), F.round("prior", 8).alias("prior"),
                    F.round("estimate", 8).alias("estimate"))


cte("rp", "pool adp", "SELECT pool.*, adp.announcement AS regime FROM pool JOIN adp USING (event_key)")


def _surprise_cte(suffix: str, keys: str, train: str, rows: str) -> None:
    """Fit on `train` per `keys` and score `rows`, row-wise least squares."""
    cte(f"sx{suffix}", train, f"""
SELECT *, ln(amount) AS x, coalesce(regime, avg(regime) OVER (PARTITION BY {keys}), avg(primary_share) OVER (PARTITION BY {keys})) AS r,
  primary_share - avg(primary_share) OVER (PARTITION BY {keys}, segment, is_repeat) AS u FROM {train} WHERE primary_share IS NOT NULL AND amount IS NOT NULL""")
    cte(f"sp{suffix}", f"sx{suffix}", f"""
SELECT {keys}, cx, cr, gm, rf, (s22 * b1 - s12 * b2) / (s11 * s22 - s12 * s12) AS k1, (s11 * b2 - s12 * b1) / (s11 * s22 - s12 * s12) AS k2 FROM (
  SELECT {keys}, avg(x) AS cx, avg(r) AS cr, avg(primary_share) AS gm, coalesce(avg(regime), avg(primary_share)) AS rf, count(*) * var_pop(x) AS s11, count(*) * var_pop(r) AS s22,
    count(*) * covar_pop(x, r) AS s12, count(*) * covar_pop(x, u) AS b1, count(*) * covar_pop(r, u) AS b2 FROM sx{suffix} GROUP BY {keys}) q""")
    cte(f"sg{suffix}", f"sx{suffix}", f"SELECT {keys}, segment, is_repeat, avg(primary_share) AS m FROM sx{suffix} GROUP BY {keys}, segment, is_repeat")
    cte(f"ss{suffix}", f"sp{suffix} sg{suffix} {rows}", f"""
SELECT w.*, coalesce(g.m, p.gm) + k1 * (ln(amount) - cx) + k2 * (coalesce(regime, rf) - cr) AS expected
FROM {rows} w JOIN sp{suffix} p USING ({keys}) LEFT JOIN sg{suffix} g USING ({keys}, segment, is_repeat)""")


cte("rtr", "folds rp", "SELECT f.test_year, p.* FROM rp p JOIN folds f ON p.event_year < f.test_year AND p.result_safe_date <= f.fit_origin")
cte("rte", "folds rp", "SELECT f.test_year, p.* FROM rp p JOIN folds f ON p.event_year = f.test_year")
_surprise_cte("1", "test_year", "rtr", "rte")
cte("ptr", "pairs rp", """SELECT q.test_year, q.inner_year, p.* FROM rp p JOIN pairs q ON p.event_year < q.inner_year AND p.result_safe_date <= q.inner_origin
 AND p.result_safe_date <= q.fit_origin""")
cte("pte", "pairs rp", "SELECT q.test_year, q.inner_year, p.* FROM rp p JOIN pairs q ON p.event_year = q.inner_year AND p.result_safe_date <= q.fit_origin WHERE primary_share IS NOT NULL")
_surprise_cte("2", "test_year, inner_year", "ptr", "pte")


@query("surprise_walk_forward", sql("ss1", """
SELECT event_key, test_year, round(expected, 7) AS expected, round(primary_share - expected, 7) AS surprise FROM ss1"""))
def surprise_walk_forward(spark, sf_dir):
    pool = bt.regime_pool(spark, sf_dir)
    out = su.walk_forward_surprise(pool, bt.folds(pool), P, "regime")
    return rounded(out.select("event_key", "test_year", "expected", "surprise"), 7)


cte("op", "pool", """
SELECT *, avg(primary_share) OVER (PARTITION BY segment ORDER BY event_date, event_key ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS regime FROM pool""")
cte("dtr", "op", "SELECT y.event_year AS test_year, op.* FROM op JOIN (SELECT DISTINCT event_year FROM op WHERE event_year > 1995) y ON op.event_year < y.event_year")
cte("dte", "op", "SELECT event_year AS test_year, * FROM op WHERE event_year > 1995")
_surprise_cte("3", "test_year", "dtr", "dte")


@query("surprise_descriptive", sql("ss3", "SELECT event_key, test_year, round(primary_share - expected, 7) AS surprise FROM ss3"))
def surprise_descriptive(spark, sf_dir):
    pool = ro.order_trailing_mean(bt.staged_pool(spark, sf_dir), by=["segment"], order=["event_date", "event_key"], value="primary_share", out="regime", chunk=an.event_chunk())
    return rounded(su.descriptive_surprise(pool, P, "regime").select("event_key", "test_year", "surprise"), 7)


cte("thr", "ss2", "SELECT test_year, quantile_cont(primary_share - expected, 0.9) AS threshold FROM ss2 GROUP BY 1")


@query("stress_labels", sql("ss1 ss2 thr", """
SELECT test_year, 'train' AS role, event_key, round(primary_share - expected, 7) AS surprise, primary_share - expected >= threshold AS label FROM ss2 JOIN thr USING (test_year)
UNION ALL SELECT test_year, 'test', event_key, round(primary_share - expected, 7), primary_share - expected >= threshold FROM ss1 LEFT JOIN thr USING (test_year)"""))
def stress_labels(spark, sf_dir):
    pool = bt.regime_pool(spark, sf_dir)
    return rounded(la.stress_labels(pool, bt.folds(pool), P), 7)


@query("inner_holdout_labels")
def inner_holdout_labels(spark, sf_dir):
    pool = bt.regime_pool(spark, sf_dir)
    f = bt.folds(pool)
    return la.inner_holdout_labels(pool, fo.inner_holdouts(pool, f, P), f, P)


@query("percentile_thresholds", sql("ss1", """
, s AS (SELECT primary_share - expected AS x FROM ss1 WHERE primary_share IS NOT NULL),
t AS (SELECT p AS percentile, (SELECT quantile_cont(x, [0.75, 0.8, 0.9, 0.95]) FROM s)[i] AS threshold FROM (VALUES (1, 0.75), (2, 0.8), (3, 0.9), (4, 0.95)) v(i, p))
SELECT CAST(percentile AS DOUBLE) AS percentile, round(threshold, 7) AS threshold, count(*) AS n_train, count_if(x >= threshold) AS n_flagged,
  round(count_if(x >= threshold) / count(*), 7) AS fraction_flagged FROM t, s GROUP BY 1, 2"""))
def percentile_thresholds(spark, sf_dir):
    pool = bt.regime_pool(spark, sf_dir)
    out = materialise(su.walk_forward_surprise(pool, bt.folds(pool), P, "regime").select("surprise"))
    return rounded(la.percentile_thresholds(out, value="surprise"), 7)


@query("sufficiency_gate", sql("ss1 thr", """
, y AS (SELECT test_year, count(primary_share) AS n, count_if(primary_share - expected >= threshold) AS p FROM ss1 JOIN thr USING (test_year) GROUP BY 1)
SELECT CAST(sum(p) AS BIGINT) AS pooled_positives, CAST(sum(n) AS BIGINT) AS pooled_labelled, sum(p) >= 30 AS passes,
  coalesce(string_agg(CASE WHEN p >= 200 THEN test_year END, ',' ORDER BY test_year), '') AS years_reported,
  coalesce(string_agg(CASE WHEN p < 200 THEN test_year END, ',' ORDER BY test_year), '') AS years_suppressed FROM y"""))
def sufficiency_gate(spark, sf_dir):
    pool = bt.regime_pool(spark, sf_dir)
    labels = la.stress_labels(pool, bt.folds(pool), P).where("role = 'test'")
    return me.sufficiency_gate(labels, [], year="test_year", label="label", min_year=200)


cte("prec", "ptr", """
SELECT test_year, inner_year, segment, avg(primary_share) AS m FROM (
  SELECT *, row_number() OVER (PARTITION BY test_year, inner_year, segment ORDER BY event_date DESC, event_key DESC) AS rn FROM ptr WHERE primary_share IS NOT NULL) q
WHERE rn <= 8 GROUP BY 1, 2, 3""")
cte("pgl", "ptr", "SELECT test_year, inner_year, avg(primary_share) AS g FROM ptr GROUP BY 1, 2")
cte("resid", "pte prec pgl", """
SELECT test_year, segment, event_key, primary_share - coalesce(m, g) AS residual FROM pte JOIN pgl USING (test_year, inner_year) LEFT JOIN prec USING (test_year, inner_year, segment)
WHERE coalesce(m, g) IS NOT NULL""")


@query("walk_forward_residuals", sql("resid", "SELECT test_year, segment, event_key, round(residual, 8) AS residual FROM resid"))
def walk_forward_residuals(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    return rounded(iv.walk_forward_residuals(pool, bt.folds(pool), P), 8)


_QL = "[0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]"
cte("offs", "resid", f"""
SELECT test_year, segment, quantile_cont(residual, {_QL}) AS q, count(*) AS n FROM resid GROUP BY 1, 2 HAVING count(*) >= 30
UNION ALL SELECT test_year, NULL, quantile_cont(residual, {_QL}), count(*) FROM resid GROUP BY 1""")
cte("ivr", "predw offs", """
SELECT event_key, w.test_year, is_provisional, w.segment, is_repeat, actual, list_sort(list_transform(coalesce(o.q, p.q, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), lambda x: recent_frozen + x)) AS s
FROM predw w LEFT JOIN offs o ON o.test_year = w.test_year AND o.segment = w.segment LEFT JOIN offs p ON p.test_year = w.test_year AND p.segment IS NULL""")
_CLIP = ", ".join(f"greatest(0.0, least(1.0, s[{i}])) AS {c}" for i, c in enumerate(["q05", "q10", "q25", "q50", "q75", "q90", "q95"], 1))
cte("ivq", "ivr", f"SELECT event_key, test_year, is_provisional, segment, is_repeat, actual, {_CLIP} FROM ivr")


@query("residual_offsets", sql("offs", f"SELECT test_year, segment, n, {', '.join(f'round(q[{i + 1}], 8) AS o{i}' for i in range(7))} FROM offs"))
def residual_offsets(spark, sf_dir):
    pool = bt.staged_pool(spark, sf_dir)
    out = iv.residual_offsets(materialise(iv.walk_forward_residuals(pool, bt.folds(pool), P)), P)
    return out.select("test_year", "segment", "n", *[F.round(F.col("offsets")[i], 8).alias(f"o{i}") for i in range(7)])


@query("interval_forecasts", sql("ivq", f"SELECT event_key, test_year, {', '.join(f'round({c}, 8) AS {c}' for c in bt.LEVELS.values())} FROM ivq"))
def interval_forecasts(spark, sf_dir):
    return rounded(bt.interval_rows(spark, sf_dir).select("event_key", "test_year", *bt.LEVELS.values()), 8)


# ---------------------------------------------------------------- metric tables

_TAGS = """(SELECT *, unnest([CASE WHEN NOT is_provisional THEN {'k': 'complete', 'v': 'all'} END, {'k': 'complete_plus_provisional', 'v': 'all'},
  CASE WHEN is_provisional THEN {'k': 'provisional', 'v': 'all'} END, CASE WHEN NOT is_provisional THEN {'k': 'test_year', 'v': CAST(test_year AS VARCHAR)} END,
  CASE WHEN NOT is_provisional THEN {'k': 'segment', 'v': segment} END, CASE WHEN NOT is_provisional THEN {'k': 'is_repeat', 'v': CAST(is_repeat AS VARCHAR)} END]) AS tag FROM %s)"""
BREAKDOWNS = ["test_year", "segment", "is_repeat"]


@query("error_metric_tables", sql("sc", f"""
SELECT cutoff_view, model_id, tag.k AS scope, tag.v AS scope_value, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias,
  round(median(abs(e)), 6) AS median_ae, round(1 - sum(e * e) / 10000 / nullif(var_pop(actual) * count(*), 0), 6) AS r2_own_mean
FROM {_TAGS % 'sc'} WHERE tag IS NOT NULL GROUP BY 1, 2, 3, 4"""))
def error_metric_tables(spark, sf_dir):
    fine = ["cutoff_view", "model_id", "is_provisional", *BREAKDOWNS]
    return rounded(me.error_metrics(bt.predictions(spark, sf_dir), ["cutoff_view", "model_id", "scope", "scope_value"], fine=fine,
                                    expand=lambda d: me.with_scopes(d, BREAKDOWNS)))


@query("r2_versus_benchmark", sql("sc", """
, b AS (SELECT event_key, cutoff_view, e AS eb FROM sc WHERE model_id = 'segment_repeat_mean')
SELECT cutoff_view, model_id, round(1 - sum(e * e) / nullif(sum(eb * eb), 0), 6) AS r2_benchmark FROM sc JOIN b USING (event_key, cutoff_view)
WHERE model_id <> 'segment_repeat_mean' AND NOT is_provisional GROUP BY 1, 2"""))
def r2_versus_benchmark(spark, sf_dir):
    pred = bt.predictions(spark, sf_dir).where("NOT is_provisional")
    return rounded(me.r2_versus_benchmark(me.pair_with_benchmark(pred, "segment_repeat_mean"), ["cutoff_view", "model_id"]))


cte("prd", "sc", """
SELECT a.*, b.e AS eb FROM sc a JOIN sc b ON a.event_key = b.event_key AND a.cutoff_view = b.cutoff_view AND b.model_id = 'recent_frozen' WHERE a.model_id <> 'recent_frozen'
""")
_PAIR = """count(*) AS n, round(avg(abs(e)), 6) AS mae_model, round(avg(abs(eb)), 6) AS mae_benchmark, round(avg(abs(e) - abs(eb)), 6) AS mean_difference,
  count_if(abs(e) < abs(eb)) AS n_model_better, count_if(abs(e) > abs(eb)) AS n_benchmark_better, count_if(abs(e) = abs(eb)) AS n_tied, 0 AS n_unpaired, 0 AS n_actual_differs"""


def _paired(spark, sf_dir):
    return me.pair_with_benchmark(bt.predictions(spark, sf_dir), "recent_frozen")


@query("paired_by_year", sql("prd", f"SELECT cutoff_view, model_id, test_year, is_provisional, {_PAIR} FROM prd GROUP BY 1, 2, 3, 4"))
def paired_by_year(spark, sf_dir):
    return rounded(me.paired_comparison(_paired(spark, sf_dir), ["cutoff_view", "model_id", "test_year", "is_provisional"]))


@query("paired_by_group", sql("prd", f"SELECT cutoff_view, model_id, segment, is_repeat, {_PAIR} FROM prd WHERE NOT is_provisional GROUP BY 1, 2, 3, 4"))
def paired_by_group(spark, sf_dir):
    return rounded(me.paired_comparison(_paired(spark, sf_dir).where("NOT is_provisional"), ["cutoff_view", "model_id", "segment", "is_repeat"]))


@query("paired_cutoffs", sql("sc", f"""
SELECT model_id, test_year, {_PAIR} FROM (SELECT b.model_id, b.test_year, b.e, a.e AS eb FROM sc a JOIN sc b USING (event_key, model_id)
WHERE a.cutoff_view = 'announcement' AND b.cutoff_view = 'pre_event') q GROUP BY 1, 2"""))
def paired_cutoffs(spark, sf_dir):
    return rounded(me.paired_cutoffs(bt.predictions(spark, sf_dir), "announcement", "pre_event", ["model_id", "test_year"]))


@query("error_distribution", sql("sc", """
SELECT cutoff_view, model_id, segment, count(*) AS n, round(avg(e), 6) AS mean_error, round(stddev_samp(e), 6) AS std_error, round(skewness(e), 6) AS skew_error,
  round(median(e), 6) AS median_error FROM sc WHERE NOT is_provisional GROUP BY 1, 2, 3"""))
def error_distribution(spark, sf_dir):
    return rounded(me.error_distribution(bt.predictions(spark, sf_dir).where("NOT is_provisional"), ["cutoff_view", "model_id", "segment"]))


@query("case_studies", sql("prd", """
, g AS (SELECT cutoff_view, event_key, round(abs(eb) - abs(e), 9) AS gain FROM prd WHERE model_id = 'recent_adaptive' AND NOT is_provisional),
m AS (SELECT *, abs(gain - median(gain) OVER (PARTITION BY cutoff_view)) AS d FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY cutoff_view ORDER BY gain DESC, event_key DESC) AS a, row_number() OVER (PARTITION BY cutoff_view ORDER BY gain, event_key) AS b,
  row_number() OVER (PARTITION BY cutoff_view ORDER BY d, event_key) AS c FROM m)
SELECT cutoff_view, 'largest_gain' AS rule, event_key, round(gain, 6) AS gain FROM r WHERE a = 1 UNION ALL SELECT cutoff_view, 'largest_loss', event_key, round(gain, 6) FROM r WHERE b = 1
UNION ALL SELECT cutoff_view, 'closest_to_median', event_key, round(gain, 6) FROM r WHERE c = 1"""))
def case_studies(spark, sf_dir):
    paired = materialise(_paired(spark, sf_dir).where("model_id = 'recent_adaptive' AND NOT is_provisional"))
    return rounded(me.case_studies(paired, ["cutoff_view"]))


@query("attempted_versus_scored", sql("pred", """
SELECT cutoff_view, model_id, test_year, count(*) AS n_attempted, count(actual) AS n_scored, count_if(actual IS NULL) AS n_excluded,
  CASE WHEN count_if(actual IS NULL) > 0 THEN 'missing_actual' ELSE 'n/a' END AS reason FROM pred GROUP BY 1, 2, 3"""))
def attempted_versus_scored(spark, sf_dir):
    return me.attempted_versus_scored(bt.predictions(spark, sf_dir), ["cutoff_view", "model_id", "test_year"])


_PIN = ", ".join(f"round(avg(greatest({q} * (actual - {c}), ({q} - 1) * (actual - {c}))) * 100, 6) AS pinball_{c}" for q, c in bt.LEVELS.items())
_PINM = " + ".join(f"greatest({q} * (actual - {c}), ({q} - 1) * (actual - {c}))" for q, c in bt.LEVELS.items())
_COV = ", ".join(f"round(avg(CAST(actual BETWEEN {lo} AND {hi} AS INTEGER)), 6) AS coverage_{n}, round(avg({hi} - {lo}) * 100, 6) AS width_{n}" for n, (lo, hi) in bt.INTERVALS.items())


@query("probabilistic_metrics", sql("ivq", f"""
SELECT tag.k AS scope, tag.v AS scope_value, count(*) AS n, {_PIN}, round(avg({_PINM}) * 100 / 7, 6) AS pinball_mean, {_COV} FROM {_TAGS % 'ivq'}
WHERE tag IS NOT NULL AND actual IS NOT NULL GROUP BY 1, 2"""))
def probabilistic_metrics(spark, sf_dir):
    rows = me.with_scopes(bt.interval_rows(spark, sf_dir), BREAKDOWNS)
    return rounded(me.probabilistic_metrics(rows, ["scope", "scope_value"], levels=bt.LEVELS, intervals=bt.INTERVALS))


@query("clip_fraction", sql("ivq", f"""
, t AS (SELECT *, {' OR '.join(f'abs({c}) <= 1e-8 OR abs({c} - 1) <= 1.001e-5' for c in bt.LEVELS.values())} AS hit FROM ivq WHERE NOT is_provisional)
SELECT test_year, segment, count(*) AS n, count_if(hit) AS n_touching, round(count_if(hit) / count(*), 6) AS fraction_touching FROM t GROUP BY 1, 2"""))
def clip_fraction(spark, sf_dir):
    rows = bt.interval_rows(spark, sf_dir).where("NOT is_provisional")
    return rounded(me.clip_fraction(rows, ["test_year", "segment"], list(bt.LEVELS.values())))


@query("coverage_trend", sql("ivq", """
, y AS (SELECT segment, test_year, avg(CAST(actual BETWEEN q05 AND q95 AS INTEGER)) AS c FROM ivq WHERE actual IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY test_year) AS i, count(*) OVER (PARTITION BY segment) AS n FROM y)
SELECT segment, round(avg(CASE WHEN i <= 2 THEN c END), 6) AS early_coverage, round(avg(CASE WHEN i > n - 2 THEN c END), 6) AS late_coverage,
  round(avg(CASE WHEN i > n - 2 THEN c END) - avg(CASE WHEN i <= 2 THEN c END), 6) AS drift FROM r WHERE n >= 4 GROUP BY 1"""))
def coverage_trend(spark, sf_dir):
    by_year = me.probabilistic_metrics(bt.interval_rows(spark, sf_dir), ["segment", "test_year"], levels=bt.LEVELS, intervals={"90": ("q05", "q95")})
    return rounded(me.coverage_trend(by_year, ["segment"], year="test_year", coverage="coverage_90", k=2))


cte("docs", "", """
SELECT doc_id, lang, CASE WHEN toxic = 0 THEN quality END AS label, round(n_chars / (n_chars + 2000), 3) AS score FROM labels JOIN documents USING (doc_id)
""")


@query("classifier_metrics", sql("docs", """
, d AS (SELECT *, avg(label) OVER () AS base FROM docs)
SELECT lang, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_positive, round(avg(label), 6) AS prevalence, round(avg((score - label) * (score - label)), 6) AS brier,
  round(avg((0.5 - label) * (0.5 - label)), 6) AS no_skill_brier, avg((score - label) * (score - label)) > avg((0.5 - label) * (0.5 - label)) AS worse_than_no_skill,
  count_if(score >= 0.4 AND label = 1) AS true_positive, count_if(score >= 0.4 AND label = 0) AS false_positive, count_if(score < 0.4 AND label = 0) AS true_negative,
  count_if(score < 0.4 AND label = 1) AS false_negative FROM d WHERE label IS NOT NULL GROUP BY 1"""))
def classifier_metrics(spark, sf_dir):
    rows = bt.scored_documents(spark, sf_dir).withColumn("flat", F.lit(0.5)).withColumn("decided", F.col("score") >= 0.4)
    return rounded(me.classifier_metrics(rows, ["lang"], proba="score", label="label", baseline="flat", decided="decided"))


@query("average_precision", sql("docs", """
, s AS (SELECT lang, score, count(*) AS n, sum(label) AS p FROM docs WHERE label IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY lang) AS tp, sum(n) OVER (PARTITION BY lang) AS tn FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN round(sum(p / tp * cp / cn), 6) END AS average_precision FROM c GROUP BY 1"""))
def average_precision(spark, sf_dir):
    return rounded(me.average_precision(bt.scored_documents(spark, sf_dir), ["lang"], proba="score", label="label"))


@query("calibration_table", sql("docs", """
, k AS (SELECT * FROM docs WHERE label IS NOT NULL),
e AS (SELECT lang, list_sort(list_distinct(quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS q FROM k GROUP BY 1 HAVING count(*) >= 5),
b AS (SELECT k.*, CAST(len(list_filter(q[2:len(q) - 1], lambda x: x < score)) AS INTEGER) AS bin FROM k JOIN e USING (lang))
SELECT lang, bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS observed_rate FROM b GROUP BY 1, 2"""))
def calibration_table(spark, sf_dir):
    return rounded(me.calibration_table(bt.scored_documents(spark, sf_dir), ["lang"], proba="score", label="label"))


@query("decision_rule", sql("sc", """
, y AS (SELECT a.model_id, b.model_id AS benchmark, a.cutoff_view, a.test_year, count(*) AS n, avg(abs(a.e)) AS ma, avg(abs(b.e)) AS mb, count_if(abs(a.e) < abs(b.e)) AS w, count_if(abs(a.e) > abs(b.e)) AS l
  FROM sc a JOIN sc b USING (event_key, cutoff_view) WHERE b.model_id IN ('recent_frozen', 'recent_adaptive') AND a.model_id NOT IN ('recent_frozen', 'recent_adaptive')
  AND NOT a.is_provisional GROUP BY 1, 2, 3, 4),
c AS (SELECT model_id, benchmark, cutoff_view, sum(ma * n) / sum(n) < sum(mb * n) / sum(n) AS bm, count_if(w > l) > count(*) - count_if(w > l) AS by_ FROM y GROUP BY 1, 2, 3)
SELECT model_id, count(*) AS n_comparisons, count_if(bm) AS n_beats_mae, count_if(by_) AS n_beats_years, bool_and(bm AND by_) AS meets_bar FROM c GROUP BY 1"""))
def decision_rule(spark, sf_dir):
    pred = bt.predictions(spark, sf_dir).where("NOT is_provisional")
    keys = ["cutoff_view", "model_id", "test_year"]
    tables = [
        me.paired_comparison(me.pair_with_benchmark(pred, b), keys).withColumn("benchmark", F.lit(b)) for b in ("recent_frozen", "recent_adaptive")]
    paired = tables[0].unionByName(tables[1]).where(~F.col("model_id").isin("recent_frozen", "recent_adaptive"))
    return me.decision_rule(paired)


@query("win_pattern", sql("prd", """
, y AS (SELECT cutoff_view, model_id, test_year, CASE WHEN count_if(abs(e) < abs(eb)) > count_if(abs(e) > abs(eb)) THEN 'won' WHEN count_if(abs(e) < abs(eb)) < count_if(abs(e) > abs(eb)) THEN 'lost' ELSE 'tied' END AS outcome
  FROM prd WHERE NOT is_provisional GROUP BY 1, 2, 3),
r AS (SELECT *, test_year - row_number() OVER (PARTITION BY cutoff_view, model_id, outcome ORDER BY test_year) AS run FROM y),
t AS (SELECT cutoff_view, model_id, outcome, min(test_year) AS a, max(test_year) AS b, count(*) AS n FROM r GROUP BY 1, 2, 3, run)
SELECT cutoff_view, model_id, outcome, CAST(sum(n) AS BIGINT) AS n_years, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS years FROM t GROUP BY 1, 2, 3"""))
def win_pattern(spark, sf_dir):
    paired = me.paired_comparison(_paired(spark, sf_dir).where("NOT is_provisional"), ["cutoff_view", "model_id", "test_year"])
    return me.win_pattern(paired, ["cutoff_view", "model_id"])


@query("block_bootstrap")
def block_bootstrap(spark, sf_dir):
    paired = me.paired_comparison(_paired(spark, sf_dir).where("NOT is_provisional"), ["cutoff_view", "model_id", "test_year"])
    return rounded(me.block_bootstrap(paired, ["cutoff_view", "model_id"], value="mean_difference", order="test_year", n_boot=10_000))


@query("extreme_surprises", sql("ss1", """
, s AS (SELECT event_key, segment, round(primary_share - expected, 7) AS surprise FROM ss1 WHERE primary_share IS NOT NULL),
h AS (SELECT *, 'highest' AS side, CAST(row_number() OVER (ORDER BY surprise DESC, event_key) AS INTEGER) AS rank FROM s QUALIFY rank <= 5),
l AS (SELECT *, 'lowest' AS side, CAST(row_number() OVER (ORDER BY surprise, event_key) AS INTEGER) AS rank FROM s QUALIFY rank <= 5)
SELECT * FROM h UNION ALL SELECT * FROM l"""))
def extreme_surprises(spark, sf_dir):
    pool = bt.regime_pool(spark, sf_dir)
    out = su.walk_forward_surprise(pool, bt.folds(pool), P, "regime").withColumn("surprise", F.round("surprise", 7))
    return me.extremes(out, value="surprise", key="event_key", n=5, keep=["segment"])


@query("largest_revision", sql("vint", """
, e AS (SELECT observed, arg_min(value, vintage) AS first_value, arg_max(value, vintage) AS last_value, min(vintage) AS first_vintage, max(vintage) AS last_vintage FROM vint GROUP BY 1)
SELECT * FROM e WHERE first_value <> last_value ORDER BY abs(last_value - first_value) DESC, observed DESC LIMIT 1"""))
def largest_revision(spark, sf_dir):
    return me.largest_revision(an.vintages_long(spark, sf_dir), vintage="vintage", observed="observed", value="value")


@query("target_histogram", sql("pool", """
SELECT segment, CAST(least(floor(primary_share * 20) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM pool WHERE primary_share BETWEEN 0 AND 1 GROUP BY 1, 2"""))
def target_histogram(spark, sf_dir):
    return me.histogram(an.pool(spark, sf_dir), ["segment"], value="primary_share", low=0.0, high=1.0, bins=20)


@query("annual_mae_chart", sql("sc", """
SELECT model_id, test_year, round(avg(CASE WHEN cutoff_view = 'announcement' THEN abs(e) END), 6) AS announcement, round(avg(CASE WHEN cutoff_view = 'pre_event' THEN abs(e) END), 6) AS pre_event
FROM sc GROUP BY 1, 2"""))
def annual_mae_chart(spark, sf_dir):
    e = F.abs(F.col("forecast") - F.col("actual")) * 100
    t = me.scored(bt.predictions(spark, sf_dir)).groupBy("model_id", "test_year").pivot("cutoff_view", list(bt.CUTOFFS)).agg(F.avg(e))
    return rounded(t)


@query("dashboard_documents", sql("prd", f"""
SELECT cutoff_view, model_id, '{{"records":[' || string_agg('{{"test_year":' || test_year || ',"n":' || n || ',"mae_model_millionths":' || CAST(round(mae_model * 1000000) AS BIGINT)
  || ',"mae_benchmark_millionths":' || CAST(round(mae_benchmark * 1000000) AS BIGINT) || '}}', ',' ORDER BY test_year) || ']}}' AS document
FROM (SELECT cutoff_view, model_id, test_year, {_PAIR} FROM prd WHERE NOT is_provisional GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def dashboard_documents(spark, sf_dir):
    """Whole millionths, so that the text does not depend on how an engine prints a double."""
    t = rounded(me.paired_comparison(_paired(spark, sf_dir).where("NOT is_provisional"), ["cutoff_view", "model_id", "test_year"]))
    t = t.withColumns({f"{c}_millionths": F.round(F.col(c) * 1_000_000).cast("long") for c in ("mae_model", "mae_benchmark")})
    return nested_records(t, by=["cutoff_view", "model_id"], records=["test_year", "n", "mae_model_millionths", "mae_benchmark_millionths"], order=["test_year"])
