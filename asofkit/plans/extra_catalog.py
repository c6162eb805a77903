"""Queries over fitted models, text scanning, contracts, lookups and the streaming forecast."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import arithmetic as ar
from ..models import linear as li
from ..operators import asof, folds as fo, gates as ga, metrics as me, textscan as ts
from ..session import materialise, scratch_dir, staged
from ..streaming.adaptive import adaptive_stream
from . import analogs as an, backtest as bt, matrix as mx, models_catalog as mc
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

# ---------------------------------------------------------------- text


def _re2(pattern: str) -> str:
    """The same pattern for the oracle's engine, whose word characters are ASCII only."""
    return pattern.replace(r"\w", r"[\p{L}\p{M}\p{N}_]").replace("'", "''")


_CATS = [(f"secret:{k}", v) for k, v in ts.SECRET_PATTERNS.items()] + [(f"identifying_info:{k}", v) for k, v in ts.IDENTIFYING_PATTERNS.items()]
cte("hits", "", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, line_no, '{c}' AS category, regexp_extract(line, '{_re2(p)}', 0) AS m FROM lines" for c, p in _CATS) + ") WHERE m <> ''")
cte("lines", "", """SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no
FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]') AS l FROM documents) q""")
from .oracle import CTES  # noqa: E402

CTES["hits"] = (("lines",), CTES["hits"][1])
_SEVERITY = """CASE WHEN category LIKE 'secret:%' OR category IN ('identifying_info:absolute_home_path', 'identifying_info:email_address', 'identifying_info:dev_session_url')
  THEN 'hard_block' WHEN category IN ('identifying_info:ipv4_address', 'identifying_info:home_dotdir_path') THEN 'review' ELSE 'info' END"""


@query("text_findings", sql("hits", f"""
SELECT doc_id, line_no, category, {_SEVERITY} AS severity, 'fp:' || substr(sha256(m), 1, 12) AS fingerprint,
  CASE WHEN length(m) <= 4 THEN repeat('*', length(m)) ELSE left(m, 2) || repeat('*', length(m) - 4) || right(m, 2) END AS redacted FROM hits"""))
def text_findings(spark, sf_dir):
    return ts.scan_text(an.table(spark, sf_dir, "documents").select("doc_id", "text"), key="doc_id", text="text")


@query("text_findings_allowlisted", sql("hits", f"""
, f AS (SELECT doc_id, category, {_SEVERITY} AS severity, 'fp:' || substr(sha256(m), 1, 12) AS fingerprint FROM hits),
a AS (SELECT DISTINCT doc_id, fingerprint FROM f WHERE doc_id % 2 = 0)
SELECT severity, category, count(*) AS n FROM f ANTI JOIN a USING (doc_id, fingerprint) GROUP BY 1, 2"""))
def text_findings_allowlisted(spark, sf_dir):
    found = materialise(text_findings(spark, sf_dir))
    allowed = found.where(F.col("doc_id") % 2 == 0).select("doc_id", "fingerprint").distinct()
    return ts.audit_summary(ts.without_allowed(found, allowed, key="doc_id"))


@query("release_text_gate", sql("hits", f"SELECT count_if({_SEVERITY} = 'hard_block') = 0 AS passed, count(*) AS n_findings FROM hits"))
def release_text_gate(spark, sf_dir):
    return ts.passes(text_findings(spark, sf_dir))


# ---------------------------------------------------------------- lookups, membership, small functions

@query("lookup_attribute", sql("docs", "SELECT doc_id, label, lang FROM docs"))
def lookup_attribute(spark, sf_dir):
    """Attach an attribute by key from its distinct pairs."""
    lab = an.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("label"))
    pairs = an.table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.first("lang").alias("lang"))
    return lab.join(pairs, "doc_id").select("doc_id", "label", "lang")


@query("unmatched_keys", sql("ev res", "SELECT event_key FROM ev ANTI JOIN res USING (event_key)"))
def unmatched_keys(spark, sf_dir):
    lines = an.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_key"))
    return an.events(spark, sf_dir).select("event_key").join(lines, "event_key", "left_anti")


@query("range_membership", sql("ev", """
SELECT event_key, name AS window_name FROM ev JOIN (VALUES ('early', DATE '1995-03-01', DATE '1996-02-29'), ('overlap', DATE '1996-01-01', DATE '1997-06-30'),
 ('late', DATE '2000-06-01', DATE '2001-12-31')) w(name, lo, hi) ON event_date BETWEEN lo AND hi"""))
def range_membership(spark, sf_dir):
    rows = [("early", "1995-03-01", "1996-02-29"), ("overlap", "1996-01-01", "1997-06-30"), ("late", "2000-06-01", "2001-12-31")]
    w = spark.createDataFrame(rows, "window_name string, lo string, hi string").selectExpr("window_name", "date(lo) AS lo", "date(hi) AS hi")
    return an.events(spark, sf_dir).join(F.broadcast(w), F.col("event_date").between(F.col("lo"), F.col("hi"))).select("event_key", "window_name")


@query("clip_with_flag", sql("ss1", """
SELECT event_key, round(greatest(0.2, least(0.5, expected)), 7) AS forecast, round(expected, 7) AS forecast_unclipped, expected < 0.2 OR expected > 0.5 AS was_clipped FROM ss1"""))
def clip_with_flag(spark, sf_dir):
    from ..models import surprise as su

    pool = bt.regime_pool(spark, sf_dir)
    out = su.walk_forward_surprise(pool, bt.folds(pool), P, "regime")
    return out.select("event_key", F.round(ar.clip("expected", 0.2, 0.5), 7).alias("forecast"), F.round("expected", 7).alias("forecast_unclipped"),
                      ar.was_clipped("expected", 0.2, 0.5).alias("was_clipped"))


@query("sorted_quantiles", sql("", """
SELECT o_orderkey, s[1] AS a, s[2] AS b, s[3] AS c FROM (SELECT o_orderkey, list_sort([o_totalprice, o_custkey * 100.0::DOUBLE, 150000.0::DOUBLE]) AS s FROM orders) q"""))
def sorted_quantiles(spark, sf_dir):
    o = an.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("a"), (F.col("o_custkey") * F.lit(100.0)).alias("b"), F.lit(150000.0).alias("c"))
    return o.select("o_orderkey", *ar.sorted_levels(["a", "b", "c"]))


@query("regime_labels", sql("wk", """
SELECT series, observed, CASE WHEN observed >= DATE '2000-01-01' THEN 'third' WHEN observed >= DATE '1997-07-01' THEN 'second' WHEN observed >= DATE '1995-06-01' THEN 'first' END AS regime FROM wk"""))
def regime_labels(spark, sf_dir):
    from ..sources.normalize import regime_label

    wk = an.weekly_long(spark, sf_dir)
    return wk.select("series", "observed", regime_label("observed", [("1995-06-01", "first"), ("1997-07-01", "second"), ("2000-01-01", "third")]).alias("regime"))


@query("model_config_json", sql("ev", """
SELECT segment, '{"model":"recent","n":8,"segment":"' || segment || '"}' AS config, string_agg(DISTINCT y, ';' ORDER BY y) AS years
FROM (SELECT segment, CAST(year(event_date) AS VARCHAR) AS y FROM ev) q GROUP BY 1"""))
def model_config_json(spark, sf_dir):
    ev = an.events(spark, sf_dir).select("segment", F.year("event_date").cast("string").alias("y")).distinct()
    config = F.to_json(F.struct(F.lit("recent").alias("model"), F.lit(8).alias("n"), F.col("segment")))
    return ev.groupBy("segment").agg(F.array_join(F.array_sort(F.collect_list("y")), ";").alias("years")).select("segment", config.alias("config"), "years")


@query("forbidden_field_scan", sql("outc", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, '{c}' AS column_name, count({c}) AS n_values FROM outc" for k, c in (
        ("exact", "public_total"), ("exact", "tendered"), ("pattern", "direct_accepted"), ("pattern", "foreign_accepted"),
        ("pattern", "indirect_accepted"), ("pattern", "noncomp_accepted"), ("pattern", "primary_accepted"), ("pattern", "tendered"))) + ")"))
def forbidden_field_scan(spark, sf_dir):
    """Outcome columns found by name in a frame, and how many values each would leak."""
    frame = an.outcomes(spark, sf_dir)
    found = ga.forbidden_columns(frame.columns, exact=["public_total", "tendered"], patterns=["accepted", "tendered"])
    named = [(k, c) for k, cs in found.items() for c in cs]
    counts = frame.agg(*[F.count(c).alias(c) for c in sorted({c for _, c in named})])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column_name"), F.col(c).alias("n_values")) for k, c in named])))


# ---------------------------------------------------------------- fitted models

DESIGN = li.Design(numeric=("log_amount", "regime", "gap_days", "event_month", "weekly_share", "never_known"), category="segment", values=an.SEGMENTS)


def feature_pool(spark, sf_dir):
    """The pool with predictors known at the announcement cutoff, written once."""
    return staged(spark, "feature_pool", sf_dir, lambda: _feature_pool(spark, sf_dir))


def _feature_pool(spark, sf_dir):
    pool = bt.regime_pool(spark, sf_dir)
    w = mx.weekly(spark, sf_dir).select("observed", "safe_date", (F.col("value_A") / (F.col("value_A") + F.col("value_N") + F.col("value_R"))).alias("weekly_share"))
    out = asof.asof_join(pool, w, cutoff="announcement_cutoff", safe="safe_date", tie=["observed"], keep=["weekly_share"])
    return out.withColumns({
        "log_amount": F.log1p("amount"), "gap_days": F.date_diff("event_date", "announce_date"), "event_month": F.month("event_date"),
        "never_known": F.lit(None).cast("double")})


def _linear(spark, sf_dir, candidates, fallback, name):
    pool = feature_pool(spark, sf_dir)
    f = materialise(bt.folds(pool))  # one row a year
    spans = fo.fold_spans(f, fo.inner_holdouts(pool, f, P))
    rows = pool.withColumns({"__trains": fo.trains(spans, P), "__validates": fo.validates(spans, P)})
    fits = materialise(li.select_and_fit(rows, "__trains", "__validates", "primary_share", DESIGN, candidates, fallback))
    test = fo.test_rows(pool, f, P).select("event_key", "test_year", "primary_share", *DESIGN.numeric, DESIGN.category)
    rows = li.linear_forecasts(test, fits, "test_year", DESIGN, "forecast_unclipped")
    return rows.select("event_key", "test_year", F.lit(name).alias("model_id"), F.col("primary_share").alias("actual"),
                       ar.clip("forecast_unclipped", 0.0, 1.0).alias("forecast"), "forecast_unclipped",
                       ar.was_clipped("forecast_unclipped", 0.0, 1.0).alias("was_clipped"))


@query("ridge_forecasts")
def ridge_forecasts(spark, sf_dir):
    return _linear(spark, sf_dir, [(a, None) for a in li.RIDGE_ALPHAS], (li.RIDGE_FALLBACK, None), "ridge")


@query("elastic_net_forecasts")
def elastic_net_forecasts(spark, sf_dir):
    grid = [(a, r) for a in li.ELASTIC_NET_ALPHAS for r in li.ELASTIC_NET_L1_RATIOS]
    return _linear(spark, sf_dir, grid, li.ELASTIC_NET_FALLBACK, "elastic_net")


@query("logistic_classifier")
def logistic_classifier(spark, sf_dir):
    """Stress classifier of every fold: C by inner Brier score, threshold = training prevalence."""
    from ..models import labels as la

    pool = feature_pool(spark, sf_dir)
    f = materialise(bt.folds(pool))  # one row a year
    labels = materialise(la.stress_labels(pool, f, P))
    nested = materialise(la.inner_holdout_labels(pool, fo.inner_holdouts(pool, f, P), f, P))
    feats = pool.select("event_key", *DESIGN.numeric, "segment", "is_repeat")
    as_int = F.col("label").cast("int").alias("label")
    known = labels.where("role = 'train' AND label IS NOT NULL").select("event_key", "test_year", as_int)
    held = nested.where("label IS NOT NULL").select("event_key", F.col("outer_year").alias("test_year"), "role", as_int)
    test = labels.where("role = 'test'").withColumn("label", as_int).join(feats, "event_key")  # pending events too
    # One row per event with its label in every fit: the year for a fold, minus the year for its inner training rows.
    marks = known.unionByName(held.where("role = 'train'").select("event_key", (-F.col("test_year")).alias("test_year"), "label"))
    years = [r["test_year"] for r in f.select("test_year").orderBy("test_year").collect()]
    ids = [*years, *[-y for y in years]]
    wide = marks.groupBy("event_key").agg(*[F.max(F.when(F.col("test_year") == y, F.col("label"))).alias(f"__l{k}") for k, y in enumerate(ids)])
    fitted = li.fit_logistic(wide.join(feats, "event_key"), {y: F.col(f"__l{k}") for k, y in enumerate(ids)}, DESIGN, li.LOGISTIC_CS)
    tuned = li.coefficients_table(spark, {(-y, c): w for (y, c), w in fitted.items() if y < 0})
    chosen = materialise(li.choose_c(held.where("role = 'validation'").join(feats, "event_key"), tuned, "test_year", "label", DESIGN))
    fits = li.coefficients_table(spark, {(y, c): w for (y, c), w in fitted.items() if y > 0})
    prevalence = known.groupBy(F.col("test_year").alias("fold")).agg(F.avg("label").alias("train_prevalence"))
    out = li.logistic_forecasts(test, fits, chosen, prevalence, "test_year", DESIGN)
    return out.select("event_key", "test_year", "segment", F.col("label").alias("actual_label"), "predicted_proba", "predicted_label", "train_prevalence", "selected_c", "missing_reason")


@query("stress_classifier_metrics")
def stress_classifier_metrics(spark, sf_dir):
    # written before the filter, which would otherwise repeat the whole score in one condition, too large to be compiled
    rows = materialise(logistic_classifier(spark, sf_dir)).where("actual_label IS NOT NULL AND predicted_proba IS NOT NULL")
    stats = me.classifier_metrics(rows, ["test_year"], proba="predicted_proba", label="actual_label", baseline="train_prevalence", decided="predicted_label")
    return stats.join(me.average_precision(rows, ["test_year"], proba="predicted_proba", label="actual_label"), "test_year")


# ---------------------------------------------------------------- evaluation runner

@query("evaluation_run", sql("pred", """
SELECT cutoff_view, model_id, test_year, count(*) AS n_rows, count(DISTINCT event_key) AS n_keys, count(actual) AS n_scored, round(avg(abs(forecast - actual)) * 100, 6) AS mae FROM pred GROUP BY 1, 2, 3"""))
def evaluation_run(spark, sf_dir):
    pred = bt.predictions(spark, sf_dir)
    out = pred.groupBy("cutoff_view", "model_id", "test_year").agg(
        F.count("*").alias("n_rows"), F.count_distinct("event_key").alias("n_keys"), F.count("actual").alias("n_scored"),
        F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("mae"))
    return out.withColumn("mae", F.round(F.col("mae") * 100, 6))


@query("metric_bundle", sql("sc", """
SELECT 'by_year' AS table_name, cutoff_view, model_id, CAST(test_year AS VARCHAR) AS group_value, count(*) AS n, round(avg(abs(e)), 6) AS mae FROM sc WHERE NOT is_provisional GROUP BY 2, 3, 4
UNION ALL SELECT 'by_segment', cutoff_view, model_id, segment, count(*), round(avg(abs(e)), 6) FROM sc WHERE NOT is_provisional GROUP BY 2, 3, 4
UNION ALL SELECT 'by_repeat', cutoff_view, model_id, CAST(is_repeat AS VARCHAR), count(*), round(avg(abs(e)), 6) FROM sc WHERE NOT is_provisional GROUP BY 2, 3, 4
UNION ALL SELECT 'pooled', cutoff_view, model_id, NULL, count(*), round(avg(abs(e)), 6) FROM sc WHERE NOT is_provisional GROUP BY 2, 3"""))
def metric_bundle(spark, sf_dir):
    """Pooled and broken-down tables out of one aggregation with grouping sets."""
    pred = me.scored(bt.predictions(spark, sf_dir)).where("NOT is_provisional")
    pred = pred.select("cutoff_view", "model_id", F.col("test_year").cast("string").alias("y"), "segment", F.col("is_repeat").cast("string").alias("r"),
                       (F.abs(F.col("forecast") - F.col("actual")) * 100).alias("ae"))
    base = ["cutoff_view", "model_id"]
    t = pred.groupingSets([[*base, "y"], [*base, "segment"], [*base, "r"], base], *base, "y", "segment", "r").agg(
        F.count("*").alias("n"), F.avg("ae").alias("mae"), *[F.grouping(c).alias(f"__{c}") for c in ("y", "segment", "r")])
    name = F.when(F.col("__y") == 0, "by_year").when(F.col("__segment") == 0, "by_segment").when(F.col("__r") == 0, "by_repeat").otherwise("pooled")
    return t.select(name.alias("table_name"), *base, F.coalesce("y", "segment", "r").alias("group_value"), "n", F.round("mae", 6).alias("mae"))


# ---------------------------------------------------------------- streaming

@query("adaptive_stream", mc.sql("pool adp", """
, c AS (SELECT p.event_key, p.segment, list_filter(coalesce(l.items, []), lambda x: x.k <> p.event_key) AS used
  FROM pool p ASOF LEFT JOIN last8 l ON l.segment = p.segment AND l.known <= p.announcement_cutoff)
SELECT event_key, segment, round(list_avg(list_transform(used, lambda x: x.v)), 8) AS trailing_mean, CAST(len(used) AS INTEGER) AS n_used FROM c"""))
def adaptive_stream_query(spark, sf_dir):
    """The streaming forecast replayed over the tables; equals the batch safe trailing mean."""
    pool = bt.staged_pool(spark, sf_dir)
    common = ["segment", "event_key", F.col("event_date").cast("timestamp").alias("day")]
    probes = pool.select(F.col("announcement_cutoff").cast("timestamp").alias("at"), F.lit("probe").alias("kind"), *common, F.lit(None).cast("double").alias("value"))
    found = pool.where(F.col("primary_share").isNotNull()).select(
        F.col("result_safe_date").cast("timestamp").alias("at"), F.lit("result").alias("kind"), *common, F.col("primary_share").alias("value"))
    # An end mark per segment, later than every row, lets the watermark pass all of them.
    close = pool.agg((F.greatest(F.max("announcement_cutoff"), F.max("result_safe_date")) + F.expr("INTERVAL 2 DAYS")).cast("timestamp").alias("t")).first()["t"]
    end = pool.select(F.lit(close).alias("at"), F.lit("end").alias("kind"), "segment", F.lit(-1).cast("long").alias("event_key"),
                      F.lit(close).alias("day"), F.lit(None).cast("double").alias("value")).distinct()
    feed = materialise(probes.unionByName(found).unionByName(end).repartitionByRange("at"))  # the replay lies in time order
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(feed.schema).parquet(feed.inputFiles()[0].rsplit("/", 1)[0])
    run = (adaptive_stream(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
           .outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    out = spark.read.schema("event_key long, segment string, at timestamp, trailing_mean double, n_used int").parquet(f"{root}/out")
    return out.select("event_key", "segment", F.round("trailing_mean", 8).alias("trailing_mean"), "n_used")
