"""Queries over scans, parsing, normalisation, set operations and quality tables.

Raw payloads are rebuilt from the supplied tables inside the plan (rows -> JSON documents in
bounded pages -> rows), so the scans do the same work as on landed files and grow with the
tables. Missing tokens are introduced by a fixed arithmetic rule on the key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arithmetic as ar
from ..operators import quality as qu, calendar as cal
from ..session import scratch_dir
from ..sources import normalize as no, payloads as pa, sinks as si
from . import analogs as an
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


# ---------------------------------------------------------------- payloads rebuilt from tables

RAW_FIELDS = ["entity", "kind", "term", "repeat", "indexed", "floating", "announce_date", "event_date", "amount", "total"]


def raw_events(spark, sf_dir):
    """orders as raw text records: bad dates, bad numbers and missing tokens by rule."""
    o = an.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    return o.select(
        k.cast("string").alias("event_id"), F.concat(F.lit("E"), F.col("o_custkey").cast("string")).alias("entity"),
        F.when(k % 5 == 0, "Bill").when(k % 5 == 1, "Bond").otherwise("Note").alias("kind"),
        F.col("o_orderpriority").alias("term"),
        F.when(F.col("o_orderstatus") == "F", "Yes").when(k % 97 == 0, "Maybe").otherwise("No").alias("repeat"),
        F.when(k % 7 == 0, "Yes").otherwise("No").alias("indexed"),
        F.when(k % 11 == 0, "Yes").otherwise("No").alias("floating"),
        F.when(k % 13 == 0, "null").when(k % 101 == 0, "2000-13-45").otherwise(day).alias("announce_date"),
        day.alias("event_date"),
        F.when(k % 17 == 0, "null").when(k % 103 == 0, "n/a").otherwise(F.format_string("%.2f", "o_totalprice")).alias("amount"),
        F.when(k % 19 == 0, "null").otherwise(F.format_string("%.2f", "o_totalprice")).alias("total"),
    )


cte("raw", "", """
SELECT CAST(o_orderkey AS VARCHAR) AS event_id, 'E' || o_custkey AS entity,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Bill' WHEN o_orderkey % 5 = 1 THEN 'Bond' ELSE 'Note' END AS kind, o_orderpriority AS term,
  CASE WHEN o_orderstatus = 'F' THEN 'Yes' WHEN o_orderkey % 97 = 0 THEN 'Maybe' ELSE 'No' END AS repeat,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Yes' ELSE 'No' END AS indexed,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Yes' ELSE 'No' END AS floating,
  CASE WHEN o_orderkey % 13 = 0 THEN 'null' WHEN o_orderkey % 101 = 0 THEN '2000-13-45'
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS announce_date, strftime(o_orderdate, '%Y-%m-%d') AS event_date,
  CASE WHEN o_orderkey % 17 = 0 THEN 'null' WHEN o_orderkey % 103 = 0 THEN 'n/a' ELSE format('{:.2f}', o_totalprice) END AS amount,
  CASE WHEN o_orderkey % 19 = 0 THEN 'null' ELSE format('{:.2f}', o_totalprice) END AS total FROM orders
""")
cte("norm", "raw", """
SELECT event_id, entity, kind, repeat = 'Yes' AS is_repeat,
  kind IN ('Note', 'Bond') AND indexed = 'No' AND floating = 'No' AS in_universe,
  CASE WHEN kind IN ('Note', 'Bond') AND indexed = 'No' AND floating = 'No' THEN term END AS segment, indexed, floating,
  TRY_CAST(nullif(announce_date, 'null') AS DATE) AS announce_date, CAST(event_date AS DATE) AS event_date,
  TRY_CAST(nullif(amount, 'null') AS DOUBLE) AS amount, amount AS amount_raw,
  TRY_CAST(nullif(total, 'null') AS DOUBLE) AS total, TRY_CAST(nullif(total, 'null') AS DOUBLE) IS NOT NULL AS results_available
FROM raw
""")
PAGE = 500


def normalized(spark, sf_dir):
    typed = no.normalize_events(raw_events(spark, sf_dir), dates=["announce_date", "event_date"],
                                numbers=["amount", "total"], categories=["entity", "kind", "term", "repeat"])
    return no.classify_events(typed, kind="kind", kinds=["Note", "Bond"], repeat="repeat", indexed="indexed",
                              floating="floating", term="term", total="total")


def _documents(rows, page, wrap):
    """Rows -> JSON documents of one bounded page each."""
    return rows.groupBy(page.alias("page_no")).agg(F.to_json(wrap(F.collect_list(F.struct(*rows.columns)))).alias("doc"))


@query("paged_json_scan", sql("raw", "SELECT event_id, entity, repeat, announce_date, amount FROM raw"))
def paged_json_scan(spark, sf_dir):
    rows = raw_events(spark, sf_dir)
    wrap = lambda items: F.struct(F.array(F.struct(F.lit("page").alias("url"), F.struct(items.alias("data")).alias("body"))).alias("pages"))
    docs = _documents(rows, F.floor(F.col("event_id").cast("bigint") / PAGE), wrap)
    payload = pa.parse_payloads(docs, "doc", pa.paged_schema(rows.columns))
    return pa.paged_records(payload).select("event_id", "entity", "repeat", "announce_date", "amount")


def series_payload(spark, sf_dir):
    """Weekly series as documents per (series, month): withheld values, one unknown id, two periods."""
    wk = an.weekly_long(spark, sf_dir)
    n = F.date_diff("observed", F.lit("1995-01-04").cast("date"))
    rows = wk.select(
        F.concat(F.lit("S_"), F.col("series")).alias("keyid"),
        F.when(F.col("observed") < F.lit("1997-01-01").cast("date"), "LEGACY").alias("period"),
        F.struct(F.date_format("observed", "yyyy-MM-dd").alias("asofdate"), F.lit(None).cast("string").alias("keyid"),
                 F.when(n % 77 == 0, "*").otherwise(F.format_string("%.2f", "value")).alias("value")).alias("obs"),
        F.trunc("observed", "month").alias("m"),
    )
    docs = rows.groupBy("keyid", "period", "m").agg(F.collect_list("obs").alias("ts")).select(F.to_json(F.struct(F.array(F.struct(
        "keyid", F.concat(F.lit("u/"), F.col("keyid")).alias("url"), "period",
        F.struct(F.struct(F.col("ts").alias("timeseries")).alias("pd")).alias("body"))).alias("series"))).alias("doc"))
    return pa.parse_payloads(docs, "doc", pa.series_schema())


@query("series_json_scan", sql("wk", """
SELECT 'S_' || series AS keyid, strftime(observed, '%Y-%m-%d') AS asofdate,
  CASE WHEN (observed - DATE '1995-01-04') % 77 = 0 THEN '*' ELSE format('{:.2f}', value) END AS value,
  'u/S_' || series AS source_url, CASE WHEN observed < DATE '1997-01-01' THEN 'LEGACY' END AS period FROM wk"""))
def series_json_scan(spark, sf_dir):
    return pa.series_records(series_payload(spark, sf_dir))


_META = [("S_A", "CURRENT", "primary", "position", "r2"), ("S_N", "CURRENT", "direct", "position", "r2"),
         ("S_A", "LEGACY", "primary_old", "position", "r1")]


def series_metadata(spark):
    return spark.createDataFrame(_META, "keyid string, period string, name string, category string, regime string")


cte("ser", "wk", f"""
SELECT 'S_' || series AS keyid, CASE WHEN observed < DATE '1997-01-01' THEN 'LEGACY' ELSE 'CURRENT' END AS period, observed,
  CASE WHEN (observed - DATE '1995-01-04') % 77 <> 0 THEN CAST(format('{{:.2f}}', value) AS DOUBLE) END AS value FROM wk""")
cte("meta", "", f"SELECT * FROM (VALUES {', '.join(str(m) for m in _META)}) t(keyid, period, name, category, regime)")


def series_rows(spark, sf_dir):
    return no.normalize_series(pa.series_records(series_payload(spark, sf_dir)), series_metadata(spark))


@query("series_normalisation", sql("ser meta", """
SELECT keyid, period, observed, value, value IS NULL AS is_missing, CASE WHEN value IS NULL THEN 'withheld_by_source' END AS missing_reason,
  name, category, regime FROM ser JOIN meta USING (keyid, period)"""))
def series_normalisation(spark, sf_dir):
    rows, _ = series_rows(spark, sf_dir)
    return rows.select("keyid", "period", "observed", "value", "is_missing", "missing_reason", "name", "category", "regime")


@query("series_rejects", sql("ser meta", "SELECT keyid, count(*) AS n_rows FROM ser ANTI JOIN meta USING (keyid, period) GROUP BY 1"))
def series_rejects(spark, sf_dir):
    return series_rows(spark, sf_dir)[1]


@query("series_coverage", sql("ser meta", """
SELECT name, keyid, category, regime, min(observed) AS first_observed, max(observed) AS last_observed, count(*) AS n_observations,
  count_if(value IS NULL) AS n_missing, round(count_if(value IS NULL) / count(*) * 100, 6) AS pct_missing
FROM ser LEFT JOIN meta USING (keyid, period) GROUP BY ALL"""))
def series_coverage(spark, sf_dir):
    records = pa.series_records(series_payload(spark, sf_dir)).withColumn("period", F.coalesce("period", F.lit("CURRENT")))
    joined = records.join(F.broadcast(series_metadata(spark)), ["keyid", "period"], "left").select(
        "name", "keyid", "category", "regime", F.col("asofdate").cast("date").alias("observed"),
        (F.col("value") == "*").alias("gone"))
    out = qu.series_coverage(joined, keys=["name", "keyid", "category", "regime"], observed="observed", missing="gone")
    return out.withColumn("pct_missing", F.round("pct_missing", 6))


@query("series_schema_drift", sql("ser meta", """
SELECT DISTINCT m.keyid || '_' || m.period AS missing_id FROM meta m ANTI JOIN
 (SELECT DISTINCT keyid, period FROM ser WHERE period = 'CURRENT') s ON s.keyid = m.keyid AND s.period = m.period"""))
def series_schema_drift(spark, sf_dir):
    ident = F.concat_ws("_", "keyid", "period").alias("missing_id")
    live = pa.series_records(series_payload(spark, sf_dir)).select("keyid", F.coalesce("period", F.lit("CURRENT")).alias("period"))
    return no.unlisted_keys(series_metadata(spark).select(ident), live.where(F.col("period") == "CURRENT").select(ident), "missing_id")


POSITION_FIELDS = ["report_date", "contract", "long_qty", "short_qty", "open_interest"]


def position_payload(spark, sf_dir):
    ct = an.contracts_long(spark, sf_dir)
    text = ct.select(
        F.col("contract").cast("string").alias("contract"), F.date_format("observed", "yyyy-MM-dd").alias("report_date"),
        F.trunc("observed", "month").alias("m"),
        *[F.format_string("%.1f", c).alias(c) for c in ("long_qty", "short_qty", "open_interest")], F.lit("x").alias("not_kept"))
    docs = text.groupBy("contract", "m").agg(F.collect_list(F.struct(*POSITION_FIELDS, "not_kept")).alias("body")).select(
        F.to_json(F.struct(F.array(F.struct(F.col("contract").alias("contract_code"), F.lit("u").alias("url"), "body")).alias("contracts"))).alias("doc"))
    return pa.parse_payloads(docs, "doc", pa.contract_schema(POSITION_FIELDS))


@query("contract_json_scan", sql("ct", """
SELECT CAST(contract AS VARCHAR) AS contract, strftime(observed, '%Y-%m-%d') AS report_date, format('{:.1f}', long_qty) AS long_qty,
  format('{:.1f}', short_qty) AS short_qty, format('{:.1f}', open_interest) AS open_interest, 'u' AS source_url FROM ct"""))
def contract_json_scan(spark, sf_dir):
    return pa.contract_records(position_payload(spark, sf_dir))


@query("position_normalisation", sql("ct", """
SELECT CAST(contract AS VARCHAR) AS contract, observed AS report_date, long_qty, format('{:.1f}', long_qty) AS long_qty_raw, open_interest,
  contract <> 5 AS is_known, count(*) OVER (PARTITION BY contract, observed) AS n_same_key FROM ct"""))
def position_normalisation(spark, sf_dir):
    known = spark.createDataFrame([(str(i),) for i in range(5)], "contract string")
    out = no.normalize_positions(pa.contract_records(position_payload(spark, sf_dir)),
                                 numbers=["long_qty", "short_qty", "open_interest"], key=["contract", "report_date"], known=known)
    return out.select("contract", F.col("report_date").cast("date").alias("report_date"), "long_qty", "long_qty_raw",
                      "open_interest", "is_known", "n_same_key")


# ---------------------------------------------------------------- parsing and samples

@query("event_normalisation", sql("norm", """
SELECT event_id, announce_date, event_date, amount, amount_raw, is_repeat, in_universe, segment, results_available FROM norm"""))
def event_normalisation(spark, sf_dir):
    return normalized(spark, sf_dir).select("event_id", "announce_date", "event_date", "amount", "amount_raw", "is_repeat",
                                            "in_universe", "segment", "results_available")


@query("event_anomalies", sql("raw", """
SELECT * FROM (
SELECT 'announce_date' AS field, 'invalid_date' AS problem, count_if(announce_date <> 'null' AND TRY_CAST(announce_date AS DATE) IS NULL) AS n FROM raw
UNION ALL SELECT 'amount', 'invalid_number', count_if(amount <> 'null' AND TRY_CAST(amount AS DOUBLE) IS NULL) FROM raw
UNION ALL SELECT 'repeat', 'unexpected_category', count_if(repeat NOT IN ('Yes', 'No', 'null')) FROM raw) WHERE n > 0"""))
def event_anomalies(spark, sf_dir):
    return no.event_anomalies(raw_events(spark, sf_dir), dates=["announce_date", "event_date"], numbers=["amount", "total"],
                              allowed={"repeat": ["Yes", "No"], "indexed": ["Yes", "No"], "floating": ["Yes", "No"]})


@query("universe_filter", sql("norm", "SELECT event_id, segment, amount FROM norm WHERE in_universe"))
def universe_filter(spark, sf_dir):
    return normalized(spark, sf_dir).where("in_universe").select("event_id", "segment", "amount")


START = "1996-01-01"


def samples(spark, sf_dir):
    base = normalized(spark, sf_dir).where("in_universe")
    return qu.tag_samples(base, on="event_date", start=START, amount="amount", small_below=20000.0,
                          special=F.col("event_id").cast("bigint") % 23 == 0, tag="restricted")


@query("sample_split", sql("norm", f"""
SELECT event_id, amount < 20000 AS is_small, CASE WHEN CAST(event_id AS BIGINT) % 23 = 0 THEN 'restricted' END AS special_tag,
  CASE WHEN results_available THEN 'settled' ELSE 'pending' END AS sample FROM norm WHERE in_universe AND event_date >= DATE '{START}'"""))
def sample_split(spark, sf_dir):
    s = samples(spark, sf_dir)
    settled = s.where("results_available").withColumn("sample", F.lit("settled"))
    pending = s.where(~F.col("results_available")).withColumn("sample", F.lit("pending"))
    return settled.unionByName(pending).select("event_id", "is_small", "special_tag", "sample")


@query("modelling_sample", sql("norm cal", f"""
SELECT event_id, announce_date AS announcement_cutoff, pbd AS pre_event_cutoff FROM norm LEFT JOIN cal ON day = event_date
WHERE in_universe AND event_date >= DATE '{START}' AND results_available AND CAST(event_id AS BIGINT) % 23 <> 0"""))
def modelling_sample(spark, sf_dir):
    s = samples(spark, sf_dir).where(F.col("results_available") & F.col("special_tag").isNull())
    return cal.with_cutoffs(s, an.calendar(spark), "announce_date", "event_date").select(
        "event_id", "announcement_cutoff", "pre_event_cutoff")


@query("eligibility_summary", sql("norm", f"""
SELECT count_if(event_date < DATE '{START}') AS n_before_start, count_if(event_date >= DATE '{START}' AND results_available) AS n_settled,
  count_if(event_date >= DATE '{START}' AND NOT results_available) AS n_pending,
  count_if(event_date >= DATE '{START}' AND results_available AND CAST(event_id AS BIGINT) % 23 = 0) AS n_special,
  count_if(event_date >= DATE '{START}' AND results_available AND CAST(event_id AS BIGINT) % 23 <> 0) AS n_modelling,
  count_if(event_date >= DATE '{START}' AND results_available AND amount < 20000) AS n_small FROM norm WHERE in_universe"""))
def eligibility_summary(spark, sf_dir):
    return qu.eligibility_summary(
        normalized(spark, sf_dir).where("in_universe"), on="event_date", start=START, settled=F.col("results_available"),
        special=F.col("event_id").cast("bigint") % 23 == 0, small=F.col("amount") < 20000)


@query("stable_event_key", sql("ev", "SELECT event_key, entity_id || '_' || strftime(event_date, '%Y-%m-%d') AS stable_key FROM ev"))
def stable_event_key(spark, sf_dir):
    return an.events(spark, sf_dir).select("event_key", F.concat_ws(
        "_", F.col("entity_id").cast("string"), F.date_format("event_date", "yyyy-MM-dd")).alias("stable_key"))


MATURITIES = {"0 Mo": 1 / 12, "1 Mo": 1.5 / 12, "2 Mo": 0.5, "3 Mo": 2.0, "4 Mo": 5.0, "5 Mo": 10.0}


def rates_text(spark, sf_dir):
    """Wide text table: a date in MM/dd/yyyy and one text column per supplier class."""
    wide = an.contracts_long(spark, sf_dir).groupBy("observed").pivot("contract", list(range(6))).agg(F.first("open_interest"))
    blank = F.date_diff("observed", F.lit("1995-01-03").cast("date")) % 35 == 0
    text = lambda i: F.when(blank & F.lit(i < 2), " ").otherwise(F.concat(F.lit(" "), F.format_string("%.1f", F.col(str(i)))))
    return wide.select(F.date_format("observed", "MM/dd/yyyy").alias("Date"), *[text(i).alias(f"{i} Mo") for i in range(6)],
                       F.lit("1").alias("Unlisted"))


@query("wide_csv_parse", sql("ct", """
SELECT 0 AS n_invalid_dates, 0 AS n_duplicate_dates, 'Unlisted' AS unknown_columns, count(DISTINCT observed) AS n_dates FROM ct"""))
def wide_csv_parse(spark, sf_dir):
    typed, report = no.parse_wide_dates(rates_text(spark, sf_dir), text="Date", out="observed", known=list(MATURITIES))
    return report.join(typed.agg(F.count_distinct("observed").alias("n_dates")), F.lit(True))


@query("rates_unpivot", sql("ct", f"""
, v AS (SELECT observed, contract, contract || ' Mo' AS maturity,
   CASE WHEN (observed - DATE '1995-01-03') % 35 = 0 AND contract < 2 THEN '' WHEN open_interest IS NULL THEN NULL
     ELSE format('{{:.1f}}', open_interest) END AS value_raw
  FROM (SELECT DISTINCT observed FROM ct) d CROSS JOIN (SELECT DISTINCT contract FROM ct) c LEFT JOIN ct USING (observed, contract))
SELECT observed, maturity, CAST([{", ".join(str(v) for v in MATURITIES.values())}][contract + 1] AS DOUBLE) AS maturity_years,
  CAST(nullif(value_raw, '') AS DOUBLE) AS value, value_raw,
  CASE WHEN observed >= DATE '1998-06-01' THEN 'new_method' ELSE 'old_method' END ||
  CASE WHEN contract <> 5 THEN '' WHEN observed >= DATE '1997-03-01' THEN '+direct' ELSE '+composite' END AS regime,
  nullif(value_raw, '') IS NULL AS is_missing, CASE WHEN nullif(value_raw, '') IS NULL THEN 'empty_at_source' END AS missing_reason FROM v"""))
def rates_unpivot(spark, sf_dir):
    typed, _ = no.parse_wide_dates(rates_text(spark, sf_dir), text="Date", out="observed", known=list(MATURITIES))
    return no.unpivot_rates(typed, on="observed", labels=MATURITIES, regime_change="1998-06-01", special={"5 Mo": "1997-03-01"})


@query("long_to_wide", sql("wkrel", "SELECT observed, value_A, value_N, value_R, published_date, safe_date FROM wkrel"))
def long_to_wide(spark, sf_dir):
    wide = no.pivot_first(an.weekly_long(spark, sf_dir), index=["observed"], entity="series", entities=an.FLAGS, value="value", prefix="value_")
    return cal.with_weekly_release_dates(wide, an.calendar(spark), "observed")


@query("contracts_to_wide", sql("ct", "SELECT observed, " + ", ".join(
    f'max(CASE WHEN contract = {i} THEN {v} END) AS "{i}__{v}"' for i in range(6) for v in ("long_qty", "open_interest")) + " FROM ct GROUP BY 1"))
def contracts_to_wide(spark, sf_dir):
    return no.pivot_unique(an.contracts_long(spark, sf_dir), index="observed", entity="contract", entities=range(6),
                           values=["long_qty", "open_interest"])


# ---------------------------------------------------------------- vintages

def vintage_matrix(spark, sf_dir):
    v = an.vintages_long(spark, sf_dir)
    first, last = v.agg(F.min(F.year("vintage")), F.max(F.year("vintage"))).first()  # one column per month of the data's years
    labels = [f"GDP{y % 100:02d}M{m}" for y in range(first, last + 1) for m in range(1, 13)] if first else []
    wide = v.withColumn("label", F.concat(F.lit("GDP"), F.date_format("vintage", "yy"), F.lit("M"), F.month("vintage")))
    return wide.groupBy(F.date_format("observed", "yyyy:MM").alias("DATE")).pivot("label", labels).agg(
        F.first("value")).withColumn("XYZ95M1", F.lit(0.0))


@query("vintage_matrix_melt", sql("vint cal", """
, vv AS (SELECT DISTINCT CAST(make_date(y, m, 1) AS DATE) AS vintage FROM (SELECT unnest(range(min(year(vintage)), max(year(vintage)) + 1)) AS y FROM vint) a, (SELECT range AS m FROM range(1, 13)) b),
g AS (SELECT * FROM (SELECT DISTINCT observed FROM vint) o CROSS JOIN vv LEFT JOIN vint USING (observed, vintage)),
n AS (SELECT vintage, least(vintage + 24, last_day(vintage)) AS nominal FROM vv)
SELECT 'GDP' AS variable, strftime(observed, '%Y:%m') AS observation_period, observed, strftime(vintage, '%y') || 'M' || month(vintage) AS vintage_label,
  CAST(year(vintage) AS INTEGER) AS vintage_year, CAST(month(vintage) AS INTEGER) AS vintage_period, value,
  nominal AS nominal_published_date, nbd AS safe_date, 'rule' AS availability_precision
FROM g JOIN n USING (vintage) JOIN cal ON day = nominal"""))
def vintage_matrix_melt(spark, sf_dir):
    long, _ = no.melt_vintage_matrix(vintage_matrix(spark, sf_dir), period="DATE", prefix="GDP",
                                     vintage_frequency="monthly", observation_frequency="monthly")
    out = no.with_vintage_release_dates(long, an.calendar(spark), frequency="monthly", day=25, precision="rule")
    return out.select("variable", "observation_period", "observed", "vintage_label", "vintage_year", "vintage_period", "value",
                      "nominal_published_date", "safe_date", "availability_precision")


@query("vintage_grid_gaps", sql("vint", """
SELECT vintage, datediff('month', min(observed), max(observed)) + 1 - count(DISTINCT observed) AS n_gaps
FROM vint WHERE month(observed) <> 4 GROUP BY 1"""))
def vintage_grid_gaps(spark, sf_dir):
    v = an.vintages_long(spark, sf_dir).where(F.month("observed") != 4)
    return no.grid_gaps(v, by=["vintage"], observed="observed")


# ---------------------------------------------------------------- set operations

@query("duplicate_key_report", sql("ev", """
SELECT event_key, entity_id, event_date, count(*) OVER (PARTITION BY entity_id, event_date) AS n_rows FROM ev
QUALIFY n_rows > 1"""))
def duplicate_key_report(spark, sf_dir):
    return no.duplicate_keys(an.events(spark, sf_dir), ["entity_id", "event_date"]).select("event_key", "entity_id", "event_date", "n_rows")


@query("combine_regimes", sql("wkrel", """
SELECT observed, coalesce(CASE WHEN observed < DATE '1997-01-01' THEN value_A END,
  CASE WHEN observed >= DATE '1997-01-01' AND observed < DATE '1999-01-01' THEN value_N END,
  CASE WHEN observed >= DATE '1999-01-01' THEN round(value_N + value_R, 2) END) AS harmonised FROM wkrel"""))
def combine_regimes(spark, sf_dir):
    w = an.weekly_releases(spark, sf_dir)
    d = F.col("observed")
    a, b = F.lit("1997-01-01").cast("date"), F.lit("1999-01-01").cast("date")
    out = no.combine_regimes(w, [F.when(d < a, F.col("value_A")), F.when((d >= a) & (d < b), F.col("value_N")),
                                 F.when(d >= b, F.round(ar.total_of("value_N", "value_R"), 2))], "harmonised")
    return out.select("observed", "harmonised")


@query("key_set_differences", sql("ev res", """
SELECT 'pending' AS side, count(*) AS n FROM (SELECT event_key FROM ev EXCEPT SELECT event_key FROM res)
UNION ALL SELECT 'settled', count(*) FROM (SELECT event_key FROM ev INTERSECT SELECT event_key FROM res)
UNION ALL SELECT 'orphan', count(*) FROM (SELECT event_key FROM res EXCEPT SELECT event_key FROM ev)"""))
def key_set_differences(spark, sf_dir):
    e = an.events(spark, sf_dir).select("event_key")
    r = an.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_key")).distinct()
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(e.subtract(r), "pending").unionByName(count(e.intersect(r), "settled")).unionByName(count(r.subtract(e), "orphan"))


# ---------------------------------------------------------------- quality tables

@query("missing_fractions", sql("norm", """
, s AS (SELECT 'all' AS scope, * FROM norm UNION ALL SELECT 'settled', * FROM norm WHERE in_universe AND results_available)
SELECT scope, 'amount' AS field, count(*) AS n, round(avg(CAST(amount IS NULL AS INTEGER)), 9) AS fraction_missing FROM s GROUP BY 1
UNION ALL SELECT scope, 'announce_date', count(*), round(avg(CAST(announce_date IS NULL AS INTEGER)), 9) FROM s GROUP BY 1
UNION ALL SELECT scope, 'segment', count(*), round(avg(CAST(segment IS NULL AS INTEGER)), 9) FROM s GROUP BY 1"""))
def missing_fractions(spark, sf_dir):
    out = qu.missing_fractions(normalized(spark, sf_dir), ["amount", "announce_date", "segment"], {
        "all": F.lit(True), "settled": F.col("in_universe") & F.col("results_available")})
    return out.withColumn("fraction_missing", F.round("fraction_missing", 9))


@query("coverage_counts", sql("norm", """
SELECT CAST(year(event_date) AS INTEGER) AS year, segment, count_if(NOT is_repeat) AS n_first, count_if(is_repeat) AS n_repeat
FROM norm WHERE in_universe GROUP BY 1, 2"""))
def coverage_counts(spark, sf_dir):
    d = normalized(spark, sf_dir).where("in_universe").withColumn("year", F.year("event_date"))
    return d.groupBy("year", "segment").agg(F.count_if(~F.col("is_repeat")).alias("n_first"), F.count_if("is_repeat").alias("n_repeat"))


@query("coverage_by_listed_segment", sql("norm", """
SELECT s.segment, count(n.event_id) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) s(segment)
LEFT JOIN norm n ON n.segment = s.segment AND in_universe GROUP BY 1"""))
def coverage_by_listed_segment(spark, sf_dir):
    members = spark.createDataFrame([(s,) for s in (*an.SEGMENTS, "6-NONE")], "segment string")
    return qu.coverage_counts(normalized(spark, sf_dir).where("in_universe"), groups=["segment"], members=members)


@query("exclusion_accounting", sql("norm", """
SELECT count(*) AS n_excluded, count_if(kind = 'Bill') AS n_bills, count_if(indexed = 'Yes') AS n_indexed, count_if(floating = 'Yes') AS n_floating,
  CAST(count(*) - count_if(kind = 'Bill') - count_if(indexed = 'Yes') - count_if(floating = 'Yes') AS BIGINT) AS n_unaccounted FROM norm WHERE NOT in_universe"""))
def exclusion_accounting(spark, sf_dir):
    return qu.exclusion_accounting(normalized(spark, sf_dir), excluded=~F.col("in_universe"), classes={
        "n_bills": F.col("kind") == "Bill", "n_indexed": F.col("indexed") == "Yes", "n_floating": F.col("floating") == "Yes"})


@query("distribution_profile", sql("outc", """
, t AS (SELECT 'segment' AS scope_kind, segment AS scope_value, primary_share AS x FROM outc
  UNION ALL SELECT 'repeat', CAST(is_repeat AS VARCHAR), primary_share FROM outc
  UNION ALL SELECT 'period', CASE WHEN event_date < DATE '1997-01-01' THEN 'early' WHEN event_date < DATE '1999-01-01' THEN 'middle' ELSE 'late' END, primary_share FROM outc
  UNION ALL SELECT 'all', 'all', primary_share FROM outc)
SELECT scope_kind, scope_value, count(x) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS std, round(min(x), 8) AS min,
  round(median(x), 8) AS median, round(max(x), 8) AS max FROM t WHERE x IS NOT NULL GROUP BY 1, 2"""))
def distribution_profile(spark, sf_dir):
    d = F.col("event_date")
    period = F.when(d < F.lit("1997-01-01").cast("date"), "early").when(d < F.lit("1999-01-01").cast("date"), "middle").otherwise("late")
    out = qu.distribution_profile(an.outcomes(spark, sf_dir), value="primary_share", scopes={
        "segment": F.col("segment"), "repeat": F.col("is_repeat"), "period": period, "all": F.lit("all")})
    return out.select("scope_kind", "scope_value", "n", *[F.round(c, 8).alias(c) for c in ("mean", "std", "min", "median", "max")])


@query("targets_and_shares", sql("outc", """
SELECT event_key, public_total, round(primary_share, 9) AS primary_share, round(direct_share, 9) AS direct_share, round(indirect_share, 9) AS indirect_share,
  round(noncomp_share, 9) AS noncomp_share, round(foreign_share, 9) AS foreign_share, round(tendered / nullif(public_total, 0), 6) AS cover_calculated
FROM outc"""))
def targets_and_shares(spark, sf_dir):
    o = an.outcomes(spark, sf_dir)
    return o.select("event_key", "public_total", *[F.round(c, 9).alias(c) for c in an.SHARES],
                    F.round(ar.share("tendered", "public_total"), 6).alias("cover_calculated"))


@query("cover_reconciliation", sql("outc", """
, c AS (SELECT abs(round(2 + (event_key % 4) * 0.01, 2) - round(tendered / nullif(public_total, 0), 2)) AS d FROM outc)
SELECT count(d) AS n_compared, round(max(d), 6) AS max_abs_diff, round(avg(d), 8) AS mean_abs_diff, count_if(d <= 0.01) AS n_within_0_01,
  count_if(d <= 0.02) AS n_within_0_02, count_if(d > 0.02) AS n_over_0_02 FROM c WHERE d IS NOT NULL"""))
def cover_reconciliation(spark, sf_dir):
    o = an.outcomes(spark, sf_dir).withColumn("reported", F.round(F.lit(2.0) + (F.col("event_key") % 4) * F.lit(0.01).cast("double"), 2))
    o = o.withColumn("calculated", ar.share("tendered", "public_total"))
    out = qu.reconcile_ratio(o, reported="reported", calculated="calculated")
    return out.withColumn("max_abs_diff", F.round("max_abs_diff", 6)).withColumn("mean_abs_diff", F.round("mean_abs_diff", 8))


# ---------------------------------------------------------------- snapshots, sinks, digests

def _snapshots(spark, sf_dir):
    """Three dated copies of the orders table: rows added, removed and revised by rule."""
    o = an.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    first = o.where(k % 50 != 0)
    second = o.where(k % 40 != 0).withColumn("o_totalprice", F.when(k % 30 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return first, second


@query("snapshot_diff", sql("", """
WITH a AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 50 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 30 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 40 <> 0)
SELECT o_orderkey, CASE WHEN b.o_totalprice IS NULL THEN 'only_older' WHEN a.o_totalprice IS NULL THEN 'only_newer' ELSE 'changed' END AS status
FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice"""))
def snapshot_diff(spark, sf_dir):
    return si.compare_snapshots(*_snapshots(spark, sf_dir), key=["o_orderkey"])


@query("snapshot_history", sql("", """
WITH r(i, d) AS (VALUES (0, DATE '2024-01-01'), (1, DATE '2024-01-08'), (2, DATE '2024-01-15')),
s AS (SELECT d, o_orderkey, CASE WHEN o_orderkey % 30 = i THEN o_totalprice + i ELSE o_totalprice END AS p FROM orders, r WHERE o_orderkey % 50 <> i)
SELECT r1.d AS older, r2.d AS newer, CASE WHEN b.p IS NULL THEN 'only_older' WHEN a.p IS NULL THEN 'only_newer' WHEN a.p = b.p THEN 'same' ELSE 'changed' END AS status, count(*) AS n
FROM r r1 JOIN r r2 ON r2.i = r1.i + 1 JOIN (SELECT o_orderkey FROM orders) k ON true
LEFT JOIN s a ON a.d = r1.d AND a.o_orderkey = k.o_orderkey LEFT JOIN s b ON b.d = r2.d AND b.o_orderkey = k.o_orderkey
WHERE a.p IS NOT NULL OR b.p IS NOT NULL GROUP BY 1, 2, 3"""))
def snapshot_history(spark, sf_dir):
    o = an.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    dated = spark.createDataFrame([(0, "2024-01-01"), (1, "2024-01-08"), (2, "2024-01-15")], "i int, d string")
    k = F.col("o_orderkey")
    s = o.join(F.broadcast(dated), k % 50 != F.col("i")).select(
        F.col("d").cast("date").alias("retrieved"), "o_orderkey",
        F.when(k % 30 == F.col("i"), F.col("o_totalprice") + F.col("i")).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return si.snapshot_history(s, key=["o_orderkey"], date="retrieved")


@query("snapshot_conflicts", sql("", """
SELECT o_orderkey FROM orders WHERE o_orderkey % 30 = 0 AND o_orderkey % 50 <> 0 AND o_orderkey % 40 <> 0"""))
def snapshot_conflicts(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    mark = lambda d: si.with_checksum(d.withColumn("retrieved", F.lit("2024-01-01")), key=["o_orderkey"], retrieval_date="retrieved")
    return si.snapshot_conflicts(mark(old), mark(new), key=["o_orderkey"]).select("o_orderkey")


@query("staged_publish", sql("ev", "SELECT CAST(year(event_date) AS INTEGER) AS year, count(*) AS n, round(sum(amount), 2) AS amount FROM ev GROUP BY 1"))
def staged_publish(spark, sf_dir):
    import uuid

    root = f"{scratch_dir(spark)}/publish-{uuid.uuid4().hex}"
    ev = an.events(spark, sf_dir).withColumn("year", F.year("event_date"))

    def unique_keys(written):
        repeated = written.groupBy("event_key").count().where("count > 1").limit(1).count()
        return "repeated event keys" if repeated else None

    si.publish(ev, root, gates=[unique_keys], partition_by=["year"])
    return si.read_current(spark, root).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("json_documents", sql("ev", """
SELECT segment, '{"records":[' || string_agg('{"year":' || y || ',"n":' || n || '}', ',' ORDER BY y) || ']}' AS document FROM (
SELECT segment, year(event_date) AS y, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1"""))
def json_documents(spark, sf_dir):
    t = an.events(spark, sf_dir).groupBy("segment", F.year("event_date").alias("year")).agg(F.count("*").alias("n"))
    return si.nested_records(t, by=["segment"], records=["year", "n"], order=["year"])


_LIMBS = ", ".join(f"sum(CAST(('0x' || substr(h, {s}, 12)) AS BIGINT))" for s in (1, 13, 25, 37, 49))


@query("content_digest", sql("", f"""
WITH r AS (SELECT sha256('{{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}}') AS h FROM orders)
SELECT count(*) AS n_rows, sha256('o_orderkey:bigint|o_custkey:bigint|o_orderstatus:string|o_orderpriority:string|' || sha256(concat_ws(':', count(*), {_LIMBS}))) AS digest FROM r"""))
def content_digest(spark, sf_dir):
    return si.content_digest(an.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("snapshot_store_days", """
SELECT r.retrieved, r.version, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total, 'accepted' AS redelivery, 'refused' AS changed
FROM orders, (VALUES ('1997-12-31', 1), ('1999-12-31', 2), ('2001-12-31', 3)) r(retrieved, version)
WHERE CAST(o_orderdate AS DATE) <= CAST(r.retrieved AS DATE) GROUP BY 1, 2""")
def snapshot_store_days(spark, sf_dir):
    """Three retrieval days of the orders known by then are stored; each is delivered again, equal and with one price changed."""
    import uuid

    from ..session import scratch_dir
    from ..sources.store import SnapshotConflict, SnapshotStore

    store = SnapshotStore(spark, f"{scratch_dir(spark)}/snapshots/{uuid.uuid4().hex}")
    orders = an.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    said = []
    for day in ("1997-12-31", "1999-12-31", "2001-12-31"):
        known = orders.where(F.col("day") <= F.lit(day).cast("date"))
        version = store.put(known, day)
        again = store.put(known.repartition(3), day) == version
        try:
            store.put(known.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 97 == 1, 1).otherwise(0)), day)
            changed = "accepted"
        except SnapshotConflict:
            changed = "refused"
        said.append((day, version, "accepted" if again else "refused", changed))
    facts = spark.createDataFrame(said, "retrieved string, version int, redelivery string, changed string")
    sums = store.history().groupBy("retrieved").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return sums.join(F.broadcast(facts), "retrieved").select("retrieved", "version", "n_rows", "total", "redelivery", "changed")
