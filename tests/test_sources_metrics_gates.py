import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofkit.functions import contract, digest, parsing as ps
from asofkit.operators import gates as ga, metrics as me, quality as qu, textscan as ts
from asofkit.sources import normalize as no, payloads as pa, sinks as si


def test_json_scans_from_files(spark, tmp_path):
    pages = {"pages": [{"url": "u", "body": {"data": [{"a": "1", "b": "null"}, {"a": "2"}]}}, {"url": "v", "body": {"data": [{"a": "3", "b": "x"}]}}]}
    (tmp_path / "p.json").write_text(json.dumps(pages, indent=1))
    got = pa.paged_records(pa.read_payloads(spark, str(tmp_path / "p.json"), pa.paged_schema(["a", "b"]))).collect()
    assert sorted(tuple(r) for r in got) == [("1", "null"), ("2", None), ("3", "x")]
    (tmp_path / "e.json").write_text(json.dumps({"pages": []}))
    assert pa.paged_records(pa.read_payloads(spark, str(tmp_path / "e.json"), pa.paged_schema(["a"]))).count() == 0
    ser = {"series": [{"keyid": "K", "url": "u", "period": None, "body": {"pd": {"timeseries": [{"asofdate": "2022-01-05", "value": "*"}, {"keyid": "L", "asofdate": "bad", "value": "7"}]}}}]}
    (tmp_path / "s.json").write_text(json.dumps(ser))
    rec = pa.series_records(pa.read_payloads(spark, str(tmp_path / "s.json"), pa.series_schema()))
    meta = spark.createDataFrame([("K", "CURRENT", "k")], "keyid string, period string, name string")
    rows, rejects = no.normalize_series(rec, meta)
    row = rows.first()
    assert (row["value"], row["value_raw"], row["missing_reason"]) == (None, "*", "withheld_by_source")
    assert [r["keyid"] for r in rejects.collect()] == ["L"]


def test_csv_years_with_different_headers(spark, tmp_path):
    (tmp_path / "rates_1990.csv").write_text('Date,"1 Mo"\n01/02/1990, 7.8\n01/02/1990,7.9\n')
    (tmp_path / "rates_2024.csv").write_text('Date,"1 Mo","2 Mo",X\n02/30/2024,5.1,,1\n03/01/2024,5.2,5.3,1\n')
    wide = pa.read_text_csv(spark, str(tmp_path), first_column="Date")
    assert wide.count() == 4 and {r[0] for r in wide.select("source_year").distinct().collect()} == {1990, 2024}
    typed, report = no.parse_wide_dates(wide, text="Date", out="day", known=["1 Mo", "2 Mo"])
    r = report.first()
    assert (r["n_invalid_dates"], r["n_duplicate_dates"], r["unknown_columns"]) == (1, 1, "X")
    long = no.unpivot_rates(typed, on="day", labels={"1 Mo": 1 / 12, "2 Mo": 2 / 12}, regime_change="2000-01-01", special={"2 Mo": "2024-01-01"})
    one = long.where("day = '2024-03-01' AND maturity = '2 Mo'").first()
    assert (one["value"], one["regime"], one["is_missing"]) == (5.3, "new_method+direct", False)


def test_tolerant_parsing(spark):
    df = spark.createDataFrame([("2024-02-30", "1e3", "50M1"), ("null", "null", "49Q2"), ("2024-02-29", "x", "99M13")], "d string, n string, v string")
    got = df.select(ps.parse_date("d").alias("d"), ps.invalid_date("d").alias("bd"), ps.parse_number("n").alias("n"), ps.invalid_number("n").alias("bn"),
                    ps.vintage_year("v").alias("y")).collect()
    assert [tuple(r) for r in got] == [(None, True, 1000.0, False, 1950), (None, False, None, False, 2049), (dt.date(2024, 2, 29), False, None, True, 1999)]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double").select(ps.nan_to_null("x").alias("x")).agg(F.avg("x"), F.count("x")).first()
    assert tuple(nan) == (1.0, 1)


def test_pivots_and_regimes_fail_loudly(spark):
    rows = [("d1", 0, 1.0), ("d1", 0, 2.0)]
    df = spark.createDataFrame(rows, "d string, c int, v double")
    with pytest.raises(Exception, match="duplicate rows"):
        no.pivot_unique(df, index="d", entity="c", entities=[0], values=["v"]).collect()
    both = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(Exception, match="overlapping"):
        no.combine_regimes(both, [F.col("a"), F.col("b")], "h").collect()


def test_quarterly_vintages(spark):
    from asofkit.operators.calendar import business_calendar

    m = spark.createDataFrame([("1999:Q1", 1.0, None), ("1999:Q3", 2.0, 3.0)], "DATE string, GDP99Q4 double, GDP00Q1 double")
    long, unknown = no.melt_vintage_matrix(m.withColumn("OTHER", F.lit(1)), period="DATE", prefix="GDP", vintage_frequency="quarterly", observation_frequency="quarterly")
    assert unknown == ["OTHER"]
    assert no.grid_gaps(long, by=["vintage_label"], observed="observed", months=3).where("vintage_label = '99Q4'").first()["n_gaps"] == 1
    dated = no.with_vintage_release_dates(long, business_calendar(spark, "1999-01-01", "2001-12-31"), frequency="quarterly", day=15, precision="exact")
    row = dated.where("vintage_label = '00Q1'").first()
    assert (row["vintage_year"], row["nominal_published_date"]) == (2000, dt.date(2000, 2, 15))
    assert no.vintage_index(dated).count() == 2


def test_missing_table_names_its_maker(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run ingest"):
        pa.read_processed(spark, str(tmp_path / "none"), "run ingest")


def test_failed_gate_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    si.publish(spark.range(3).toDF("k"), root)
    bad = spark.createDataFrame([(1,), (1,)], "k long")
    with pytest.raises(si.GateFailure):
        si.publish(bad, root, gates=ga.matrix_gates(key=["k"], required=["k"], contract=["k"], forbidden=[]))
    assert si.read_current(spark, root).count() == 3
    si.publish(spark.range(5).toDF("k"), root)
    assert si.read_current(spark, root).count() == 5


def test_gates_catch_a_leaky_build(spark):
    ev = spark.createDataFrame([(1, 10.0, 0.5), (2, 20.0, 0.7)], "k long, x double, y double")
    honest = lambda ev: ev.select("k", (F.col("x") * 2).alias("f"))
    leaky = lambda ev: ev.select("k", (F.col("x") + F.col("y")).alias("f"))
    ga.outcome_poisoning(honest, {"ev": ev}, table="ev", outcomes=["y"], key=["k"])
    ga.input_order_invariance(honest, {"ev": ev}, key=["k"])
    ga.future_row_invariance(honest, {"ev": ev}, {"ev": ev.limit(1).withColumn("k", F.lit(99).cast("long"))}, key=["k"])
    with pytest.raises(AssertionError):
        ga.outcome_poisoning(leaky, {"ev": ev}, table="ev", outcomes=["y"], key=["k"])
    peek = lambda ev: ev.join(F.broadcast(ev.agg(F.max("k").alias("m"))), F.lit(True)).select("k", F.col("m").alias("f"))
    with pytest.raises(AssertionError):
        ga.future_row_invariance(peek, {"ev": ev}, {"ev": ev.limit(1).withColumn("k", F.lit(99).cast("long"))}, key=["k"])
    with pytest.raises(Exception, match="repeated key"):
        ga.one_to_one(ev, ev.unionByName(ev).select("k", F.col("y").alias("z")), key="k").collect()
    late = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1), dt.date(2024, 1, 2))], "event_key long, v string, cut date, safe date")
    assert ga.availability_summary(late, cutoff="cut", by="v", sources={"s": "safe"}).first()["n_violations"] == 1


def test_forbidden_names_and_contract():
    found = ga.forbidden_columns(["x", "Public_Total", "share_y", "ok_share"], exact=["x"], patterns=["total", "share"], allow=["ok_share"])
    assert found == {"exact": ["x"], "pattern": ["Public_Total", "share_y"]}
    raw = [{"name": "f1", "role": "predictor", "family": "a", "tier": "core"}, {"name": "f2", "role": "predictor", "family": "b", "tier": "extended"},
           {"name": "f0", "role": "predictor", "family": "a", "tier": "structural"}, {"name": "y", "role": "target", "family": "t"}]
    entries = contract.parse_entries(raw)
    assert contract.tier_columns(entries, "core") == ["f0", "f1"] and contract.names(entries, role="target") == ["y"]
    contract.check_columns(["k", "f0", "f1", "f2"], entries, ids=["k"])
    with pytest.raises(AssertionError):
        contract.check_columns(["f0", "f1", "zz"], entries)
    with pytest.raises(ValueError):
        contract.parse_entries([*raw, raw[0]])
    assert no.schema_drift(["a", "b"], ["b", "c"]) == {"new_columns": ["a"], "missing_columns": ["c"]}


def _pred(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        actual = None if k % 20 == 0 else float(rng.random())
        for m in ("base", "new"):
            rows.append((k, "a", m, 2016 + k % 5, k % 5 == 4, "s", False, actual, float(rng.random())))
    return spark.createDataFrame(rows, "event_key long, cutoff_view string, model_id string, test_year int, is_provisional boolean, segment string, is_repeat boolean, actual double, forecast double")


def test_error_tables_and_pairs(spark):
    pred = _pred(spark)
    pdf = pred.toPandas().dropna()
    pdf["e"] = (pdf["forecast"] - pdf["actual"]) * 100
    got = me.error_metrics(me.with_scopes(me.scored(pred)), ["model_id", "scope"]).toPandas().set_index(["model_id", "scope"])
    done = pdf[(pdf["model_id"] == "new") & ~pdf["is_provisional"]]
    row = got.loc[("new", "complete")]
    assert row["n"] == len(done) and row["mae"] == pytest.approx(done["e"].abs().mean()) and row["median_ae"] == pytest.approx(done["e"].abs().median())
    assert row["r2_own_mean"] == pytest.approx(1 - ((done["e"] / 100) ** 2).sum() / ((done["actual"] - done["actual"].mean()) ** 2).sum())
    dist = me.error_distribution(pred.where("NOT is_provisional"), ["model_id"]).toPandas().set_index("model_id")
    assert dist.loc["new", "skew_error"] == pytest.approx(done["e"].skew())
    pairs = me.paired_comparison(me.pair_with_benchmark(pred, "base"), ["test_year"])
    me.require_paired(pairs)
    with pytest.raises(AssertionError):
        me.require_paired(me.paired_comparison(me.pair_with_benchmark(pred.where("NOT (model_id = 'base' AND event_key = 7)"), "base"), ["test_year"]))


def test_average_precision_calibration_and_gate(spark):
    rng = np.random.default_rng(6)
    s = np.round(rng.random(200), 2)
    y = (rng.random(200) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "s": s, "y": y}))
    ap, tp, last = 0.0, 0, 0.0
    for v in np.unique(s)[::-1]:
        take = s >= v
        tp, rec = y[take].sum(), y[take].sum() / y.sum()
        ap, last = ap + (rec - last) * tp / take.sum(), rec
    assert me.average_precision(df, ["g"], proba="s", label="y").first()["average_precision"] == pytest.approx(ap)
    one = df.withColumn("y", F.lit(1))
    assert me.average_precision(one, ["g"], proba="s", label="y").first()["average_precision"] is None
    want = pd.Series(s).groupby(pd.qcut(s, 5, duplicates="drop"), observed=True).agg(["size", "mean"])
    got = me.calibration_table(df, ["g"], proba="s", label="y").orderBy("bin").toPandas()
    assert list(got["n"]) == list(want["size"]) and np.allclose(got["mean_score"], want["mean"])
    lab = spark.createDataFrame([(2016, True)] * 6 + [(2017, True), (2017, None), (2017, False)], "y int, l boolean")
    gate = me.sufficiency_gate(lab, [], year="y", label="l", min_pooled=7).first()
    assert (gate["pooled_positives"], gate["pooled_labelled"], gate["passes"], gate["years_reported"], gate["years_suppressed"]) == (7, 8, True, "2016", "2017")


def test_year_tables(spark):
    rows = [("m", "b", "a", y, 10, 1.0, 2.0, w, 10 - w) for y, w in ((2015, 9), (2016, 9), (2018, 9), (2019, 3), (2020, 5))]
    t = spark.createDataFrame(rows, "model_id string, benchmark string, cutoff_view string, test_year int, n int, mae_model double, mae_benchmark double, n_model_better int, n_benchmark_better int")
    assert me.decision_rule(t).first()["meets_bar"] is True
    assert me.decision_rule(t.where("test_year >= 2018")).first()["meets_bar"] is False  # one win of three years
    wins = {r["outcome"]: (r["n_years"], r["years"]) for r in me.win_pattern(t, ["model_id"]).collect()}
    assert wins == {"won": (3, "2015-2016, 2018"), "lost": (1, "2019"), "tied": (1, "2020")}
    boot = me.block_bootstrap(t.withColumn("d", F.col("n_model_better").cast("double")), ["model_id"], value="d", order="test_year", n_boot=2000)
    a, b = boot.first(), boot.first()
    assert a == b and a["n_years"] == 5 and a["low"] < a["point"] < a["high"]
    rng = np.random.default_rng(0)
    ref = np.quantile(np.array([9, 9, 9, 3, 5])[rng.integers(0, 5, (20000, 5))].mean(1), [0.025, 0.975])
    assert abs(a["low"] - ref[0]) < 0.6 and abs(a["high"] - ref[1]) < 0.6
    single = me.block_bootstrap(t.where("test_year = 2015").withColumn("d", F.lit(1.0)), ["model_id"], value="d", order="test_year", n_boot=10).first()
    assert single["low"] is None


def test_snapshots_and_digest_limbs(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "k long, v string")
    got = {r["k"]: r["status"] for r in si.compare_snapshots(a, b, key=["k"]).collect()}
    assert got == {2: "changed", 3: "only_older", 4: "only_newer"}
    h = a.select(F.col("k"), digest.row_hash(["k", "v"]).alias("h"))
    whole = h.agg(*digest.limb_sums(F.col("h"))).select(digest.finish_digest().alias("d")).first()["d"]
    merged = h.groupBy("k").agg(*digest.limb_sums(F.col("h"))).agg(*digest.merge_limbs()).select(digest.finish_digest().alias("d")).first()["d"]
    assert whole == merged


def test_text_scan_redacts_and_counts_lines(spark):
    text = "first line\r\nmail bob@example.org and eve@example.org password = hunter2hunter2\nip 10.0.0.1"
    found = ts.scan_text(spark.createDataFrame([(1, text), (2, "clean text")], "k long, t string"), key="k", text="t").collect()
    got = {(r["line_no"], r["category"]): (r["severity"], r["redacted"]) for r in found}
    assert got[(2, "identifying_info:email_address")] == ("hard_block", "bo" + "*" * 11 + "rg")
    assert got[(3, "secret:generic_assignment")][0] == "hard_block" and got[(4, "identifying_info:ipv4_address")][0] == "review"
    assert len(got) == 3 and all("example" not in r["redacted"] for r in found)
    allow = spark.createDataFrame([(r["k"], r["fingerprint"]) for r in found if r["severity"] == "hard_block"], "k long, fingerprint string")
    rest = ts.without_allowed(spark.createDataFrame(found), allow, key="k")
    assert ts.passes(rest).first()["passed"] is True


def test_quality_states_sum_to_all_rows(spark):
    df = spark.range(10).withColumn("v", F.when(F.col("id") % 2 == 0, F.col("id")))
    t = qu.state_reconciliation(df, [("gone", F.col("v").isNull()), ("small", F.col("v") < 4)])
    assert {r["state"]: r["n"] for r in t.collect()} == {"gone": 5, "small": 2, "unclassified": 3}
