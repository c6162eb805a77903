"""Plans at size: small lookups go to the rows, rows are not shuffled by a handful of keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from asofkit.models import baselines as bl, labels as la, linear as li, surprise as su
from asofkit.operators import asof, folds as fo, metrics as me, quantiles as qt, rolling as ro
from asofkit.operators.quantiles import exact_quantiles
from asofkit.plans import evaluation_catalog as ev

P = fo.Pool()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pool(spark):
    day = F.date_add(F.lit(dt.date(2015, 1, 1)), (F.col("id") % 1400).cast("int"))
    return spark.range(3000).select(
        F.col("id").alias("event_key"), F.concat(F.lit("s"), F.col("id") % 3).alias("segment"), (F.col("id") % 2 == 0).alias("is_repeat"), day.alias("event_date"),
        F.year(day).alias("event_year"), F.date_add(day, -4).alias("announcement_cutoff"), F.date_add(day, 3).alias("result_safe_date"),
        F.rand(3).alias("primary_share"), F.lit(1.0).alias("amount")).localCheckpoint()


def test_group_tables_do_not_shuffle_the_test_rows(spark):
    rows = pool(spark)
    folds = fo.fold_origins(rows, P, first_year=2016, last_complete=2018)
    out = bl.mean_forecasts(rows, folds.localCheckpoint(), P)
    assert "SortMergeJoin" not in plan(out)


def test_days_are_looked_up_without_a_shuffle_of_events(spark):
    rows = pool(spark)
    releases = rows.select(F.col("result_safe_date").alias("safe"), F.col("event_key").alias("v")).where("v < 1000")
    assert "SortMergeJoin" not in plan(asof.asof_join(rows, releases, cutoff="announcement_cutoff", safe="safe", tie=["v"]))


def test_quantiles_of_overlapping_groups_repeat_rows_of_wanted_chunks_only(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.col("id") + 1).cast("double").alias("x")).localCheckpoint()
    expand = lambda df: df.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("g").cast("string"))))
    out = exact_quantiles(rows, by=["scope"], value="x", probs=[0.5], fine=["g"], expand=expand)
    assert "Generate" not in plan(out)
    assert {r["scope"]: r["quantiles"][0] for r in out.collect()} == {"all": 1000.5, "0": 1000.0, "1": 1001.0}


def test_rows_are_not_shuffled_by_fold_and_group_for_their_surprise(spark):
    """However few folds and groups there are, their rows stay spread; labels of inner holdouts take the safe date along."""
    rows = pool(spark).withColumn("regime", F.when(F.col("event_key") % 5 > 0, F.rand(4))).localCheckpoint()
    folds = fo.fold_origins(rows, P, first_year=2016, last_complete=2018).localCheckpoint()
    assert "SortMergeJoin" not in plan(su.walk_forward_surprise(rows, folds, P, "regime"))
    assert "SortMergeJoin" not in plan(la.stress_labels(rows, folds, P))
    inner = la.inner_holdout_labels(rows, fo.inner_holdouts(rows, folds, P), folds, P)
    assert "SortMergeJoin" not in plan(inner)
    safe = {r["event_key"]: (r["event_year"], r["result_safe_date"]) for r in rows.collect()}
    origin = {r["test_year"]: r["fit_origin"] for r in folds.collect()}
    found = inner.collect()
    assert {r["role"] for r in found} == {"train", "validation"}
    for r in found:
        year, day = safe[r["event_key"]]
        assert day <= origin[r["outer_year"]] and (year == r["outer_year"] - 1 if r["role"] == "validation" else year < r["outer_year"] - 1)


def test_marks_of_fits_are_compiled(spark):
    """No function is called per element of a row's marks, and marks stay as they were."""
    spans = [fo.FoldSpan(2016, dt.date(2015, 12, 28)), fo.FoldSpan(2017, dt.date(2016, 12, 28), 2016, dt.date(2015, 12, 28))]
    marked = pool(spark).select("event_year", "result_safe_date", fo.trains(spans, P).alias("t"), fo.validates(spans, P).alias("v"))
    assert "lambda" not in marked._jdf.queryExecution().optimizedPlan().toString()
    for r in marked.collect():
        day, year = r["result_safe_date"], r["event_year"]
        first, second = year < 2016 and day <= dt.date(2015, 12, 28), year < 2017 and day <= dt.date(2016, 12, 28)
        assert r["t"] == [f for f, on in ((2016, first), (2017, second), (-2017, first)) if on]
        assert r["v"] == ([2017] if year == 2016 and day <= dt.date(2016, 12, 28) else [])


def test_medians_of_fits_repeat_few_rows(spark, monkeypatch):
    """Of rows that train three fits each, hardly any is repeated for the medians, and what is repeated is written once."""
    written = []

    def spy(df):
        written.append(df.localCheckpoint())
        return written[-1]

    monkeypatch.setattr(qt, "materialise", spy)
    monkeypatch.setattr(li, "materialise", spy)
    rows = spark.range(20_001).select(F.array(F.lit(7), F.lit(-7), F.lit(8)).alias("fits"), F.lit(0.5).alias("y"), (1 + F.col("id") / 20_001).alias("x"), F.lit("a").alias("s"))
    design = li.Design(("x",), "s", ("a",))
    fits = {r["fold"]: r["n_train"] for r in li.fit_linear(rows, "fits", "y", design, [(1.0, None)]).collect()}
    assert fits == {7: 20_001, -7: 20_001, 8: 20_001}
    repeated = [df for df in written if {"fold", "__v"} <= set(df.columns)]
    assert len(repeated) == 1 and 3 <= repeated[0].count() < 1000
    data = li.training_rows(rows, "fits", "y", design)
    assert {(r["fold"], r["median"]) for r in li.fold_medians(data, design).collect()} == {(f, 1 + 10_000 / 20_001) for f in (7, -7, 8)}


def test_single_gate_counts_events_not_predictions(spark):
    kinds = F.array(*[F.struct(F.lit(t).alias("target_name"), F.lit("v").alias("cutoff_view"), F.lit(str(i)).alias("model_id")) for t in ("a", "b") for i in range(40)])
    pred = spark.range(50).select(F.col("id").alias("event_key"), F.inline(kinds))
    assert ev.require_single(pred) is pred
    with pytest.raises(AssertionError, match="'model_id': '39'"):
        ev.require_single(pred.unionByName(pred.where("event_key = 7 AND model_id = '39' AND target_name = 'b'")))


def test_violations_sort_narrow_rows(spark):
    rows = pool(spark).withColumn("wide", F.repeat(F.lit("x"), 500))
    out = ro.availability_violations(rows, by=["segment"], order=["event_date", "event_key"], safe="result_safe_date", cutoffs={"at": "announcement_cutoff"}, key="event_key")
    # neither other columns nor lists of earlier rows lie in a sort: lists are only made of the few rows that a chunk sends on
    assert all("__hist" not in line and "wide" not in line and "__all" not in line for line in plan(out).splitlines() if "Sort [" in line)
    assert "SortMergeJoin" not in plan(out) and "BroadcastHashJoin" not in plan(out)
    late = out.groupBy("lag").count().collect()
    held = sorted(((r["segment"], r["event_date"], r["event_key"]), r["result_safe_date"], r["announcement_cutoff"]) for r in rows.collect())
    want = {n: sum(a[0][0] == b[0][0] and a[1] > b[2] for a, b in zip(held, held[n:])) for n in range(1, 9)}
    assert {r["lag"]: r["count"] for r in late} == {n: c for n, c in want.items() if c}


def test_rows_are_not_shuffled_by_group_for_its_median_or_bin_edges(spark):
    rows = spark.range(2000).select(
        F.concat(F.lit("v"), F.col("id") % 2).alias("cutoff_view"), F.col("id").alias("event_key"), F.lit(0.0).alias("actual"), F.lit(0.0).alias("forecast"),
        F.col("id").cast("double").alias("benchmark_forecast"), (F.col("id") % 3 == 0).cast("int").alias("label")).localCheckpoint()
    found = me.case_studies(rows, ["cutoff_view"])
    assert "SortMergeJoin" not in plan(found)
    assert {(r["cutoff_view"], r["rule"]): r["event_key"] for r in found.collect()} == {
        (f"v{i}", k): e for i in (0, 1) for k, e in (("largest_gain", 1998 + i), ("largest_loss", i), ("closest_to_median", 998 + i))}
    table = me.calibration_table(rows, ["cutoff_view"], proba="benchmark_forecast", label="label")
    assert "SortMergeJoin" not in plan(table)
    assert {(r["cutoff_view"], r["bin"]): r["n"] for r in table.collect()} == {(f"v{i}", b): 200 for i in (0, 1) for b in range(5)}
