"""The evaluation over all models on the smallest tables: shape of the prediction table, gates, and lineage."""

import pytest
from pyspark.sql import functions as F

from asofkit.operators import folds as fo
from asofkit.plans import backtest as bt, evaluation_catalog as ev

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def means(spark):
    return ev.mean_evaluation(spark, SF)


def test_every_test_row_has_one_forecast_per_model_target_and_cutoff(spark, means):
    pool = ev.target_pool(spark, SF)
    n_test = fo.test_rows(pool, bt.folds(pool), fo.Pool()).count()
    counts = {(r["target_name"], r["cutoff_view"], r["model_id"]): r["count"] for r in means.groupBy("target_name", "cutoff_view", "model_id").count().collect()}
    assert len(counts) == len(ev.TARGETS) * len(ev.CUTOFFS) * 6 and set(counts.values()) == {n_test}
    low = means.where("target_name <> 'cover_ratio' AND forecast NOT BETWEEN 0 AND 1").count()
    assert low == 0 and means.where("was_clipped <> (forecast <> forecast_unclipped)").count() == 0


def test_a_repeated_prediction_is_an_error(means):
    assert ev.require_single(means) is means
    with pytest.raises(AssertionError, match="duplicate prediction"):
        ev.require_single(means.unionByName(means.limit(1)))


def test_lineage_names_only_what_was_safe(spark, means):
    late = means.where("training_max_safe_date > training_origin_date OR training_row_count <= 0").count()
    assert late == 0
    pool = ev.target_pool(spark, SF)
    f = bt.folds(pool)
    want = {r["test_year"]: r["count"] for r in fo.train_rows(pool, f, fo.Pool()).groupBy("test_year").count().collect()}
    got = {r["test_year"]: r["training_row_count"] for r in ev.fold_lineage(pool, f, fo.Pool()).collect()}
    assert got == want


def test_linear_models_of_both_cutoffs_come_from_their_own_rows(spark):
    """Fits of one view equal those of that view alone."""
    pool, table = ev.target_pool(spark, SF), ev.full_table(spark, SF)
    f = bt.folds(pool)
    h = fo.inner_holdouts(pool, f, fo.Pool())
    both = ev.linear_predictions(pool, table, f, h, "direct_share")
    alone = ev.linear_predictions(pool, table.where("cutoff_view = 'pre_event'"), f, h, "direct_share")
    key = ["event_key", "model_id"]
    near = both.where("cutoff_view = 'pre_event'").join(alone.select(*key, F.col("forecast").alias("other")), key)
    assert near.count() == alone.count() > 0
    assert near.agg(F.max(F.abs(F.col("forecast") - F.col("other")))).first()[0] < 1e-6
    assert both.groupBy(*key, "cutoff_view").count().where("count > 1").count() == 0


def test_the_cube_rolls_up_to_direct_metrics(means):
    one = means.where("target_name = 'direct_share' AND model_id = 'shrinkage' AND cutoff_view = 'announcement'")
    cube = {(r["scope"], r["scope_value"]): r for r in ev.metric_cube(one).collect()}
    e = (F.col("forecast") - F.col("actual")) * 100
    known = one.where("actual IS NOT NULL")
    for scope, value, rows in (("complete", "all", known.where("NOT is_provisional")), ("provisional", "all", known.where("is_provisional")),
                               ("test_year", "1999", known.where("test_year = 1999")), ("segment", "5-LOW", known.where("segment = '5-LOW' AND NOT is_provisional"))):
        want = rows.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.percentile(F.abs(e), 0.5).alias("med")).first()
        got = cube[(scope, value)]
        assert got["n"] == want["n"] and got["mae"] == pytest.approx(want["mae"]) and got["median_ae"] == pytest.approx(want["med"])


# ---------------------------------------------------------------- gates

def _late_history(events, releases, by=()):
    """A leaky build: an event's own history takes outcomes on the event's day instead of the day they became safe."""
    return ev.build_table(events.withColumn("result_safe_date", F.date_sub("result_safe_date", 40)), releases, by=by)


def _unsafe(source):
    """A leaky build: one release is used from the day it describes on."""
    def build(events, releases, by=()):
        early = releases[source].withColumn(f"{source}__safe_date", F.date_sub(f"{source}__safe_date", 30))
        return ev.build_table(events, {**releases, source: early}, by=by)
    return build


@pytest.fixture(scope="module")
def inputs(spark):
    pool = bt.staged_pool(spark, SF)
    return pool, {k: v.cache() for k, v in ev.release_tables(spark, SF).items()}


def test_an_honest_build_passes_and_reads_every_source(inputs):
    report = ev.perturbation_report(*inputs, ev.GATE_CUT).cache()
    ev.require_no_leak(report)
    assert {r["source"] for r in report.collect()} == {*ev.SOURCES, "history"}
    assert all(r["n_early"] > 0 and r["n_late_changed"] > 0 for r in report.collect())


@pytest.mark.parametrize("source", ["weekly", "macro", "history"])
def test_a_planted_leak_is_found_and_named(inputs, source):
    report = ev.perturbation_report(*inputs, ev.GATE_CUT, build=_late_history if source == "history" else _unsafe(source))
    with pytest.raises(AssertionError, match=f"used: {source}$"):
        ev.require_no_leak(report)


def test_versions_are_not_written_wide_nor_dealt_to_a_fixed_number_of_tasks(inputs, monkeypatch):
    widths, write = [], ev.materialise
    monkeypatch.setattr(ev, "materialise", lambda df: widths.append(len(df.columns)) or write(df))
    ev.perturbation_report(*inputs, ev.GATE_CUT).collect()
    assert max(widths) <= 3
    events, _ = ev.perturbed_inputs(*inputs, ev.GATE_CUT)
    assert "REPARTITION_BY_NUM" not in events._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- the matrix without its written table

def test_matrix_and_its_tree_do_not_write_the_wide_table(spark, monkeypatch):
    table = ev.full_table(spark, SF)
    monkeypatch.setattr(ev, "full_table", lambda *a: pytest.fail("the wide table is written"))
    got = ev.full_predictor_matrix(spark, SF)
    places = {"log_amount": 9, "recent_mean": 9, "macro_yoy": 9, **{c: 8 for c in ev.PREDICTORS if c.endswith("change")}}
    want = table.withColumns({c: F.round(c, n) for c, n in places.items()}).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert ev.matrix_tree(spark, SF).count() == len(ev.CUTOFFS)


def test_predictions_write_only_what_the_long_table_reads(spark, monkeypatch):
    written, write = [], bt.materialise
    monkeypatch.setattr(bt, "materialise", lambda df: written.append(df.columns) or write(df))
    got = ev.mc.all_baseline_predictions(spark, SF)
    assert len(written[-1]) == 13
    want = ev.mc.rounded(bt.predictions(spark, SF), 8)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
