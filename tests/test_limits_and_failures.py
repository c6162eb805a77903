"""Cases that used to pass silently: reversed cutoffs, days outside the calendar, missing keys, infinities, unfit folds."""

import datetime as dt
import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from asofkit import session
from asofkit.models import labels as la, linear as li
from asofkit.operators import asof, calendar as cal, gates as ga
from asofkit.operators.quantiles import exact_quantiles

D = dt.date


def test_no_scratch_folder_outside_local_mode():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    remote = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(remote)
    remote.conf.set("spark.checkpoint.dir", "file:///shared/")
    assert session.scratch_dir(remote) == "file:///shared"
    here = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="local[2]"))
    assert session.scratch_dir(here) == here.conf["spark.checkpoint.dir"]


def test_a_staged_table_is_written_once(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    a, b = session.staged(spark, "five", "here", build), session.staged(spark, "five", "here", build)
    assert a.inputFiles() == b.inputFiles() and built == [1]
    session.staged(spark, "five", "there", build)
    assert built == [1, 1]


def test_days_outside_the_calendar_fail_and_missing_days_do_not(spark):
    c = cal.business_calendar(spark, "2024-01-01", "2024-12-31")
    df = spark.createDataFrame([(D(2024, 3, 1),), (None,)], "day date")
    assert {r["out"] for r in cal.with_next_business_day(df, c, "day", "out").collect()} == {D(2024, 3, 4), None}
    with pytest.raises(Exception, match="outside the calendar"):
        cal.with_next_business_day(spark.createDataFrame([(D(2026, 5, 5),)], "day date"), c, "day", "out").collect()


def test_a_closure_of_thirty_days(spark):
    closed = spark.sql("SELECT explode(sequence(DATE '2020-03-01', DATE '2020-03-30')) AS day")
    c = cal.business_calendar(spark, "2020-01-01", "2020-12-31", closed)
    row = c.where("day = DATE '2020-02-28'").first()
    assert row["next_business_day"] == D(2020, 3, 31)
    assert c.where("day = DATE '2020-03-31'").first()["previous_business_day"] == D(2020, 2, 28)


def test_reversed_cutoffs_are_counted(spark):
    rows = [(1, D(2024, 1, 2), D(2024, 1, 5), D(2024, 1, 1), D(2024, 1, 4)), (2, D(2024, 1, 5), D(2024, 1, 2), D(2024, 1, 4), D(2024, 1, 1)),
            (3, D(2024, 1, 2), D(2024, 1, 5), D(2024, 1, 1), None), (4, D(2024, 1, 2), D(2024, 1, 2), D(2024, 1, 2), D(2024, 1, 1))]
    t = spark.createDataFrame(rows, "k int, first date, second date, a date, b date")
    got = ga.monotonicity(t, cutoffs=["first", "second"], earlier="a", later="b").first()
    assert tuple(got) == (4, 1, 1, 1)


def test_late_keys_names_every_offender(spark):
    t = spark.createDataFrame([(1, "v", D(2024, 1, 5), D(2024, 1, 7), None), (2, "v", D(2024, 1, 5), D(2024, 1, 5), D(2024, 1, 6))],
                              "event_key int, view string, cutoff date, s1 date, s2 date")
    got = ga.late_keys(t, cutoff="cutoff", by="view", sources={"one": "s1", "two": "s2"})
    assert sorted(map(tuple, got.collect())) == [("v", "one", 1, 2), ("v", "two", 2, 1)]


def test_key_sets_must_be_equal(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, x string")
    right = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, y double")
    assert ga.one_to_one(left, right, key="k").count() == 3
    for other in (right.where("k = 1"), right.union(spark.createDataFrame([(3, 3.0)], "k int, y double"))):
        with pytest.raises(ValueError, match="key sets differ"):
            ga.one_to_one(left, other, key="k")


def test_a_missing_key_is_carried_across_buckets(spark):
    at = dt.datetime
    events = spark.createDataFrame([(1, None, at(2024, 1, 1, 12)), (2, None, at(2024, 1, 9))], "e int, k string, t timestamp")
    releases = spark.createDataFrame([(None, at(2024, 1, 1, 9), 7)], "k string, s timestamp, v int")
    out = asof.asof_join_timestamps(events, releases, at="t", safe="s", by=["k"], tie=["v"])
    assert {r["e"]: r["v"] for r in out.collect()} == {1: 7, 2: 7}


def test_quantiles_of_infinite_values(spark):
    values = [-math.inf, -2.0, 0.0, 1.0, 5.0, math.inf, math.inf, None, math.nan]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    q = exact_quantiles(df, by=["g"], value="v", probs=[0.0, 0.5, 1.0]).first()["quantiles"]
    assert q == [-math.inf, 1.0, math.inf]


def test_percentile_thresholds_on_one_value_and_none(spark):
    one = la.percentile_thresholds(spark.createDataFrame([(2.0,), (None,)], "v double"), value="v")
    assert {tuple(r)[1:] for r in one.collect()} == {(2.0, 1, 1, 1.0)} and one.count() == 4
    assert la.percentile_thresholds(spark.createDataFrame([], "v double"), value="v").count() == 0


def test_rows_of_an_unfit_fold_stay_with_a_reason(spark):
    design = li.Design(numeric=("a",), category="s", values=("x",))
    rows = spark.createDataFrame([(1, 2000, 1.0, "x", 1), (2, 2001, 1.0, "x", None)], "event_key int, year int, a double, s string, label int")
    fits = spark.createDataFrame([(2000, 1.0, [0.0] * design.width)], "fold int, c double, coefficients array<double>")
    prevalence = spark.createDataFrame([(2000, 0.2)], "fold int, train_prevalence double")
    chosen = spark.createDataFrame([(2000, 1.0)], "fold int, c double")
    out = {r["event_key"]: r for r in li.logistic_forecasts(rows, fits, chosen, prevalence, "year", design).collect()}
    assert out[1]["predicted_proba"] == 0.5 and out[1]["missing_reason"] is None
    assert out[2]["predicted_proba"] is None and out[2]["missing_reason"] == "one_class_in_training"


def test_elastic_net_that_does_not_settle_raises():
    import numpy as np
    near = 1 - 1e-7  # two columns that are all but equal: each sweep moves a hair
    g = np.array([[4.0, 0, 0, 0], [0, 1.0, near, 1.0], [0, near, 1.0, 0.0], [0, 1.0, 0.0, 1.0]])
    pick = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    with pytest.raises(ArithmeticError):
        li._solve(g, pick, 1e-12, 0.5)
