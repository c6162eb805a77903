import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofkit.models import baselines as bl, labels as la, linear as li, shrinkage as sh, surprise as su
from asofkit.operators import folds as fo
from asofkit.sources.sinks import content_digest

P = fo.Pool()


def make_pool(seed=1, n=900):
    rng = np.random.default_rng(seed)
    day = pd.Timestamp("2015-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 365 * 5, n)), "D")
    pdf = pd.DataFrame({
        "event_key": rng.permutation(n), "segment": rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]), "is_repeat": rng.random(n) < 0.4,
        "event_date": day, "amount": np.exp(rng.normal(10, 1, n)), "regime": rng.random(n)})
    pdf["primary_share"] = 0.3 + 0.1 * (pdf["segment"] == "a") + 0.02 * np.log(pdf["amount"]) + 0.1 * pdf["regime"] + rng.normal(0, 0.05, n)
    pdf.loc[rng.integers(0, n, 20), "primary_share"] = np.nan
    pdf.loc[rng.integers(0, n, 30), "regime"] = np.nan
    pdf["announcement_cutoff"] = pdf["event_date"] - pd.to_timedelta(4, "D")
    pdf["result_safe_date"] = pdf["event_date"] + pd.to_timedelta(5, "D")  # year ends cross the origin
    pdf["event_year"] = pdf["event_date"].dt.year.astype("int32")
    return pdf


@pytest.fixture(scope="module")
def pool(spark):
    pdf = make_pool()
    out = pdf.assign(**{c: pdf[c].dt.date for c in ("event_date", "announcement_cutoff", "result_safe_date")})
    df = spark.createDataFrame(out)
    for c in ("primary_share", "regime"):
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return pdf, df.cache()


def fold_of(pdf, year):
    test = pdf[pdf["event_year"] == year]
    origin = test["announcement_cutoff"].min()
    before = pdf[pdf["event_year"] < year]
    return before[before["result_safe_date"] <= origin], test, len(before[before["result_safe_date"] > origin])


def folds(df):
    return fo.fold_origins(df, P, first_year=2016, last_complete=2018)


def test_folds_drop_late_rows_and_pass_the_gate(pool):
    pdf, df = pool
    rows = {r["test_year"]: r for r in fo.fold_manifest(df, folds(df), P).collect()}
    assert sum(r["n_dropped"] for r in rows.values()) > 0
    for year, r in rows.items():
        train, test, dropped = fold_of(pdf, year)
        assert (r["n_train"], r["n_test"], r["n_dropped"]) == (len(train), len(test), dropped)
    members = fo.fold_rows(df, folds(df), P)
    bad = fo.fold_violations(members, df, folds(df), P).agg(F.sum("n_late"), F.sum("n_overlap")).first()
    assert tuple(bad) == (0, 0)
    leaky = members.withColumn("role", F.when(F.col("role") == "dropped", "train").otherwise(F.col("role")))
    assert fo.fold_violations(leaky, df, folds(df), P).agg(F.sum("n_late")).first()[0] > 0


def test_digest_ignores_order_and_sees_changes(pool):
    _, df = pool
    base = content_digest(df).first()["digest"]
    assert content_digest(df.repartition(7).orderBy("amount")).first()["digest"] == base
    assert content_digest(df.withColumn("amount", F.when(F.col("event_key") == 5, 1.0).otherwise(F.col("amount")))).first()["digest"] != base
    assert content_digest(df.where("event_key <> 5")).first()["digest"] != base


def test_means_and_recent_history_equal_a_fold_loop(pool):
    pdf, df = pool
    got = bl.baseline_forecasts(df, folds(df), P, cutoffs={"announcement": "announcement_cutoff"}).toPandas().set_index("event_key")
    for year in (2016, 2017, 2019):
        train, test, _ = fold_of(pdf, year)
        train = train.dropna(subset=["primary_share"])
        seg = train.groupby("segment")["primary_share"].mean()
        cell = train.groupby(["segment", "is_repeat"])["primary_share"].mean()
        recent = train.sort_values(["event_date", "event_key"]).groupby("segment")["primary_share"].apply(lambda s: s.tail(8).mean())
        for r in test.itertuples():
            g = got.loc[r.event_key]
            assert g["global_mean"] == pytest.approx(train["primary_share"].mean())
            assert g["segment_mean"] == pytest.approx(seg[r.segment])
            assert g["segment_repeat_mean"] == pytest.approx(cell[(r.segment, r.is_repeat)])
            assert g["recent_frozen"] == pytest.approx(recent[r.segment])


def test_surprise_equals_least_squares(pool):
    pdf, df = pool
    out = su.walk_forward_surprise(df, folds(df), P, "regime").toPandas().set_index("event_key")
    for year in (2017, 2019):
        train, test, _ = fold_of(pdf, year)
        train = train.dropna(subset=["primary_share"])
        fill = train["regime"].mean()
        means = train.groupby(["segment", "is_repeat"])["primary_share"].mean()
        res = train["primary_share"] - pd.Series([means[(s, r)] for s, r in zip(train["segment"], train["is_repeat"])], index=train.index)
        x, g = np.log(train["amount"]), train["regime"].fillna(fill)
        b, *_ = np.linalg.lstsq(np.column_stack([x - x.mean(), g - g.mean()]), res, rcond=None)
        for r in test.itertuples():
            reg = fill if pd.isna(r.regime) else r.regime
            want = means[(r.segment, r.is_repeat)] + b[0] * (np.log(r.amount) - x.mean()) + b[1] * (reg - g.mean())
            assert out.loc[r.event_key, "expected"] == pytest.approx(want, abs=1e-9)


def test_surprise_with_a_constant_column_uses_minimum_norm(pool):
    _, df = pool
    flat = df.withColumn("regime", F.lit(0.4))
    sums = su.group_sums_by_fold(su.surprise_cells(flat, P, "regime"), folds(flat), P)
    row = su.fit_surprise(sums, ["test_year"]).first()
    assert row["regime_slope"] == pytest.approx(0.0, abs=1e-6) and row["amount_slope"] is not None


@pytest.mark.parametrize("case", ["one_group", "singletons", "equal_means"])
def test_shrinkage_degenerate_cases(spark, case):
    rows = {
        "one_group": [("a", False, 0.2), ("a", False, 0.4)],
        "singletons": [("a", False, 0.1), ("b", False, 0.5), ("c", True, 0.9)],
        "equal_means": [(s, f, v) for s in "ab" for f in (True, False) for v in (0.2, 0.4)],
    }[case]
    recs = [(i, s, f, pd.Timestamp("2015-03-01").date(), 2015, pd.Timestamp("2015-03-05").date(), v) for i, (s, f, v) in enumerate(rows)]
    df = spark.createDataFrame(recs, "event_key long, segment string, is_repeat boolean, event_date date, event_year int, result_safe_date date, primary_share double")
    f = spark.createDataFrame([(2016, pd.Timestamp("2016-01-01").date())], "test_year int, fit_origin date")
    got = {(r["segment"], r["is_repeat"]): r for r in sh.shrunk_means(df, f, P).collect()}
    if case == "one_group":
        assert got[("a", False)]["estimate"] == pytest.approx(0.3) and got[("a", False)]["weight"] == 1.0
    elif case == "singletons":  # no within degrees of freedom: the variance of all rows stands in
        overall, k = np.var([0.1, 0.5, 0.9], ddof=1), None
        ssb = sum((x - 0.5) ** 2 for x in (0.1, 0.5, 0.9))
        between = max((ssb / 2 - overall) / 1.0, 1e-8)
        k = overall / between
        assert got[("a", False)]["weight"] == pytest.approx(1 / (1 + k))
    else:  # no spread between groups: everything shrinks to the common mean
        assert all(r["weight"] < 1e-3 and r["estimate"] == pytest.approx(0.3) for r in got.values())


def test_labels_come_from_training_rows_only(pool):
    _, df = pool
    base = la.stress_labels(df, folds(df), P)
    late = df.withColumn("primary_share", F.when(F.col("event_year") == 2019, 0.99).otherwise(F.col("primary_share")))
    other = la.stress_labels(late, folds(late), P)
    near = lambda rows: rows.where("role = 'train'").withColumn("surprise", F.round("surprise", 9))  # noqa: E731  sums may be added in any order
    assert near(base).exceptAll(near(other)).count() == 0
    missing = base.where("surprise IS NULL AND label IS NOT NULL").count()
    assert missing == 0


DESIGN = li.Design(("log_amount", "regime", "void"), "segment", ("a", "b", "c"))


def _linear_frame(pool):
    _, df = pool
    return df.withColumns({"log_amount": F.log("amount"), "void": F.lit(None).cast("double"), "fold": (F.col("event_key") % 2).cast("int")})


def _dense(pdf):
    reg = pdf["regime"].fillna(pdf["regime"].median())
    x = np.column_stack([np.log(pdf["amount"]), reg, pdf["regime"].isna()]).astype(float)
    x = (x - x.mean(0)) / x.std(0)
    return np.column_stack([x, *[(pdf["segment"] == s).astype(float) for s in "abc"]])


def test_ridge_and_elastic_net(pool):
    pdf, _ = pool
    df = _linear_frame(pool)
    fits = li.fit_linear(df, "fold", "primary_share", DESIGN, [(1.0, None), (0.01, 0.5)])
    pred = {}
    for c in (0, 1):
        rows = li.linear_forecasts(df.drop("fold").withColumn("f", (F.col("event_key") % 2).cast("int")), fits.where(F.col("candidate") == c), "f", DESIGN, "y")
        pred[c] = rows.select("event_key", "y").toPandas().set_index("event_key")["y"]
    for fold in (0, 1):
        part = pdf[(pdf["event_key"] % 2 == fold) & pdf["primary_share"].notna()]
        x, y, n = _dense(part), part["primary_share"].to_numpy(), len(part)
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
        np.testing.assert_allclose(pred[0][part["event_key"]], xc @ w + y.mean(), rtol=1e-8)
        # optimality of the elastic net: the subgradient contains zero
        resid = y - pred[1][part["event_key"]].to_numpy()
        w1, *_ = np.linalg.lstsq(xc, pred[1][part["event_key"]].to_numpy() - y.mean(), rcond=None)
        grad = -xc.T @ resid / n + 0.01 * 0.5 * w1
        for g, b in zip(grad[:3], w1[:3]):
            assert abs(g) <= 0.005 + 1e-6 if abs(b) < 1e-9 else g == pytest.approx(-0.005 * np.sign(b), abs=1e-5)


def test_logistic_matches_a_dense_newton_fit(pool):
    pdf, _ = pool
    df = _linear_frame(pool).withColumn("label", (F.col("primary_share") > 0.6).cast("int"))
    got = li.fit_logistic(df, {f: F.when(F.col("fold") == f, F.col("label")) for f in (0, 1)}, DESIGN, [1.0])
    for fold in (0, 1):
        part = pdf[(pdf["event_key"] % 2 == fold) & pdf["primary_share"].notna()]
        x = np.column_stack([np.ones(len(part)), _dense(part)])
        y = (part["primary_share"] > 0.6).to_numpy(float)
        w, pen = np.zeros(x.shape[1]), np.array([0.0] + [1.0] * (x.shape[1] - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(pen) + 1e-12 * np.eye(len(w)), x.T @ (p - y) + pen * w)
        z = DESIGN.raw(part.assign(log_amount=np.log(part["amount"]), void=np.nan)) @ got[(fold, 1.0)]
        np.testing.assert_allclose(z, x @ w, atol=1e-6)


def test_single_class_fold_has_no_classifier(pool):
    df = _linear_frame(pool)
    labels = {0: F.when(F.col("fold") == 0, 0), 1: F.when(F.col("fold") == 1, (F.col("primary_share") > 0.6).cast("int")), 7: F.lit(None)}
    assert {k[0] for k in li.fit_logistic(df, labels, DESIGN, [1.0])} == {1}


def test_sums_of_several_classifiers_in_one_pass(pool):
    """Loss, gradient and curvature of every fit and penalty equal those taken row by row, far out scores too and without overflow."""
    df = _linear_frame(pool)
    rows = df.select(*DESIGN.numeric, DESIGN.category, *[F.when(c, (F.col("event_key") % 3 == 0).cast("int")).otherwise(-1).cast("tinyint").alias(f"__y{k}")
                                                         for k, c in enumerate((F.col("fold") == 0, F.lit(True), F.lit(False)))]).toPandas()
    x, draw = DESIGN.raw(rows), np.random.default_rng(1)
    w = draw.normal(size=(DESIGN.width, 4)) * np.array([0.1, 1.0, 200.0, 1.0])
    y = rows[["__y0", "__y1", "__y1", "__y2"]].to_numpy()
    with np.errstate(over="raise", invalid="raise"):
        got = li._loss_parts(x, y, w)
    up = np.triu_indices(DESIGN.width)
    for m in range(4):
        xm, ym = x[y[:, m] >= 0], y[y[:, m] >= 0, m].astype(float)
        z = xm @ w[:, m]
        p = 0.5 * (1 + np.tanh(z / 2))
        loss = np.logaddexp(0.0, np.where(ym > 0, -z, z)).sum()
        want = np.concatenate([[loss], xm.T @ (p - ym), ((xm * (p * (1 - p))[:, None]).T @ xm)[up]])
        np.testing.assert_allclose(got[:, m], want, rtol=1e-9, atol=1e-8)
    assert not got[:, 3].any()


@pytest.mark.parametrize("steps", [1, 3, 60])
def test_separable_fold_ends_with_a_finite_classifier(pool, steps):
    """Labels that one column decides, hardly any penalty: the coefficients grow but stay finite and right."""
    pdf, _ = pool
    df = _linear_frame(pool)
    got = li.fit_logistic(df, {5: (F.col("amount") > 22026.0).cast("int")}, DESIGN, [1.0, 1e8], steps=steps)
    assert set(got) == {(5, 1.0), (5, 1e8)} and all(np.isfinite(w).all() for w in got.values())
    if steps == 60:
        z = DESIGN.raw(pdf.assign(log_amount=np.log(pdf["amount"]), void=np.nan)) @ got[(5, 1e8)]
        assert ((z > 0) == (pdf["amount"] > 22026.0)).all()


def test_rows_that_train_several_fits_are_read_once(pool):
    """Lists of fits give the fits that copies of the rows give."""
    _, df = pool
    df = _linear_frame(pool)
    spans = fo.fold_spans(folds(df), fo.inner_holdouts(df, folds(df), P))
    marked = df.withColumn("__trains", fo.trains(spans, P))
    grid = [(1.0, None), (0.01, 0.5)]
    one = {(r["fold"], r["candidate"]): r for r in li.fit_linear(marked, "__trains", "primary_share", DESIGN, grid).collect()}
    copies = marked.withColumn("f", F.explode("__trains"))
    two = {(r["fold"], r["candidate"]): r for r in li.fit_linear(copies, "f", "primary_share", DESIGN, grid).collect()}
    assert set(one) == set(two) and min(k[0] for k in one) < 0
    for k in one:
        assert one[k]["n_train"] == two[k]["n_train"]
        np.testing.assert_allclose(one[k]["coefficients"], two[k]["coefficients"], rtol=1e-9, atol=1e-12)
    members = {(r["test_year"], r["event_key"]) for r in fo.fold_rows(df, folds(df), P).where("role = 'train'").collect()}
    assert members == {(r["f"], r["event_key"]) for r in copies.where("f > 0").select("f", "event_key").collect()}
    held = df.withColumn("v", F.explode(fo.validates(spans, P))).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in held} == {r["test_year"]: r["n_inner_validation"] for r in fo.inner_holdouts(df, folds(df), P).where("usable").collect()}


# ---------------------------------------------------------------- the walk-forward protocol

def test_surprise_and_shrinkage_by_the_protocol(pool):
    from asofkit.models import walkforward as wf
    _, df = pool
    f = folds(df)
    near = lambda a, b, c: (a.join(b.select(*[x for x in a.columns if x in ("event_key", "test_year", "inner_year")], F.col(c).alias("other")),
                                   [x for x in a.columns if x in ("event_key", "test_year", "inner_year")], "full").where(
        f"NOT (({c} IS NULL AND other IS NULL) OR abs({c} - other) < 1e-9)").count())
    assert near(wf.walk_forward(df, f, P, wf.Surprise(P, "regime")), su.walk_forward_surprise(df, f, P, "regime"), "expected") == 0
    inside = wf.walk_forward_inside(df.where("primary_share IS NOT NULL"), f, P, wf.Surprise(P, "regime"))
    assert near(inside.where("surprise IS NOT NULL"), la.cross_fitted_surprise(df, f, P), "surprise") == 0
    assert near(wf.walk_forward(df, f, P, wf.ShrunkMeans(P)), sh.shrinkage_forecasts(fo.test_rows(df, f, P), sh.shrunk_means(df, f, P), P), "shrinkage") == 0


def test_an_estimator_of_ones_own(pool):
    """A trend per segment from partial sums by mapInArrow, forward and inside folds, against least squares."""
    import pyarrow as pa
    from asofkit.models import walkforward as wf
    pdf, df = pool

    class Trend(wf.Estimator):
        groups = ("segment",)

        def cells(self, rows, p):
            def sums(batches):
                for b in batches:
                    t = b.to_pandas()
                    t = t.assign(n=1.0, xy=t["x"] * t["y"], xx=t["x"] ** 2).groupby(["segment", "event_year", "result_safe_date"], as_index=False)[["n", "x", "y", "xy", "xx"]].sum()
                    yield pa.RecordBatch.from_pandas(t, preserve_index=False)
            few = rows.where(F.col(p.value).isNotNull()).select("segment", "event_year", "result_safe_date", F.ln("amount").alias("x"), F.col(p.value).alias("y"))
            return few.mapInArrow(sums, "segment string, event_year long, result_safe_date date, n double, x double, y double, xy double, xx double")

        def merged(self):
            return [F.sum(c).alias(c) for c in ("n", "x", "y", "xy", "xx")]

        def fit(self, sums, keys):
            slope = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
            return sums.withColumn("slope", slope).select(*keys, "segment", "slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("n")).alias("level"))

        def transform(self, rows, params, p, keys):
            return rows.join(params, [*keys, "segment"], "left").withColumn("forecast", F.col("level") + F.col("slope") * F.ln("amount"))

    f = folds(df)
    got = {r["event_key"]: r["forecast"] for r in wf.walk_forward(df, f, P, Trend()).collect()}
    train, test, _ = fold_of(pdf, 2018)
    train = train.dropna(subset=["primary_share"])
    for s in "abc":
        own = train[train["segment"] == s]
        slope, level = np.polyfit(np.log(own["amount"]), own["primary_share"], 1)
        for r in test[test["segment"] == s].itertuples():
            assert got[r.event_key] == pytest.approx(level + slope * np.log(r.amount), abs=1e-9)
    inside = wf.walk_forward_inside(df, f, P, Trend()).where("test_year = 2018 AND inner_year = 2016").toPandas()
    year = train.loc[train["event_year"] == 2016, "announcement_cutoff"].min()
    base = train[(train["event_year"] < 2016) & (train["result_safe_date"] <= year)]
    assert len(inside) > 0
    for s in "abc":
        own = base[base["segment"] == s]
        slope, level = np.polyfit(np.log(own["amount"]), own["primary_share"], 1)
        part = inside[inside["segment"] == s]
        np.testing.assert_allclose(part["forecast"], level + slope * np.log(part["amount"]), atol=1e-9)


def _linear_rows(spark, n=400):
    rng = np.random.default_rng(21)
    pdf = pd.DataFrame({"event_key": np.arange(n), "fold": rng.choice([1, 2, -2], n).astype("int32"), "s": rng.choice(["a", "b", "zz"], n), "x": rng.normal(size=n), "v": rng.random(n)})
    pdf["y"] = pdf["x"] + (pdf["s"] == "a") + rng.normal(0, 0.1, n)
    pdf["z"] = 2 * pdf["v"] - pdf["x"] + rng.normal(0, 0.1, n)
    pdf.loc[rng.random(n) < 0.1, "x"] = np.nan
    pdf.loc[rng.random(n) < 0.1, ["y", "z"]] = np.nan
    df = spark.createDataFrame(pdf)
    return pdf, df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y", "z")}), li.Design(("x", "v"), "s", ("a", "b"))


def test_targets_of_one_pass_have_the_fits_they_have_alone(spark):
    _, df, design = _linear_rows(spark)
    grid = [(1.0, None), (0.01, 0.5)]
    both = {(r["target"], r["fold"], r["candidate"]): r for r in li.fit_linear(df, "fold", ["y", "z"], design, grid).collect()}
    assert len(both) == 12
    for t in ("y", "z"):
        for r in li.fit_linear(df, "fold", t, design, grid).collect():
            np.testing.assert_allclose(both[(t, r["fold"], r["candidate"])]["coefficients"], r["coefficients"], atol=1e-10)
            assert both[(t, r["fold"], r["candidate"])]["n_train"] == r["n_train"]


def test_candidates_and_forecasts_by_matrix_product(spark):
    """The least error wins, the first candidate of equal ones; rows of folds without a fit have no forecast; a NULL predictor counts as 0."""
    pdf, df, design = _linear_rows(spark)
    w = {(1, 3): [0.0, 1, 0, 0, 0, 0, 0], (1, 4): [0.1, 1, 0, 0.5, 0, 1, 0], (1, 7): [0.1, 1, 0, 0.5, 0, 1, 0], (2, 0): [9.0, 0, 0, 0, 0, 0, 0], (2, 5): [0.3, 0, 0, 0, 0, 0, 0]}
    fits = spark.createDataFrame([(f, c, [float(x) for x in v]) for (f, c), v in w.items()], "fold int, candidate int, coefficients array<double>")
    assert {r["fold"]: r["candidate"] for r in li.choose_candidate(df, fits, "fold", "y", design).collect()} == {1: 4, 2: 5}
    one = fits.where("candidate IN (4, 5)")
    got = {r["event_key"]: r["out"] for r in li.linear_forecasts(df, one, "fold", design, "out").collect()}
    for r in pdf.itertuples():
        if r.fold == -2:
            assert r.event_key not in got
            continue
        gone = np.isnan(r.x)
        raw = [1, 0 if gone else r.x, r.v, gone, 0, r.s == "a", r.s == "b"]
        assert got[r.event_key] == pytest.approx(np.dot(raw, w[(1, 4) if r.fold == 1 else (2, 5)]), abs=1e-12)


def test_targets_that_miss_other_rows_are_not_fitted_together(spark):
    from asofkit.plans import evaluation_catalog as ev

    _, df, _ = _linear_rows(spark)
    df = df.withColumns({"w": F.when(F.col("event_key") > 3, F.col("y")), "u": F.col("w") * 2})
    assert ev.known_together(df, ["y", "w", "z", "u"]) == [["y", "z"], ["w", "u"]]
