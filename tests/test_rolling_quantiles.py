import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofkit.operators import quantiles as qt, rolling as ro


def _pool(seed=0, n=400):
    rng = np.random.default_rng(seed)
    day = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 120, n)), "D")
    pdf = pd.DataFrame({
        "k": rng.permutation(n), "g": np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n)), "day": day,
        "v": rng.random(n)})
    pdf.loc[rng.integers(0, n, 25), "v"] = np.nan
    pdf["safe"] = pdf["day"] + pd.to_timedelta(2, "D")
    pdf["cut"] = pdf["day"] - pd.to_timedelta(rng.integers(0, 4, n), "D")
    return pdf


def _spark(spark, pdf):
    out = pdf.assign(**{c: pdf[c].dt.date for c in ("day", "safe", "cut")})
    df = spark.createDataFrame(out)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_safe_trailing_mean_against_brute_force(spark):
    pdf = _pool()
    got = ro.safe_trailing_mean(_spark(spark, pdf), by=["g"], value="v", key="k", cutoff="cut", safe="safe", on="day", n=8,
                                out="m", count_out="c").toPandas().set_index("k")
    for r in pdf.itertuples():
        c = pdf[(pdf["g"] == r.g) & pdf["v"].notna() & (pdf["safe"] <= r.cut)].sort_values(["safe", "day", "k"]).tail(8)
        c = c[c["k"] != r.k]
        assert got.loc[r.k, "c"] == len(c)
        assert (len(c) == 0 and pd.isna(got.loc[r.k, "m"])) or got.loc[r.k, "m"] == pytest.approx(c["v"].mean())


def test_self_is_removed_after_the_window_is_taken(spark):
    days = [dt.date(2024, 1, i) for i in range(1, 11)]
    rows = [(i, "g", days[i], days[i], dt.date(2024, 2, 1), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, g string, day date, safe date, cut date, v double")
    got = {r["k"]: (r["m"], r["c"]) for r in ro.safe_trailing_mean(
        df, by=["g"], value="v", key="k", cutoff="cut", safe="safe", on="day", n=3, out="m", count_out="c").collect()}
    assert got[9] == (7.5, 2) and got[0] == (8.0, 3)
    with pytest.raises(ValueError):
        ro.safe_trailing_mean(df.withColumn("m", F.lit(1)), by=["g"], value="v", key="k", cutoff="cut", safe="safe", on="day", out="m")


@pytest.mark.parametrize("fine", [False, True])
def test_order_trailing_mean_and_history_across_chunks(spark, fine):
    pdf = _pool(3)
    df = _spark(spark, pdf)
    chunk = F.struct("day", F.floor(F.col("k") / 40)) if fine else None
    want = pdf.sort_values(["day", "k"]).groupby("g")["v"].transform(lambda s: s.shift(1).rolling(5, min_periods=1).mean())
    want.index = pdf.sort_values(["day", "k"])["k"]
    got = ro.order_trailing_mean(df, by=["g"], order=["day", "k"], value="v", out="m", window=5, chunk=chunk).toPandas().set_index("k")["m"]
    np.testing.assert_allclose(got.sort_index().astype(float), want.sort_index(), rtol=1e-12)
    hist = ro.preceding_rows(df, by=["g"], order=["day", "k"], take=["k"], n=3, chunk=chunk, out="h").toPandas().set_index("k")["h"]
    for g, part in pdf.sort_values(["day", "k"]).groupby("g"):
        keys = list(part["k"])
        for i, k in enumerate(keys):
            assert [x["k"] for x in hist[k]] == keys[max(0, i - 3):i]


def test_same_day_rows_never_see_each_other(spark):
    day = [dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 3)]
    df = spark.createDataFrame([(1, "g", day[0], 10.0, True), (2, "g", day[1], 5.0, True), (3, "g", day[2], 1.0, False)],
                               "k long, g string, day date, amount double, flag boolean")
    out = ro.slot_features(df, by=["g"], on="day", value="amount", sums={2: "s"}, flag="flag", count_out="n", tie=["k"],
                           previous={"amount": "prev"}).orderBy("k").collect()
    assert [(r["s"], r["n"], r["prev"]) for r in out] == [(None, 0, None), (None, 0, None), (15.0, 2, 5.0)]


def test_series_windows_equal_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"s": "x", "t": np.arange(80), "v": rng.normal(size=80)})
    df = spark.createDataFrame(pdf)
    z = ro.past_zscore(df, by=["s"], on="t", value="v", out="z", window=20, min_periods=5).orderBy("t").toPandas()["z"]
    prior = pdf["v"].shift(1).rolling(20, min_periods=5)
    np.testing.assert_allclose(z.astype(float), (pdf["v"] - prior.mean()) / prior.std(), rtol=1e-9)
    vol = ro.realised_volatility(df, by=["s"], on="t", value="v", windows={5: "w"}).orderBy("t").toPandas()["w"]
    np.testing.assert_allclose(vol.astype(float), (pdf["v"].diff() * 100).shift(1).rolling(5, min_periods=5).std(), rtol=1e-9)


def test_violations_and_gaps(spark):
    rows = [(i, "g", dt.date(2024, 1, 1) + dt.timedelta(days=i), dt.date(2024, 1, 3) + dt.timedelta(days=i)) for i in range(4)]
    df = spark.createDataFrame(rows, "k long, g string, day date, safe date")
    got = ro.availability_violations(df, by=["g"], order=["day", "k"], safe="safe", cutoffs={"at": "day"}, key="k", window=2).collect()
    assert sorted((r["k"], r["lag"], r["gap_days"]) for r in got) == [(1, 1, -1), (2, 1, -1), (3, 1, -1)]
    far = spark.createDataFrame([("g", dt.date(2024, 1, 1)), ("g", dt.date(2024, 9, 1)), ("h", dt.date(2024, 1, 1))], "g string, day date")
    gap = ro.largest_gap(far, by=["g"], on="day", threshold=150).collect()
    assert [(r["g"], r["max_gap_days"]) for r in gap] == [("g", 244)]


@pytest.mark.parametrize("octave", [1, 32, 1024])
def test_exact_quantiles_against_numpy(spark, octave):
    rng = np.random.default_rng(7)
    parts = {"normal": rng.normal(size=501), "ties": np.repeat([1.0, 2.0, 3.0], 60), "one": np.array([4.2]), "flat": np.full(9, 5.0),
             "narrow": 1e6 + rng.random(300), "tiny": np.concatenate([np.zeros(40), rng.normal(size=41) * 1e-300])}
    pdf = pd.DataFrame([(g, x) for g, xs in parts.items() for x in xs], columns=["g", "x"])
    pdf.loc[len(pdf)] = ["normal", np.nan]
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = qt.exact_quantiles(spark.createDataFrame(pdf), by=["g"], value="x", probs=probs, per_octave=octave).toPandas().set_index("g")["quantiles"]
    for g, xs in parts.items():
        np.testing.assert_allclose(got[g], np.quantile(xs, probs), rtol=1e-12)
    everything = qt.exact_quantiles(spark.createDataFrame(pdf), by=[], value="x", probs=[0.5]).first()["quantiles"][0]
    assert everything == pytest.approx(np.nanquantile(pdf["x"], 0.5))


def test_weighted_quantiles_equal_repeated_values(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": "a", "x": rng.random(50), "w": rng.integers(1, 6, 50)})
    got = qt.weighted_quantiles(spark.createDataFrame(pdf), by=["g"], value="x", weight="w", probs=[0.1, 0.5, 0.9],
                                chunk=F.floor(F.col("x") * 7)).first()["quantiles"]
    np.testing.assert_allclose(got, np.quantile(np.repeat(pdf["x"], pdf["w"]), [0.1, 0.5, 0.9]))


def test_series_in_chunks_equal_the_window_over_the_whole_series(spark):
    """Lags, scores and volatility over chunk borders, with chunks shorter than the window and missing values."""
    from pyspark.sql import Window
    r = random.Random(4)
    rows = [(s, t, None if r.random() < 0.1 else r.gauss(0, 1)) for s in ("a", "b", None) for t in sorted(r.sample(range(-3000, 3000), 400))]
    df = spark.createDataFrame(rows, "s string, t int, v double").repartition(4)
    w = Window.partitionBy("s").orderBy("t")
    step = (F.col("v") - F.lag("v", 1).over(w)) * 100
    frame, back = w.rowsBetween(-20, -1), w.rowsBetween(-7, -1)
    want = df.withColumn("st", step).select(
        "s", "t", (F.col("v") - F.lag("v", 1).over(w)).alias("c1"), (F.col("v") - F.lag("v", 9).over(w)).alias("c9"),
        F.when(F.count("v").over(frame) >= 5, F.try_divide(F.col("v") - F.avg("v").over(frame), F.stddev_samp("v").over(frame))).alias("z"),
        F.when(F.count("st").over(back) >= 7, F.stddev_samp("st").over(back)).alias("vol"))
    want = {(x["s"], x["t"]): x for x in want.collect()}
    for size in (10, 150, 100_000):
        chunk = F.floor(F.col("t") / size)
        out = ro.lag_changes(df, by=["s"], on="t", value="v", lags={1: "c1", 9: "c9"}, chunk=chunk)
        out = ro.past_zscore(out, by=["s"], on="t", value="v", out="z", window=20, min_periods=5, chunk=chunk)
        out = ro.realised_volatility(out, by=["s"], on="t", value="v", windows={7: "vol"}, chunk=chunk)
        assert out.columns == ["s", "t", "v", "c1", "c9", "z", "vol"]
        got = out.collect()
        assert len(got) == len(rows)
        for x in got:
            for c in ("c1", "c9", "z", "vol"):
                a, b = x[c], want[(x["s"], x["t"])][c]
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_one_long_series_is_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("s").alias("s"), F.col("id").alias("t"), (F.col("id") % 97).cast("double").alias("v"))
    out = ro.lag_changes(df, by=["s"], on="t", value="v", lags={5: "c"})
    assert out.where("t >= 5 AND c IS NULL").count() == 0 and out.where("t < 5 AND c IS NOT NULL").count() == 0
    keys = [line for line in out._jdf.queryExecution().toString().splitlines() if "hashpartitioning(s" in line]
    assert any("__chunk" in line for line in keys)


def test_many_probabilities_equal_numpy_at_any_chunk_size(spark):
    """Ranks of many probabilities come from a table of ranks; values that repeat, one row, and a NULL group included."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 900), "x": np.round(rng.normal(size=900) ** 3, 2)})
    pdf = pd.concat([pdf, pd.DataFrame({"g": [7, 8, 8, 8], "x": [1.5, 0.0, 0.0, -2.0]})])
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") != 2, F.col("g")))
    probs = [k / 64 for k in range(65)]
    for size in (32, 4096):
        got = {r["g"]: r["quantiles"] for r in qt.exact_quantiles(df, by=["g"], value="x", probs=probs, per_octave=size).collect()}
        assert set(got) == {0, 1, 7, 8, None}
        for g, q in got.items():
            np.testing.assert_allclose(q, np.quantile(pdf.loc[pdf["g"] == (2 if g is None else g), "x"], probs), atol=1e-12)
