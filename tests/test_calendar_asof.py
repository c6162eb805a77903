import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from asofkit.functions import dates
from asofkit.operators import asof, calendar as cal, features as fe


def d(text):
    return dt.date.fromisoformat(text)


def test_calendar_equals_pandas_rules(spark):
    got = cal.business_calendar(spark, "1985-01-01", "2040-12-31").toPandas()
    days = pd.to_datetime(got["day"])
    holidays = set(USFederalHolidayCalendar().holidays("1984-12-01", "2041-02-01"))
    want = days.isin(holidays)
    inside = (days >= "1986-01-01") & (days <= "2040-11-30")
    # a holiday that falls on a weekend day itself is observed on a weekday
    assert (got["is_holiday"][inside] == want[inside]).all()
    business = [x for x, h in zip(days, want, strict=True) if x.weekday() < 5 and not h]
    for i in range(400, 2000, 37):
        nxt = next(b for b in business if b > days[i])
        assert pd.Timestamp(got["next_business_day"][i]) == nxt
        prev = [b for b in business if b < days[i]][-1]
        assert pd.Timestamp(got["previous_business_day"][i]) == prev


def test_extra_closures_move_neighbours(spark):
    closed = spark.createDataFrame([(d("2024-03-06"),)], "day date")
    c = cal.business_calendar(spark, "2024-03-01", "2024-03-31", closed)
    row = c.where("day = '2024-03-05'").first()
    assert row["next_business_day"] == d("2024-03-07")


def test_weekday_count_matches_numpy(spark):
    rng = np.random.default_rng(3)
    starts = pd.to_datetime("1960-01-01") + pd.to_timedelta(rng.integers(0, 25000, 300), "D")
    ends = starts + pd.to_timedelta(rng.integers(-40, 400, 300), "D")
    pdf = pd.DataFrame({"s": starts.date, "e": ends.date})
    got = spark.createDataFrame(pdf).select("s", "e", dates.weekday_count("s", "e").alias("n")).toPandas()
    want = np.busday_count(got["s"].to_numpy().astype("datetime64[D]"), got["e"].to_numpy().astype("datetime64[D]"))
    assert (got["n"].to_numpy() == want).all()


def test_release_rules_in_priority_order(spark):
    c = cal.business_calendar(spark, "2023-01-01", "2024-12-31")
    obs = spark.createDataFrame([(d(x),) for x in ("2023-07-01", "2023-08-01", "2023-08-08", "2024-06-30")], "observed date")
    over = spark.createDataFrame([(d("2023-08-01"), d("2023-09-01"), "exact", "notice")],
                                 "observed date, actual_published date, precision string, source string")
    win = spark.createDataFrame([("gap", d("2023-07-25"), d("2023-08-20"))], "window_name string, window_start date, window_end date")
    got = {r["observed"]: r for r in cal.with_overridden_release_dates(obs, c, "observed", overrides=over, windows=win).collect()}
    assert got[d("2023-07-01")]["nominal_published_date"] == d("2023-07-05")  # July 4 shifts
    assert got[d("2023-07-01")]["safe_date"] == d("2023-07-06")
    assert got[d("2023-08-01")]["safe_date"] == d("2023-09-05")  # after Labor Day
    assert got[d("2023-08-08")]["nominal_published_date"] is None
    assert got[d("2023-08-08")]["safe_date"] == d("2023-10-10")  # 60 days later is followed by Columbus Day
    assert got[d("2023-08-08")]["availability_precision"] == "window_fallback"
    assert got[d("2024-06-30")]["release_rule"] == "standard"


def _frames(seed, n_left=300, n_right=60, strict=False):
    rng = np.random.default_rng(seed)
    base = pd.Timestamp("2020-01-01")
    right = pd.DataFrame({
        "safe": base + pd.to_timedelta(rng.integers(0, 120, n_right), "D"), "obs": base + pd.to_timedelta(rng.permutation(n_right) - 30, "D"),
        "x": rng.normal(size=n_right)})
    left = pd.DataFrame({"k": np.arange(n_left), "cut": base + pd.to_timedelta(rng.integers(-10, 140, n_left), "D")})
    left.loc[rng.integers(0, n_left, 10), "cut"] = pd.NaT
    return left, right


@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_merge_asof(spark, strict):
    left, right = _frames(5)
    want = pd.merge_asof(left.dropna().sort_values("cut"), right.sort_values(["safe", "obs"]), left_on="cut", right_on="safe",
                         allow_exact_matches=not strict).set_index("k")["obs"]
    ls = spark.createDataFrame(left.assign(cut=left["cut"].dt.date.where(left["cut"].notna(), None)), "k long, cut date")
    rs = spark.createDataFrame(right.assign(safe=right["safe"].dt.date, obs=right["obs"].dt.date), "safe date, obs date, x double")
    rs = rs.unionByName(spark.createDataFrame([(None, d("2030-01-01"), 1.0)], rs.schema))
    got = asof.asof_join(ls, rs, cutoff="cut", safe="safe", tie=["obs"], strict=strict).toPandas().set_index("k")
    assert len(got) == len(left)
    for k in left["k"]:
        w = want.get(k, pd.NaT)
        assert (pd.isna(w) and not got.loc[k, "asof_matched"]) or pd.Timestamp(got.loc[k, "obs"]) == w


def test_asof_equality_counts_and_naive_join_leaks(spark):
    ev = spark.createDataFrame([(1, d("2024-01-05")), (2, d("2024-01-04"))], "k long, cut date")
    rel = spark.createDataFrame([(d("2024-01-03"), d("2024-01-04"), d("2024-01-05"))], "obs date, pub date, safe date")
    got = {r["k"]: r["asof_matched"] for r in asof.asof_join(ev, rel, cutoff="cut", safe="safe", tie=["obs"]).collect()}
    assert got == {1: True, 2: False}
    leaks = fe.naive_versus_safe(ev, rel, cutoff="cut", safe="safe", naive="pub", observed="obs").collect()
    assert [r["k"] for r in leaks] == [2]


def test_asof_by_key_keeps_null_keys_apart(spark):
    ev = spark.createDataFrame([(1, "a", d("2024-01-05")), (2, None, d("2024-01-05"))], "k long, g string, cut date")
    rel = spark.createDataFrame([("a", d("2024-01-01"), 1.0), ("b", d("2024-01-02"), 2.0)], "g string, safe date, v double")
    got = {r["k"]: r["v"] for r in asof.asof_join(ev, rel, cutoff="cut", safe="safe", tie=["safe"], by=["g"]).collect()}
    assert got == {1: 1.0, 2: None}
    with pytest.raises(ValueError):
        asof.asof_join(ev.withColumn("v", F.lit(1)), rel, cutoff="cut", safe="safe", tie=["safe"], by=["g"])


@pytest.mark.parametrize("strict", [False, True])
def test_timestamp_asof_with_a_hot_key(spark, strict):
    rng = np.random.default_rng(9)
    base = pd.Timestamp("2024-01-01")
    n = 600
    users = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 20, n))  # one key holds 40%
    t = base + pd.to_timedelta(rng.integers(0, 5 * 24 * 3600, n), "s")
    left = pd.DataFrame({"k": np.arange(n), "u": users, "ts": t})
    right = pd.DataFrame({"u": rng.permutation(users), "known": base + pd.to_timedelta(rng.integers(0, 5 * 24 * 3600, n), "s"), "rid": np.arange(n)})
    right.loc[:50, "known"] = left.loc[:50, "ts"]  # exact matches
    right.loc[:50, "u"] = left.loc[:50, "u"]
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values(["known", "rid"]), left_on="ts", right_on="known", by="u",
                         allow_exact_matches=not strict).set_index("k")["rid"]
    got = asof.asof_join_timestamps(spark.createDataFrame(left), spark.createDataFrame(right), at="ts", safe="known", by=["u"],
                                    tie=["rid"], bucket="day", strict=strict).toPandas().set_index("k")["rid"]
    assert len(got) == n
    pd.testing.assert_series_equal(got.sort_index().astype("float64"), want.sort_index().astype("float64"), check_names=False)


def test_vintage_without_value_hides_older_ones(spark):
    ev = spark.createDataFrame([(1, d("2024-03-01"))], "k long, cut date")
    index = spark.createDataFrame([("v1", d("2024-01-01")), ("v2", d("2024-02-01"))], "vintage string, safe date")
    rows = [("v1", d("2023-11-01"), 1.0), ("v1", d("2023-12-01"), 2.0), ("v2", d("2023-12-01"), None)]
    vint = spark.createDataFrame(rows, "vintage string, obs date, v double")
    snap = asof.vintage_snapshot(vint, by=["vintage"], observed="obs", value="v", yoy_lag=1)
    assert {r["vintage"]: (r["current_value"], r["yoy_value"]) for r in snap.collect()} == {"v1": (2.0, 1.0)}
    row = asof.vintage_asof_join(ev, index, snap, cutoff="cut", vintage=["vintage"], safe="safe", tie=["safe"]).first()
    assert row["vintage"] == "v2" and row["current_value"] is None and row["missing_reason"] == "vintage_without_observation"
