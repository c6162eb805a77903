"""Joins of points with intervals against trying every pair."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from asofkit.operators.intervals import join_intervals


def brute(points, spans):
    return Counter((p, i) for p, g, x in points for i, h, a, b in spans
                   if g == h and g is not None and x is not None and (a is None or a <= x) and (b is None or x <= b))


@pytest.mark.parametrize("salts", [1, 4])
def test_every_kind_of_interval(spark, salts):
    r = random.Random(6)
    points = [(k, r.choice("uv"), r.randint(-60, 60)) for k in range(300)] + [(900, "u", None), (901, None, 3), (902, "v", 10**9), (902, "v", 10**9)]
    spans = [(k, r.choice("uv"), *sorted((r.randint(-70, 70), r.randint(-70, 70)))) for k in range(150)]
    spans += [(500, "u", 5, 5), (501, "u", 9, 3), (502, "v", None, 4), (503, "u", 7, None), (504, "v", None, None), (505, None, 0, 9), (500, "u", 5, 5), (506, "v", 0, 2**40)]
    p = spark.createDataFrame(points, "p long, g string, x long").repartition(3)
    s = spark.createDataFrame(spans, "i long, g string, a long, b long").repartition(2)
    out = join_intervals(p, s, at="x", low="a", high="b", by=["g"], salts=salts)
    assert out.columns == ["g", "p", "x", "i", "a", "b"]
    assert Counter((r["p"], r["i"]) for r in out.collect()) == brute(points, spans)
    assert join_intervals(p, s.where("false"), at="x", low="a", high="b", by=["g"], salts=salts).count() == 0
    assert join_intervals(p.where("false"), s, at="x", low="a", high="b", by=["g"], salts=salts).count() == 0


def test_a_million_intervals_without_a_nested_loop(spark):
    n = 1_000_000
    spans = spark.range(n).select(F.col("id").alias("i"), (F.col("id") * 7).alias("a"), (F.col("id") * 7 + F.col("id") % 23).alias("b"))
    points = spark.range(2000).select(F.col("id").alias("p"), F.pmod(F.xxhash64("id"), F.lit(7 * n)).alias("x"))
    out = join_intervals(points, spans, at="x", low="a", high="b")
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = Counter((r["p"], r["i"]) for r in out.select("p", "i").collect())
    want = Counter()
    for row in points.collect():
        for i in range(max(0, (row["x"] - 22 + 6) // 7 - 1), min(n - 1, row["x"] // 7) + 1):
            if i * 7 <= row["x"] <= i * 7 + i % 23:
                want[(row["p"], i)] += 1
    assert got == want and sum(want.values()) > 2000


def test_bins_of_a_small_file_are_not_sent_to_every_task(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("i"), F.col("id").alias("a"), (F.col("id") + 60).alias("b")).write.parquet(str(tmp_path / "t"))
    spans = spark.read.parquet(str(tmp_path / "t"))
    plan = join_intervals(spans.select(F.col("i").alias("p"), F.col("a").alias("x")), spans, at="x", low="a", high="b")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "aggregate(" not in plan
