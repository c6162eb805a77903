"""Hash trees over key ranges."""

import hashlib

from pyspark.sql import functions as F

from asofkit.operators import merkle as mk
from asofkit.session import materialise


def plain_root(rows, columns):
    """The same tree by hand for one group of (key, values..) rows."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    text = lambda r: sha("|".join("-" if v is None else f"={v}" for v in r))
    leaves, counts = {}, {}
    for r in rows:
        counts[(r[0], text(r))] = counts.get((r[0], text(r)), 0) + 1
    for (k, d), n in sorted(counts.items()):
        leaves.setdefault(k // mk.FANOUT, []).append(f"{k}:{d}:{n}")
    level = {k: sha(",".join(v)) for k, v in leaves.items()}
    for k in range(2, mk.LEVELS + 2):
        up = {}
        for node in sorted(level):
            up.setdefault(node // mk.FANOUT if k <= mk.LEVELS else 0, []).append(f"{node}:{level[node]}")
        level = {k2: sha(",".join(v)) for k2, v in up.items()}
    return level[0]


def root(df, columns=("k", "v")):
    return mk.roots(mk.hash_tree(df, "k", columns)).first()["digest"]


def test_root_by_hand_and_every_kind_of_change(spark):
    rows = [(k, None if k % 7 == 0 else f"v{k}") for k in range(0, 900, 3)] + [(30, "v30")]
    df = spark.createDataFrame(rows, "k long, v string")
    base = root(df)
    assert base == plain_root(rows, ("k", "v"))
    assert root(df.repartition(9).orderBy(F.rand(3))) == base
    swapped = [(k, {33: "v36", 36: "v33"}.get(k, v)) for k, v in rows]
    edited = [(k, "w" if k == 300 else v) for k, v in rows]
    for other in (swapped, edited, rows[1:], rows + [rows[5]], [(k, v or "") for k, v in rows]):
        changed = root(spark.createDataFrame(other, "k long, v string"))
        assert changed == plain_root(other, ("k", "v")) and changed != base
    assert mk.hash_tree(df.where("false"), "k", ["k", "v"]).count() == 0


def test_one_changed_row_among_a_million_is_found_by_few_nodes(spark):
    a = spark.range(1_000_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 654_321, 0).otherwise(F.col("v")))
    trees = [materialise(mk.hash_tree(x, "k", ["k", "v"])) for x in (a, b)]
    found = mk.unequal_leaves(*trees)
    assert [r["node"] for r in found.leaves.collect()] == [654_321 // mk.FANOUT]
    assert found.compared <= mk.FANOUT * (mk.LEVELS + 1)
    same = mk.unequal_leaves(trees[0], trees[0])
    assert same.leaves.count() == 0 and same.compared == 1


def test_groups_have_their_own_roots(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "y")], "g string, k long, v string")
    got = {r["g"]: (r["digest"], r["n"]) for r in mk.roots(mk.hash_tree(df, "k", ["k", "v"], by=["g"])).collect()}
    assert got["a"] == got["b"] != got["c"] and got["a"][1] == 2
