"""Order-sensitive digests of keyed tables: a hash tree over ranges of the key, and a comparison that walks unequal branches only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise

FANOUT = 64
LEVELS = 6  # leaves hold FANOUT keys; LEVELS - 1 levels of parents above them reach 2^36 keys, the root takes what is left


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the named columns as text; NULL differs from every text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)


def hash_tree(df: DataFrame, key: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, level, node, digest, n): level 1 are the leaves, level LEVELS + 1 is the root of each `by` group.

    A leaf is the digest of its rows in key order, a parent that of its children in order; `n` counts rows. Keys are whole numbers from 0
    on. Equal rows of one key are counted, so a hot key does not grow a leaf. Neither the order nor the partitions of `df` matter; an
    edited, added, dropped, repeated or exchanged row changes its leaf and everything above it. An empty table has no nodes.
    """
    rows = df.select(*by, F.col(key).cast("long").alias("__k"), row_digest(columns).alias("__d")).groupBy(*by, "__k", "__d").agg(F.count("*").alias("__n"))
    item = F.struct("__k", F.concat_ws(":", F.col("__k"), "__d", F.col("__n")).alias("t"), "__n")
    leaf = rows.groupBy(*by, F.floor(F.col("__k") / FANOUT).cast("long").alias("node")).agg(F.array_sort(F.collect_list(item)).alias("__i"), F.sum("__n").alias("n"))
    level = materialise(leaf.select(*by, F.lit(1).alias("level"), "node", F.sha2(F.array_join("__i.t", ","), 256).alias("digest"), "n"))
    out = level
    for k in range(2, LEVELS + 2):
        up = F.floor(F.col("node") / FANOUT) if k <= LEVELS else F.lit(0)
        child = F.struct("node", F.concat_ws(":", F.col("node"), "digest").alias("t"))
        level = level.groupBy(*by, up.cast("long").alias("node")).agg(F.array_sort(F.collect_list(child)).alias("__i"), F.sum("n").alias("n"))
        level = level.select(*by, F.lit(k).alias("level"), "node", F.sha2(F.array_join("__i.t", ","), 256).alias("digest"), "n")
        out = out.unionByName(level)
    return out


def roots(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("level") == LEVELS + 1).drop("level", "node")


@dataclass(frozen=True)
class Difference:
    leaves: DataFrame  # node: key ranges [node * FANOUT, (node + 1) * FANOUT) that differ
    compared: int      # nodes looked at on both sides


def unequal_leaves(a: DataFrame, b: DataFrame) -> Difference:
    """The leaves in which two trees (written tables without `by`) differ. Children are compared only below unequal nodes."""
    suspects, compared = a.sparkSession.createDataFrame([(0,)], "node long"), 0
    for k in range(LEVELS + 1, 0, -1):
        below = F.lit(0).cast("long") if k >= LEVELS else F.floor(F.col("node") / FANOUT).cast("long")
        side = lambda t, name: t.where(F.col("level") == k).withColumn("__up", below).join(
            suspects.withColumnRenamed("node", "__up"), "__up", "left_semi").select("node", F.col("digest").alias(name))
        both = materialise(side(a, "one").join(side(b, "two"), "node", "full"))
        compared += both.count()
        suspects = both.where(~F.col("one").eqNullSafe(F.col("two"))).select("node")
    return Difference(suspects, compared)
