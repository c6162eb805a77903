"""Connected components of a link table by alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import in_few_files


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (columns a, b): component is the smallest id that links reach.

    Large star hangs every larger neighbour of a node on the node's least neighbour, small star hangs the node and its
    smaller neighbours there; when nothing changes, each edge leads to its component. Rounds grow as the logarithm of the
    longest chain. The least neighbours are read back from storage, so AQE can split a hub in the join. No links: no rows.
    """
    size = links.count()
    edges = in_few_files(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), size)
    seen = _mark(edges)
    while seen[0]:
        both = edges.union(edges.select("v", "u"))
        least = in_few_files(both.groupBy(F.col("u").alias("w")).agg(F.least("w", F.min("v")).alias("m")), size)
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = in_few_files(large.where("u <> v").distinct(), size)
        least = in_few_files(edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), size)
        small = edges.join(least, F.col("u") == F.col("w"))
        edges = in_few_files(small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").where("u <> v").distinct(), size)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
