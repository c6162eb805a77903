"""Staged publication, snapshots of raw payloads, and nested JSON output."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.digest import finish_digest, limb_sums, row_hash


class GateFailure(RuntimeError):
    """A gate found a problem; nothing was published."""


def publish(
    df: DataFrame, root: str, *, gates: Sequence[Callable[[DataFrame], str | None]] = (), partition_by: Sequence[str] = (),
) -> str:
    """Write a new version under `root`, run the gates on what was written, then point to it.

    Readers follow the newest row of `root/_current`. A failed gate leaves the old version
    current, and a lost executor only repeats tasks of the version being written. Pointer
    files hold one row and are added, never rewritten.
    """
    spark = df.sparkSession
    version = f"{root}/versions/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(version)
    written = spark.read.parquet(version)
    for gate in gates:
        problem = gate(written)
        if problem:
            raise GateFailure(problem)
    pointer = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/_current")
    return version


def read_current(spark: SparkSession, root: str) -> DataFrame:
    pointer = spark.read.parquet(f"{root}/_current").orderBy(F.col("published_at").desc()).first()
    return spark.read.parquet(pointer["version"])


def with_checksum(records: DataFrame, *, key: Sequence[str], retrieval_date: str) -> DataFrame:
    """Bronze rows: payload columns, retrieval date and a row checksum."""
    body = [c for c in records.columns if c != retrieval_date]
    return records.withColumn("row_sha256", row_hash(body))


def snapshot_conflicts(stored: DataFrame, incoming: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Keys already stored with other content: a stored snapshot must never change."""
    a = stored.select(*key, F.col("row_sha256").alias("stored_sha256"))
    b = incoming.select(*key, F.col("row_sha256").alias("incoming_sha256"))
    return a.join(b, list(key)).where(F.col("stored_sha256") != F.col("incoming_sha256"))


def compare_snapshots(older: DataFrame, newer: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """(key, status): only_older, only_newer or changed; equal rows are left out."""
    shared = [c for c in older.columns if c in newer.columns and c not in key]
    a = older.select(*key, F.struct(*shared).alias("__a"))
    b = newer.select(*key, F.struct(*shared).alias("__b"))
    both = a.join(b, list(key), "full_outer")
    status = (
        F.when(F.col("__b").isNull(), "only_older").when(F.col("__a").isNull(), "only_newer")
        .when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    )
    return both.select(*key, status.alias("status")).where(F.col("status").isNotNull())


def snapshot_history(snapshots: DataFrame, *, key: Sequence[str], date: str) -> DataFrame:
    """Changes between every pair of consecutive snapshots: (older, newer, status, n).

    Consecutive pairs come from the list of snapshot dates; rows meet by key inside each pair.
    """
    from pyspark.sql import Window

    body = [c for c in snapshots.columns if c not in {*key, date}]
    dates = snapshots.select(date).distinct()
    pairs = dates.withColumn("newer", F.lead(date).over(Window.orderBy(date))).withColumnRenamed(date, "older")
    pairs = F.broadcast(pairs.where(F.col("newer").isNotNull()))
    row = snapshots.select(*key, F.col(date).alias("__d"), F.struct(*body).alias("__row"))
    old = row.join(pairs, F.col("__d") == F.col("older")).select(*key, "older", "newer", F.col("__row").alias("__a"))
    new = row.join(pairs, F.col("__d") == F.col("newer")).select(*key, "older", "newer", F.col("__row").alias("__b"))
    both = old.join(new, [*key, "older", "newer"], "full_outer")
    status = (
        F.when(F.col("__b").isNull(), "only_older").when(F.col("__a").isNull(), "only_newer")
        .when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    )
    return both.groupBy("older", "newer", status.alias("status")).agg(F.count("*").alias("n"))


def nested_records(table: DataFrame, *, by: Sequence[str], records: Sequence[str], order: Sequence[str], out: str = "records") -> DataFrame:
    """One JSON document per group with its records in order. Meant for metric tables, whose
    groups hold years, segments or models, never raw rows."""
    item = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in records]).alias("__r"))
    grouped = table.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["__r"]).alias(out))
    return grouped.select(*by, F.to_json(F.struct(out)).alias("document"))


def content_digest(df: DataFrame) -> DataFrame:
    """Digest of columns, types and rows. The row order of a table is that of its unique key,
    which every row hash covers, so no sort is needed."""
    header = "|".join(f"{n}:{t}" for n, t in df.dtypes)
    hashed = df.select(row_hash(df.columns).alias("h"))
    return hashed.agg(*limb_sums(F.col("h"))).select(
        F.col("limb0").alias("n_rows"), F.sha2(F.concat(F.lit(header + "|"), finish_digest()), 256).alias("digest")
    )
