"""The snapshot store: versions, conflicts, refusal of changed content, and removal of leftovers."""

import pytest
from pyspark.sql import functions as F

from asofkit.sources.store import SnapshotConflict, SnapshotStore


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store")


def rows(spark, n, v="x"):
    return spark.range(n).select("id", F.lit(v).alias("v"))


def test_equal_days_are_accepted_and_changed_ones_refused(spark, store):
    assert store.versions() == [] and store.manifest().count() == 0
    with pytest.raises(LookupError):
        store.read()
    assert store.put(rows(spark, 5), "2024-01-01") == 1 and store.put(rows(spark, 7), "2024-01-02") == 2
    assert store.put(rows(spark, 5).repartition(3).select("v", "id"), "2024-01-01") == 1
    for other in (rows(spark, 6), rows(spark, 5, "y"), rows(spark, 5).withColumn("w", F.lit(1)), rows(spark, 5).union(rows(spark, 1))):
        with pytest.raises(SnapshotConflict, match="other content"):
            store.put(other, "2024-01-01")
    assert store.versions() == [1, 2] and store.read().count() == 7 and store.read(retrieved="2024-01-01").count() == 5 and store.read(version=1).count() == 5
    assert {r["retrieved"]: r["n"] for r in store.history().groupBy("retrieved").agg(F.count("*").alias("n")).collect()} == {"2024-01-01": 5, "2024-01-02": 7}


def test_of_two_writers_on_one_version_one_wins(spark, store):
    store.put(rows(spark, 1), "2024-01-01")
    assert store.put(rows(spark, 2), "2024-01-02", expected=1) == 2
    with pytest.raises(SnapshotConflict, match="taken"):
        store.put(rows(spark, 3), "2024-01-03", expected=1)
    assert store.versions() == [1, 2] and store.read().count() == 2
    assert store.put(rows(spark, 3), "2024-01-03") == 3


def test_vacuum_removes_only_what_nothing_names(spark, store):
    store.put(rows(spark, 4), "2024-01-01")
    with pytest.raises(SnapshotConflict):
        store.put(rows(spark, 9), "2024-01-02", expected=0)
    reader = store.read()
    assert store.vacuum(older_than_hours=1) == []
    assert len(store.vacuum(older_than_hours=0)) == 1 and store.vacuum(older_than_hours=0) == []
    assert reader.count() == 4 and store.read().count() == 4
