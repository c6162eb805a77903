"""Session helpers shared by tests, bench and jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Partition counts are left to the caller and to AQE:
# a cluster sets spark.sql.shuffle.partitions high and lets AQE coalesce.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_FOLDERS: list[tempfile.TemporaryDirectory] = []
_STAGED: dict[tuple, DataFrame] = {}


def build_session(master: str | None = None, app: str = "asofkit", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables and checkpoints.

    The cluster names it in spark.checkpoint.dir. Only in local mode (tests, one machine) may
    that be unset: a temporary folder then serves the session and goes with this process. On a
    cluster every executor would write to a disk of its own, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    made = tempfile.TemporaryDirectory(prefix="asofkit-", ignore_cleanup_errors=True)
    _FOLDERS.append(made)
    spark.conf.set("spark.checkpoint.dir", made.name)
    return made.name


def staged(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """`build()` written once per session and source folder; later calls read the same table."""
    key = (spark.sparkContext.applicationId, scratch_dir(spark), name, source)
    if key not in _STAGED:
        _STAGED[key] = materialise(build())
    return _STAGED[key]


def materialise(df):
    """Write a derived table to the shared folder and read it back.

    For tables that several branches of a plan read: the work above is done once, survives
    lost executors, and later joins see real sizes. Rows and columns are unchanged.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
