"""A store of daily snapshots: numbered manifests, refusal of changed content, and removal of what no manifest names."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .sinks import content_digest

MANIFEST = "version long, retrieved string, data string, digest string, n_rows long, schema string, written_at timestamp"


class SnapshotConflict(RuntimeError):
    """A retrieval date is stored with other content, or another writer took the version."""


@dataclass(frozen=True)
class SnapshotStore:
    """Snapshots below `root`, a folder that all executors share.

    `data/<id>` holds the rows of one snapshot and never changes; `manifest/<version>` holds one row that names it. A version is
    published by creating the next manifest folder, which fails if it exists: of two writers one wins. Readers take the highest manifest
    and the data it names, so they never see a half-written snapshot; data of writers that failed is named by nothing.
    """

    spark: SparkSession
    root: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _listed(self, folder: str) -> dict[str, int]:
        """Names below a folder with the time of their last change in ms."""
        fs, path = self._fs()
        at = path(f"{self.root}/{folder}")
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(at)} if fs.exists(at) else {}

    def versions(self) -> list[int]:
        fs, path = self._fs()
        done = lambda v: fs.exists(path(f"{self.root}/manifest/{v}/_SUCCESS"))
        return sorted(int(v) for v in self._listed("manifest") if done(v))

    def manifest(self) -> DataFrame:
        """One row per published version."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(*[f"{self.root}/manifest/{v:010d}" for v in known])

    def put(self, rows: DataFrame, retrieved: str, expected: int | None = None) -> int:
        """Stores the rows of a retrieval date and returns its version; a date that is stored with equal content keeps its version.

        `expected` is the version the writer has seen last (the latest if not given): if another writer published since, that is a
        SnapshotConflict, as is other content for a stored date.
        """
        seen = (self.versions() or [0])[-1] if expected is None else expected
        found = self.manifest().where(F.col("retrieved") == retrieved).collect()
        if found:
            stored = self.spark.read.parquet(f"{self.root}/{found[0]['data']}").columns
            same = rows.select(*stored) if set(rows.columns) == set(stored) else rows  # the order of columns is no content
            if content_digest(same).first()["digest"] != found[0]["digest"]:
                raise SnapshotConflict(f"{retrieved} is stored as version {found[0]['version']} with other content")
            return found[0]["version"]
        data = f"data/{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(f"{self.root}/{data}")
        written = self.spark.read.parquet(f"{self.root}/{data}")
        facts = content_digest(written).first()
        row = self.spark.range(1).select(F.lit(seen + 1).cast("long").alias("version"), F.lit(retrieved).alias("retrieved"), F.lit(data).alias("data"), F.lit(facts["digest"]).alias("digest"),
                                         F.lit(facts["n_rows"]).cast("long").alias("n_rows"), F.lit(written.schema.simpleString()).alias("schema"), F.current_timestamp().alias("written_at"))
        try:
            row.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifest/{seen + 1:010d}")
        except AnalysisException as error:
            raise SnapshotConflict(f"version {seen + 1} is taken") from error
        return seen + 1

    def read(self, version: int | None = None, retrieved: str | None = None) -> DataFrame:
        """Rows of a version, of a retrieval date, or of the latest version."""
        known = self.manifest()
        if retrieved is not None:
            known = known.where(F.col("retrieved") == retrieved)
        elif version is not None:
            known = known.where(F.col("version") == version)
        one = known.orderBy(F.col("version").desc()).first()
        if one is None:
            raise LookupError(f"no snapshot of {retrieved or version or 'any date'} below {self.root}")
        return self.spark.read.parquet(f"{self.root}/{one['data']}")

    def history(self) -> DataFrame:
        """All snapshots with their retrieval date, for `snapshot_history` and `compare_snapshots`."""
        out = None
        for r in self.manifest().orderBy("version").collect():  # one row a retrieval date
            one = self.spark.read.parquet(f"{self.root}/{r['data']}").withColumn("retrieved", F.lit(r["retrieved"]))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise LookupError(f"no snapshot below {self.root}")
        return out

    def vacuum(self, older_than_hours: float = 24.0) -> list[str]:
        """Removes data that no manifest names and that has not changed for so long (a writer may be at work); returns the names."""
        fs, path = self._fs()
        named = {r["data"].rsplit("/", 1)[1] for r in self.manifest().select("data").collect()}
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        gone = sorted(n for n, t in self._listed("data").items() if n not in named and now - t >= older_than_hours * 3_600_000)
        for name in gone:
            fs.delete(path(f"{self.root}/data/{name}"), True)
        return gone
