"""The folder that driver and executors share, and the tables that operators of several steps keep in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files are removed when it has run.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what sc.setCheckpointDir() was given. Where neither is set, a temporary folder if the master is one
    machine, and otherwise an error: executors that each write to a disk of their own would lose results without a word."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    return _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="heronlake-"))


class Tables:
    """Tables written to the shared folder, to cut lineage: they outlive executors, and each is read as often as needed.
    drop() removes one that no later step reads, clear() all; what is left goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path, files = self._files(self.base)
        files.deleteOnExit(path)
        for scope in _scopes:
            scope.append(self)

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The table is written in full, so shuffle files of the plan go at its end, and not when the driver happens to collect its garbage."""
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path, files = self._files(self.path(name))
        files.delete(path, True)

    def keep(self, *names: str) -> None:
        """Removes all tables but these."""
        path, files = self._files(self.base)
        for found in files.listStatus(path):
            if found.getPath().getName() not in names:
                files.delete(found.getPath(), True)

    def clear(self) -> None:
        path, files = self._files(self.base)
        files.delete(path, True)


_scopes: list[list[Tables]] = []


class scope:
    """with scope(): the tables that operators make inside are removed at its end, when their results have been written."""

    def __enter__(self) -> None:
        _scopes.append([])

    def __exit__(self, *_: object) -> None:
        for tables in _scopes.pop():
            tables.clear()
