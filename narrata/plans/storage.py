"""Tables in the folder that driver and executors share.

Iterative and multi-pass operators cut their lineage by writing a Parquet table below
``spark.checkpoint.dir`` and reading it again. Such a table outlives the executor that wrote it, so a lost
executor costs a retry of its own tasks and no more.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; on one machine, where none is named, a temporary one, set on the session."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="narrata-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/narrata/{name}-{uuid.uuid4().hex}"


@contextmanager
def session_settings(spark: SparkSession, values: dict[str, str]):
    """The statements inside run under ``values``; the session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def freed_shuffles(spark: SparkSession):
    """Shuffle files of the statements inside go as soon as each ends."""
    return session_settings(spark, {SHUFFLE_CLEANUP: "true"})


class Workspace:
    """Names the tables of one operator call, so that it can drop those it no longer needs."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths = spark, name, {}

    def table(self, label: str, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it again; the shuffle files of the write are freed when it ends."""
        path = fresh_path(self.spark, f"{self.name}-{label}")
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        self.drop(label)
        self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete tables by label; unknown labels are no error."""
        jvm = self.spark.sparkContext._jvm
        for label in labels:
            if path := self.paths.pop(label, None):
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
