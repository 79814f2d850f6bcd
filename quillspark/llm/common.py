"""Shared folder, written tables and small frame helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir.

    Only a local session may go without it; it then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_exchanges(spark: SparkSession) -> Iterator[None]:
    """Actions in here delete the files of their exchanges on all executors as soon as they end.

    Otherwise they stay until the driver's garbage collection finds them, which a long job of many steps can't wait for.
    Only for plans that run once.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet, free its exchanges, and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with freed_exchanges(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever its scheme."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(df: DataFrame) -> None:
    """Delete the table behind a result of written(), once nothing reads it any more."""
    if files := df.inputFiles():
        drop_path(df.sparkSession, files[0].rpartition("/")[0])
