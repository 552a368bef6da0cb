"""Staged tables: a frame several outputs share, written once to the shared folder."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

__all__ = ["bucketed", "shared_path", "shuffles_cleared", "stage"]

_FOLDER = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="payouts-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder every executor can reach.

    The cluster names that folder in spark.checkpoint.dir. Where it is unset a temporary
    folder, removed at exit, takes its place, but only if the executors run in the driver.
    """
    folder = spark.conf.get(_FOLDER, None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {_FOLDER} to a folder that all executors share")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/payouts/{uuid.uuid4().hex}/{name}"


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Writes within remove the shuffle files they made when they end, as nothing reads them after the write. Spark
    keeps them otherwise until the driver collects garbage, beside those of all later steps of a query."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as parquet and read it back.

    The copy survives lost executors, cuts the plan, and its columns are read one by one. Its size on disk is what
    Spark plans later joins by, so a small table made from a large one is broadcast instead of moving the large side.
    The shuffle files of the write go when it ends.
    """
    path = shared_path(df.sparkSession, name)
    with shuffles_cleared(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """The frame written as a table bucketed and sorted by `key`, its files in the shared folder.

    Two such tables with the same number of buckets join on `key` without an exchange on either side: each task reads
    one bucket of both. A key that holds many rows fills its bucket's task; choose the number of buckets for the
    larger table.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    with shuffles_cleared(spark):
        df.write.bucketBy(buckets, key).sortBy(key).option("path", shared_path(spark, name)).saveAsTable(table)
    return spark.table(table)
