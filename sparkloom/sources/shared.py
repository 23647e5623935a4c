"""Intermediate results that survive the loss of an executor.

The cluster names a folder all executors can reach in ``spark.checkpoint.dir``. Only on one machine (a local master, as in
tests) a new temporary folder is made where that is unset; elsewhere that is an error. All that a session writes lies in
one folder of its own below, and is deleted by ``release``, at the latest when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_LOCAL = re.compile(r"local(?:\[.*\]|-cluster\[.*\])?")
_held: dict[str, tuple[SparkSession, list[str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's own folder in the shared one as a URI, with the context's checkpoint directory set to the latter."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not _LOCAL.fullmatch(master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} can reach")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    own = f"{named.rstrip('/')}/loom-{spark.sparkContext.applicationId}"
    if own not in _held:
        if not _held:
            atexit.register(_release_all)
        _held[own] = spark, []
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage (a lost executor costs no recomputation) and lets several branches read one result with column
    pruning and filter pushdown, which ``checkpoint()`` has not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, keys: list[str], buckets: int, partition: str | None = None) -> str:
    """``df`` as a table in the shared folder, bucketed and sorted by ``keys``; its name in the catalog until ``release``."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    folder = shared_dir(spark)
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    (writer.partitionBy(partition) if partition else writer).option("path", f"{folder}/{name}").format("parquet").saveAsTable(name)
    _held[folder][1].append(name)
    return name


def append_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, partition: str) -> None:
    """Adds rows to a table of ``bucketed``; rows that come hashed by ``keys`` (after a join on them) are not moved again."""
    df.write.mode("append").partitionBy(partition).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drops a table of ``bucketed`` and deletes its files."""
    folder = shared_dir(spark)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, f"{folder}/{name}")
    if name in _held[folder][1]:
        _held[folder][1].remove(name)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Drops the session's tables and deletes its intermediates: results not yet read or written elsewhere are lost."""
    folder = shared_dir(spark)
    _, names = _held.pop(folder)
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, folder)


def _release_all() -> None:
    for spark, _ in list(_held.values()):
        with suppress(Exception):  # the session may be gone
            release(spark)
