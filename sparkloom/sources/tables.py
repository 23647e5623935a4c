"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet`` as a lazy scan; filters and projections reach the reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows that are read from too few, small files to occupy even half of the cores, dealt out to all of them.

    For work in Python on each row, which a file that cannot be split would leave to one core. Where there are partitions
    enough, as with any large table, or where the rows were shuffled already, nothing is moved.
    """
    execution = rows._jdf.queryExecution()
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * execution.toRdd().getNumPartitions() < cores else rows
