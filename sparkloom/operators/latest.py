"""The latest of repeated rows, moving only those of keys that repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.sources.shared import written

#: Repeated keys (two numbers each) up to which they are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def _repeated(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Keys of several rows with their latest time, from these two columns alone, written once."""
    times = rows.select(key, _micros(at).alias("_at"))
    counted = times.groupBy(key).agg(F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    repeated = written(counted, "repeated")
    return F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated


def _micros(at: str) -> Column:
    return F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62)))


def flagged_latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of the latest time of their key, all of equally late ones; a missing time is the earliest. One scan, no shuffle
    unless very many keys repeat."""
    joined = rows.join(_repeated(rows, key, at), key, "left")
    return joined.where(F.col("_last").isNull() | (_micros(at) == F.col("_last"))).drop("_last")


def latest_rows(rows: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """One row of each key: the latest, of equally late ones the greatest in ``order``. Only rows of keys that repeat are
    moved; columns of ``order`` must be comparable."""
    repeated = _repeated(rows, key, at)
    late = rows.join(repeated, key).where(_micros(at) == F.col("_last")).drop("_last")
    others = [c for c in rows.columns if c != key and c not in order]
    best = late.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in (*order, *others)])
    single = rows.join(repeated.select(key), key, "left_anti")
    return single.select(*rows.columns).unionByName(best.select(*rows.columns))
