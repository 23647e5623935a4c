"""Top N items within every group (problem 5).

Partition lower bounds: the N-th best item that any partition holds of a group is a lower bound for the group's overall
N-th best. Every partition is sorted and gives its N best items a group with the N-th as its bound; the largest bound of
each group is joined to the items, items below it are dropped, and only the survivors are shuffled and ranked. Hot groups
leave each partition with at most N rows and never meet in one task as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from sparkloom.sources.shared import written

#: Repeated ids, and bounds, up to which they are broadcast; beyond it their joins shuffle.
BROADCAST_ROWS = 1_000_000
GROUP = ["file_path", "risk_type"]


def normal_path(column) -> F.Column:
    """Path with ``/`` only and without leading ``./``; null when blank."""
    slashed = F.regexp_replace(F.trim(column), r"\\", "/")
    bare = F.regexp_replace(slashed, r"^(?:\./+)+", "")
    return F.when(bare != "", bare)


def accepted_items(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Valid items, one row per ``risk_id``: ``(risk_id, file_path, risk_type, confidence, start)``.

    Rejected: confidence NaN or outside 0..1, a missing ``start`` or ``end``, ``start`` < 1, ``start`` > ``end``, missing or
    blank path, a type that is no accepted spelling, a missing ``risk_id``. A missing confidence is 0.5. Of several
    accepted rows with one id the latest ``created_at`` counts (missing: earliest; equal times: the better item, then
    the greater path and type). Only rows of repeated ids are moved to find it.
    """
    spellings = aliases.select(F.col("written_type").alias("_written"), F.col("risk_type").alias("_type")).where("_written is not null and _type is not null")
    spellings = spellings.groupBy("_written").agg(F.min("_type").alias("_type"))
    confidence = F.coalesce(F.col("confidence"), F.lit(0.5))
    read = items.select(
        F.col("risk_id").cast("bigint").alias("risk_id"),
        normal_path(F.col("file_path")).alias("file_path"),
        F.col("risk_type").alias("_written"),
        confidence.alias("confidence"),
        F.col("line_number.start").cast("bigint").alias("start"),
        F.col("line_number.end").cast("bigint").alias("end"),
        F.col("created_at").alias("_at"),
    ).where(
        F.col("risk_id").isNotNull()
        & F.col("file_path").isNotNull()
        & ~F.isnan("confidence")
        & F.col("confidence").between(0, 1)
        & (F.col("start") >= 1)
        & (F.col("start") <= F.col("end"))
    )
    version = F.struct("_at", "confidence", (-F.col("start")).alias("_before"), "file_path", F.col("_type").alias("risk_type"), "start")
    named = read.join(spellings, "_written")
    ids = items.select(F.col("risk_id").cast("bigint").alias("risk_id")).where("risk_id is not null")
    repeated = written(ids.groupBy("risk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("risk_id"), "repeated")
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    latest = named.join(repeated, "risk_id", "left_semi").groupBy("risk_id").agg(F.max(version).alias("v"))
    single = named.join(repeated, "risk_id", "left_anti").select("risk_id", "file_path", F.col("_type").alias("risk_type"), "confidence", "start")
    return single.unionByName(latest.select("risk_id", "v.file_path", "v.risk_type", "v.confidence", "v.start"))


def _local_best(n: int):
    """The ``n`` best items of each group of a sorted partition, the ``n``-th marked as the partition's bound."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carried = None, 0  # the group that the batch before ended in, and its items so far
        for batch in batches:
            if batch.empty:
                continue
            groups = batch[GROUP]
            begins = (groups != groups.shift()).any(axis=1).to_numpy()
            first = tuple(groups.iloc[0])
            begins[0] = True
            at = np.arange(len(batch))
            place = at - np.maximum.accumulate(np.where(begins, at, 0))
            if first == last:
                rest = np.flatnonzero(begins[1:])
                place[: rest[0] + 1 if len(rest) else len(batch)] += carried
            last, carried = tuple(groups.iloc[-1]), int(place[-1]) + 1
            kept = place < n
            yield batch[kept].assign(is_bound=place[kept] == n - 1)

    return best


def top_n(items: DataFrame, aliases: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best accepted items of every file and type, with their ``rank``.

    Better: higher confidence, then smaller ``start``, then smaller ``risk_id``; so ties are always resolved alike.
    Smaller groups are kept whole; an empty table gives no rows; repeated rows count once; further columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    accepted = accepted_items(items, aliases)
    order = [F.col("confidence").desc(), F.col("start"), F.col("risk_id")]
    schema = T.StructType([*accepted.schema.fields, T.StructField("is_bound", T.BooleanType())])
    local = written(accepted.sortWithinPartitions(*GROUP, *order).mapInPandas(_local_best(n), schema), "local-best")
    key = F.struct("confidence", (-F.col("start")).alias("s"), (-F.col("risk_id")).alias("r"))
    marked = local.where("is_bound")
    bounds = marked.groupBy(*GROUP).agg(F.max(key).alias("_bound"))
    if marked.count() <= BROADCAST_ROWS:
        bounds = F.broadcast(bounds)
    survivors = local.join(bounds, GROUP, "left").where(F.col("_bound").isNull() | (key >= F.col("_bound"))).drop("is_bound", "_bound")
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order))
    return survivors.withColumn("rank", rank).where(F.col("rank") <= n)
