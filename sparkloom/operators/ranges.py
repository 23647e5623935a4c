"""Running values over groups of any size: ranges of the order column first, then the rows within each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def _carried(rows: DataFrame, keys: list[str], partial: Column, before: Column) -> DataFrame:
    """``(keys, _range, _before)``: ``before`` over the earlier ranges' ``_part``s. A key has a row for each range, so what is put in
    order for it are its ranges."""
    parts = rows.groupBy(*keys, "_range").agg(partial.alias("_part"))
    return parts.select(*keys, "_range", before.alias("_before"))


def running_sum(rows: DataFrame, keys: list[str], at: Column, order: list[Column], value: str, name: str, newest_first: bool = False) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row, in ``order`` within ``keys``.

    ``at`` is the range of a row, coarser than ``order`` and in line with it (``newest_first``: against it). A window holds
    the rows of one key and range; the sums of earlier ranges come from a row each.
    """
    ranged = rows.withColumn("_range", at)
    column = F.col("_range").desc() if newest_first else F.col("_range")
    earlier = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    before = _carried(ranged, keys, F.sum(value), F.coalesce(F.sum("_part").over(earlier), F.lit(0)))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    renamed = before.withColumnsRenamed({k: f"_k_{k}" for k in (*keys, "_range")})
    met = ranged.withColumn("_sum", F.sum(value).over(within)).join(renamed, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_range")])
    return met.select(*rows.columns, (F.col("_before") + F.col("_sum")).alias(name))


def last_value_before(rows: DataFrame, keys: list[str], at: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` of an earlier row of their key, in ``order``: an as-of join."""
    ranged = rows.withColumn("_range", at).withColumn("_value", value)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    before = _carried(ranged, keys, last, F.last("_part", ignorenulls=True).over(earlier))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    renamed = before.withColumnsRenamed({k: f"_k_{k}" for k in (*keys, "_range")})
    near = ranged.withColumn("_near", F.last("_value", ignorenulls=True).over(within))
    met = near.join(renamed, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_range")])
    return met.select(*rows.columns, F.coalesce("_near", "_before").alias(name))


def sliding_count(rows: DataFrame, keys: list[str], at: Column, order: list[Column], condition: Column, size: int, name: str, block: int = 1000) -> DataFrame:
    """``rows`` with how many of the last ``size`` rows of their key, up to and with each, meet the condition (V8).

    Rows are numbered by ranges first; windows then hold blocks of numbers, each with the last rows of the block before.
    """
    numbered = running_sum(rows.withColumn("_met", condition).withColumn("_one", F.lit(1)), keys, at, order, "_one", "_pos")
    own = F.floor((F.col("_pos") - 1) / block)
    both = F.when((F.col("_pos") - 1) % block > block - size, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = numbered.withColumn("_block", F.explode(both))
    last = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(1 - size, 0)
    counted = dealt.withColumn(name, F.count_if("_met").over(last)).where(F.col("_block") == own)
    return counted.select(*rows.columns, name)
