"""Job intake as a stream: admission, de-duplication and cool-down."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from sparkloom.operators.ranges import last_value_before
from sparkloom.sources.shared import shared_dir


def admitted(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Events of the given kinds with a user (W1): stateless, on streams and tables alike."""
    return events.where(F.col("event_type").isin(*kinds) & F.col("user_id").isNotNull())


def first_jobs(events: DataFrame) -> DataFrame:
    """The first event of every (user, type, hour) of a table, by ``event_id``: the batch form of the unique key."""
    job = events.select("event_id", "user_id", "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    return job.groupBy("user_id", "event_type", "hour").agg(F.min("event_id").alias("event_id")).select("event_id", "user_id", "event_type")


def parquet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream of a directory of Parquet files, or of one file (as its directory with the file's name for a pattern)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    directory, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(directory)


def stream_first_jobs(spark: SparkSession, path: str, schema, kinds: list[str]) -> DataFrame:
    """The same over a stream of Parquet files: all that is there is taken in, with the keys' state in the checkpoint."""
    at = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    events = admitted(parquet_stream(spark, path, schema), kinds)
    jobs = events.withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp"))).groupBy("user_id", "event_type", "hour").agg(F.min("event_id").alias("event_id"))

    def upsert(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{at}/rows")

    jobs.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(upsert).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/rows")
    return rows.groupBy("user_id", "event_type", "hour").agg(F.min("event_id").alias("event_id")).select("event_id", "user_id", "event_type")


def cooled(events: DataFrame, seconds: int) -> DataFrame:
    """Events at least ``seconds`` after the user's event before, whether that was taken or not (a debounce), by ranges of a day."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = last_value_before(events, ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], at, "_before")
    return rows.where(F.col("_before").isNull() | (at - F.col("_before") >= seconds * 1_000_000)).drop("_before")


def _taken(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, micros: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([], columns=["event_id", "user_id"])
        return
    last, kept = state.get[0] if state.exists else None, []
    rows = pd.concat([batch[["at", "event_id"]] for batch in batches]).dropna(subset="at").sort_values(["at", "event_id"])  # the batches come in no order
    for at, event in zip(rows["at"], rows["event_id"]):
        if last is None or at - last >= micros:
            kept.append((event, key[0]))
            last = at
    yield pd.DataFrame(kept, columns=["event_id", "user_id"])
    if last is not None:
        state.update((int(last),))
        # Once the watermark is a cool-down beyond the last event taken, any later one is taken anyhow.
        state.setTimeoutTimestamp(max(int(last + micros) // 1000, state.getCurrentWatermarkMs()) + 1)


def stream_cooldown(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Events of a stream at least ``seconds`` after the last taken one of the same user (W2), kept as keyed state.

    A user's state is dropped when the watermark (``late`` behind the newest event) has passed its cool-down; events that
    come later than that are left out.
    """
    stamped = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    rows = stamped.select("event_id", "user_id", "_at", F.unix_micros("_at").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(
        partial(_taken, micros=seconds * 1_000_000), "event_id bigint, user_id bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_accepted(spark: SparkSession, path: str, schema, seconds: int) -> DataFrame:
    """``stream_cooldown`` over all files that are there, its output collected in the shared folder."""
    at = f"{shared_dir(spark)}/cooldown-{uuid.uuid4().hex}"
    rows = stream_cooldown(parquet_stream(spark, path, schema).where("user_id is not null and ts is not null"), seconds)
    rows.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/rows").format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint").parquet(f"{at}/rows")


def _fold(batches: Iterator[pd.DataFrame], micros: int) -> Iterator[pd.DataFrame]:
    """Taken events of segments that come whole and in order, over any number of batches."""
    key = last = None
    for batch in batches:
        kept = []
        for event, user, segment, at in zip(batch["event_id"], batch["user_id"], batch["segment"], batch["at"]):
            if (user, segment) != key or at - last >= micros:
                kept.append((event, user))
                key, last = (user, segment), at
        yield pd.DataFrame(kept, columns=["event_id", "user_id"])


def accepted(events: DataFrame, seconds: int, range_seconds: int = 86_400) -> DataFrame:
    """``(event_id, user_id)``: events at least ``seconds`` after the user's last taken one (W2), in the order (ts, event_id).

    The same as ``stream_cooldown`` over a table. An event that comes ``seconds`` or more after the one before is taken
    whatever was taken earlier, so each range of time that has such an event starts a segment there, and segments are
    independent. Only users whose events never pause that long are one segment; it is read in order, nothing of it is
    kept but the last time. Events without a user or a time are left out.
    """
    micros, keys = seconds * 1_000_000, ["user_id", "range"]
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("event_id is not null and user_id is not null and at is not null")
    rows = rows.withColumn("range", F.expr(f"at div {range_seconds * 1_000_000}"))
    paused = F.col("at") - F.lag("at").over(Window.partitionBy(*keys).orderBy("at", "event_id")) >= micros
    ranges = rows.withColumn("paused", paused).groupBy(*keys).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min(F.when(F.col("paused"), F.col("at"))).alias("inner"))
    earlier = Window.partitionBy("user_id").orderBy("range")
    before = F.lag("last").over(earlier)
    ranges = ranges.withColumn("anchor", F.when(before.isNull() | (F.col("first") - before >= micros), F.col("first")).otherwise(F.col("inner")))
    own = F.when(F.col("anchor").isNotNull(), F.col("range"))
    ranges = ranges.withColumn("open", F.last(own, ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "anchor", "open")
    segment = F.when(F.col("at") >= F.col("anchor"), F.col("range")).otherwise(F.col("open"))
    parts = rows.join(ranges, keys).select("event_id", "user_id", segment.alias("segment"), "at").repartition("user_id", "segment").sortWithinPartitions("user_id", "segment", "at", "event_id")
    return parts.mapInPandas(partial(_fold, micros=micros), "event_id bigint, user_id bigint")
