"""Changes between consecutive full snapshots (problem 4).

A bucketed key-to-hash index is kept of every repository's last snapshot: one row ``(key, hash)`` per record, bucketed and
sorted by key. A delivery is written as the next generation of the index, bucketed alike, and probed against the last one
bucket by bucket: no shuffle. Only changed keys leave the probe, and only for these old and new values are fetched
(``change_details``). Then the generations are swapped: the new one is the index, the old one's files are deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from sparkloom.sources.shared import append_bucketed, bucketed, delete, shared_dir, written

CHANGES = "repo_name string, rev string, file_id bigint, change_kind string, old_hash string, new_hash string"


def normal_hash(column) -> F.Column:
    """Hash spelling without case, blanks and the ``sha256:`` prefix; null when nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(column)), r"^sha256:\s*", "")
    return F.when(bare != "", bare)


def delivered_chain(file_versions: DataFrame, revisions: DataFrame) -> DataFrame:
    """``(rev, repo_name, round)``: the delivered revisions of each repository, numbered from 1 by creation.

    A revision counts as delivered once any row names it. Revisions that no row or no ``revisions`` entry names are
    left out. Equal times are ordered by ``rev``; a repeated ``rev`` counts once (its earliest entry).
    """
    delivered = file_versions.select("rev").where(F.col("rev").isNotNull()).distinct()
    known = (
        revisions.select("rev", "repo_name", "created_at")
        .where(F.col("rev").isNotNull() & F.col("repo_name").isNotNull())
        .groupBy("rev")
        .agg(F.min(F.struct("created_at", "repo_name")).alias("first"))
        .select("rev", "first.repo_name", "first.created_at")
    )
    order = Window.partitionBy("repo_name").orderBy(F.col("created_at").asc_nulls_last(), "rev")
    return known.join(delivered, "rev", "left_semi").select("rev", "repo_name", F.row_number().over(order).alias("round"))


_KEYS = ["repo_name", "file_id"]


class SnapshotIndex:
    """Bucketed ``(repo_name, file_id) -> hash`` index of the last snapshots, in the shared folder.

    Each generation is a partition of one bucketed table. ``generations`` are complete ones known beforehand, numbered from 1
    in the column ``round`` (a chain that was delivered already); they are bucketed together, by one shuffle.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, generations: DataFrame | None = None):
        self.spark, self.round = spark, 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        empty = spark.createDataFrame([], "repo_name string, file_id bigint, hash string, round int")
        self.name = bucketed(empty if generations is None else generations, "snapshot_index", _KEYS, self.buckets, "round")

    def of(self, number: int) -> DataFrame:
        return self.spark.table(self.name).where(F.col("round") == number).drop("round")

    def last(self) -> DataFrame:
        """The present index: ``(repo_name, file_id, hash)``."""
        return self.of(self.round)

    def advance(self, path: str, revs: DataFrame) -> None:
        """Probes the next generation with the index, appends the changes to ``path`` and swaps the two.

        ``revs``: the ``(repo_name, rev)`` that were delivered with it.
        """
        changes = _probe(self.last(), self.of(self.round + 1), revs)
        changes.write.mode("append").parquet(path)
        if self.round:
            delete(self.spark, f"{shared_dir(self.spark)}/{self.name}/round={self.round}")
            self.spark.catalog.refreshTable(self.name)
        self.round += 1

    def deliver(self, snapshot: DataFrame, revs: DataFrame) -> DataFrame:
        """Takes in one delivery and returns its changes (``CHANGES``), written.

        ``snapshot``: ``(repo_name, file_id, hash)``, the whole new snapshots of the repositories in ``revs`` (``repo_name``,
        ``rev``; one of each); keys are unique, rows of other repositories are left out. Repositories without a delivery stay as they
        are; one that is new has all its records added; one delivered empty has all removed.
        """
        next_round = F.lit(self.round + 1).alias("round")
        new = snapshot.join(revs.select("repo_name"), "repo_name", "left_semi").select(*_KEYS, "hash", next_round)
        append_bucketed(new.repartition(self.buckets, *_KEYS), self.name, _KEYS, self.buckets, "round")
        kept = self.last().join(revs.select("repo_name"), "repo_name", "left_anti").select(*_KEYS, "hash", next_round)
        append_bucketed(kept, self.name, _KEYS, self.buckets, "round")
        path = f"{shared_dir(self.spark)}/changes-{uuid.uuid4().hex}"
        self.advance(path, revs)
        return self.spark.read.schema(CHANGES).parquet(path)


def _probe(index: DataFrame, new: DataFrame, revs: DataFrame) -> DataFrame:
    """Probes one round's rows against the index of the round before. ``revs``: the round's ``(repo_name, rev)``."""
    old, new = index.withColumnRenamed("hash", "old_hash"), new.withColumnRenamed("hash", "new_hash")
    changed = (
        old.join(new, _KEYS, "full_outer")
        .where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    )
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("changed")
    # The inner join also drops repositories whose chain has ended before this round.
    return changed.join(revs, "repo_name").select("repo_name", "rev", "file_id", kind.alias("change_kind"), "old_hash", "new_hash")


def snapshot_changes(file_versions: DataFrame, revisions: DataFrame, buckets: int | None = None) -> DataFrame:
    """Added, removed and changed records of every delivered snapshot but a repository's first.

    Per ``(rev, file_id)`` the row with the latest ``loaded_at`` among those with a hash counts (a missing time is the
    earliest, equal times: the greatest hash). Rows without ``rev``, ``file_id`` or hash hold no record, but a revision
    with only such rows is a delivered, empty snapshot. Repeated rows change nothing; an empty table gives no rows;
    other columns are ignored, whatever they are called.

    The index goes through the chains of all repositories together, one probe and swap a round, so that no plan grows with
    their length. ``buckets``: buckets of the index, by default ``spark.sql.shuffle.partitions``. The number of rounds
    (revisions of the longest chain) is read on the driver: one number.
    """
    spark = file_versions.sparkSession
    chain = written(delivered_chain(file_versions, revisions), "snapshot-chain")
    rounds = chain.agg(F.max("round")).first()[0] or 0
    if rounds < 2:
        return spark.createDataFrame([], CHANGES)
    rows = (
        file_versions.select("rev", "file_id", normal_hash(F.col("blob_hash")).alias("hash"), "loaded_at")
        .where(F.col("hash").isNotNull() & F.col("file_id").isNotNull())
        .join(chain, "rev")
        .groupBy("repo_name", "round", "file_id")
        .agg(F.max(F.struct("loaded_at", "hash"))["hash"].alias("hash"))
        .select("repo_name", F.col("file_id").cast(T.LongType()).alias("file_id"), "hash", "round")
    )
    index, path = SnapshotIndex(spark, buckets, rows), f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    index.round = 1  # first snapshots have no changes
    for number in range(2, rounds + 1):
        index.advance(path, chain.where(F.col("round") == number).select("repo_name", "rev"))
    return spark.read.schema(CHANGES).parquet(path)


#: Changes up to which their keys are broadcast to fetch values; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def change_details(changes: DataFrame, file_versions: DataFrame) -> DataFrame:
    """``changes`` with ``new_size``: the size delivered with the counted hash, fetched for changed keys only.

    Several sizes for one hash: the greatest. Removed records have none.
    """
    wanted = changes.select("rev", "file_id", "new_hash").where("new_hash is not null").distinct()
    if changes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sizes = file_versions.select("rev", "file_id", normal_hash(F.col("blob_hash")).alias("new_hash"), F.col("size").alias("new_size"))
    sizes = sizes.join(wanted, ["rev", "file_id", "new_hash"], "left_semi").groupBy("rev", "file_id", "new_hash").agg(F.max("new_size").alias("new_size"))
    return changes.join(sizes, ["rev", "file_id", "new_hash"], "left")


def change_counts(changes: DataFrame) -> DataFrame:
    """Rows per revision and kind of change."""
    return changes.groupBy("repo_name", "rev", "change_kind").agg(F.count(F.lit(1)).alias("n_files"))
