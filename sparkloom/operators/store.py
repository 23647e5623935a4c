"""Revisioned relational lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from sparkloom.operators.snapshots import normal_hash


def latest_rev(revisions: DataFrame, file_versions: DataFrame) -> DataFrame:
    """``(repo_name, rev)``: each repository's newest revision that has rows."""
    delivered = revisions.join(file_versions.select("rev").distinct(), "rev", "left_semi")
    return delivered.groupBy("repo_name").agg(F.max(F.struct("created_at", "rev"))["rev"].alias("rev"))


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key in ``order`` (U3, R24): one aggregation with partial results, no sort."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *others)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in others])


def versions_at(file_versions: DataFrame, revs: DataFrame) -> DataFrame:
    """``(rev, file_id, hash)`` counted at the given revisions."""
    rows = file_versions.select("rev", "file_id", normal_hash(F.col("blob_hash")).alias("hash"), "loaded_at").where("hash is not null")
    rows = rows.join(revs.select("rev"), "rev", "left_semi")
    return rows.groupBy("rev", "file_id").agg(F.max(F.struct("loaded_at", "hash"))["hash"].alias("hash"))


def first_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group (O3); Spark prunes each partition to them before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def new_content(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct hashes not among the known ones."""
    return rows.select("hash").distinct().join(known.select("hash"), "hash", "left_anti")


def fingerprint(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Order-independent fingerprint of the contents of each key (S26): count and sum of 40 bits of every SHA-256.

    Sums merge, so that no group is collected, sorted or held by one task.
    """
    bits = F.conv(F.left(F.sha2(content, 256), F.lit(10)), 16, 10).cast("bigint")
    return rows.where(content.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), F.sum(bits).alias("fingerprint"))


def names_like(rows: DataFrame, name: str, wanted: str) -> DataFrame:
    """Exact matches, or if there are none, those containing ``wanted`` in any case (Q-SYM, R6)."""
    exact = rows.where(F.col(name) == wanted)
    if not exact.isEmpty():
        return exact.withColumn("is_exact", F.lit(True))
    pattern = "%" + wanted.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return rows.where(F.col(name).ilike(pattern)).withColumn("is_exact", F.lit(False))


def required_revs(wanted: DataFrame, revisions: DataFrame, file_versions: DataFrame) -> DataFrame:
    """``(repo_name, rev, used)``: each wanted revision if it was delivered, else its repository's latest, else null (R2)."""
    delivered = file_versions.select("rev").where("rev is not null").distinct().withColumn("used", F.col("rev"))
    rows = wanted.select("repo_name", "rev").join(delivered, "rev", "left").join(latest_rev(revisions, file_versions).withColumnRenamed("rev", "_latest"), "repo_name", "left")
    return rows.select("repo_name", "rev", F.coalesce("used", "_latest").alias("used"))


def file_ids(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``paths`` with the ``file_id`` of each ``path``, null if there is none."""
    return paths.join(files.where("path is not null").groupBy("path").agg(F.min("file_id").alias("file_id")), "path", "left")


def symbol_locations(symbols: DataFrame, versions: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols ``(file_id, name, line_no)`` of the files that the revisions hold, with ``rev`` and ``path``."""
    known = files.select("file_id", "path")
    return symbols.join(versions.select("rev", "file_id"), "file_id").join(known, "file_id").select("rev", "path", "name", "line_no")


def repo_map_files(versions: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(rev, path, hash, n_symbols)`` of every file that a revision holds (R18, R20): counts, no lists."""
    counts = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_symbols"))
    rows = versions.join(files.select("file_id", "path"), "file_id").join(counts, "file_id", "left")
    return rows.select("rev", "path", "hash", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def repo_map_symbols(symbols: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` symbols of every path in the order (line, name)."""
    rows = symbols.join(files.select("file_id", "path"), "file_id").select("path", "line_no", "name")
    return first_per_group(rows, ["path"], [F.col("line_no"), F.col("name")], limit)


def greatest_content(versions: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, hash)``: the greatest hash that each path ever had."""
    best = versions.where("hash is not null").groupBy("file_id").agg(F.max("hash").alias("hash"))
    return best.join(files.select("file_id", "path"), "file_id").select("path", "hash")


def paths_containing(files: DataFrame, query: str) -> DataFrame:
    """Files whose path contains the query in any case."""
    return files.where(F.contains(F.lower("path"), F.lit(query.lower())))
