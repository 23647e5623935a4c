"""Problem 4 on ``file_versions`` and ``revisions``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators.snapshots import change_counts, change_details, snapshot_changes
from sparkloom.sources.tables import table


def p4_found(spark, sf_dir):
    changes = snapshot_changes(table(spark, sf_dir, "file_versions"), table(spark, sf_dir, "revisions"))
    return changes.select("rev", "file_id", "change_kind")


def p4_counts(spark, sf_dir):
    return change_counts(snapshot_changes(table(spark, sf_dir, "file_versions"), table(spark, sf_dir, "revisions")))


def p4_details(spark, sf_dir):
    versions = table(spark, sf_dir, "file_versions")
    changes = change_details(snapshot_changes(versions, table(spark, sf_dir, "revisions")), versions)
    size = F.coalesce("new_size", F.lit(-1)).alias("new_size")  # -1: unknown or removed
    return changes.select("rev", "file_id", "change_kind", "old_hash", "new_hash", size)


_CHANGES = """
WITH fv AS (SELECT rev, file_id, loaded_at, size,
                   nullif(regexp_replace(lower(trim(blob_hash)), '^sha256:\\s*', ''), '') AS hash FROM file_versions),
chain AS (SELECT rev, repo_name, row_number() OVER (PARTITION BY repo_name ORDER BY created_at NULLS LAST, rev) AS round
          FROM revisions WHERE repo_name IS NOT NULL AND rev IN (SELECT rev FROM file_versions WHERE rev IS NOT NULL)),
best AS (SELECT rev, file_id, hash FROM fv WHERE hash IS NOT NULL AND file_id IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY rev, file_id ORDER BY loaded_at DESC NULLS LAST, hash DESC) = 1),
snap AS (SELECT repo_name, round, file_id, hash FROM best JOIN chain USING (rev)),
moved AS (SELECT repo_name, round + 1 AS round, file_id, hash FROM snap),
changes AS (SELECT c.rev, coalesce(n.file_id, o.file_id) AS file_id,
       CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
       o.hash AS old_hash, n.hash AS new_hash, c.repo_name
FROM moved o FULL JOIN snap n USING (repo_name, round, file_id)
JOIN chain c ON c.repo_name = coalesce(o.repo_name, n.repo_name) AND c.round = coalesce(o.round, n.round)
WHERE c.round > 1 AND o.hash IS DISTINCT FROM n.hash)
"""

QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p4_details": p4_details}
SQL = {
    "p4_found": _CHANGES + "SELECT rev, file_id, change_kind FROM changes",
    "p4_counts": _CHANGES + "SELECT repo_name, rev, change_kind, count(*) AS n_files FROM changes GROUP BY ALL",
    "p4_details": _CHANGES
    + """SELECT rev, file_id, change_kind, old_hash, new_hash,
       coalesce((SELECT max(size) FROM fv WHERE fv.rev = changes.rev AND fv.file_id = changes.file_id AND fv.hash = changes.new_hash), -1) AS new_size
FROM changes""",
}
