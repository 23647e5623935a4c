from datetime import datetime

import pytest

from sparkloom.operators.snapshots import SnapshotIndex, change_counts, change_details, snapshot_changes

FV = "rev string, file_id bigint, blob_hash string, size bigint, mtime double, loaded_at timestamp_ntz, hash string, repo_name int"
REV = "rev string, base_rev string, created_at double, repo_name string"


def at(day):
    return datetime(2025, 1, day)


def version(rev, file_id, blob, day=1, size=1):
    return (rev, file_id, blob, size, 0.0, at(day) if day else None, "clash", 7)


def run(spark, versions, revisions):
    changes = snapshot_changes(spark.createDataFrame(versions, FV), spark.createDataFrame(revisions, REV), buckets=3)
    return {(r.rev, r.file_id, r.change_kind) for r in changes.collect()}, changes


REVS = [("c", "b", 3.0, "x"), ("a", None, 1.0, "x"), ("b", None, 2.0, "x"), ("never", "b", 2.5, "x"), ("y1", None, 1.0, "y")]


def test_kinds_and_skipped_revisions(spark):
    versions = [version("a", 1, "H1"), version("a", 2, "H2"), version("a", 3, "H3"), version("b", 1, "sha256:h1"), version("b", 2, "new"),
                version("b", 4, "h4"), version("c", 1, "h1"), version("y1", 9, "z")]
    got, changes = run(spark, versions, REVS)
    assert got == {("b", 2, "changed"), ("b", 3, "removed"), ("b", 4, "added"), ("c", 2, "removed"), ("c", 4, "removed")}
    assert {(r.rev, r.change_kind, r.n_files) for r in change_counts(changes).collect()} >= {("c", "removed", 2), ("b", "added", 1)}


def test_latest_delivery_with_a_hash_counts(spark):
    versions = [version("a", 1, "h1", 1), version("b", 1, "old", 1), version("b", 1, "h1", 5), version("b", 1, None, 9), version("b", 1, "older", None),
                version("b", 1, "h1", 5), version("a", 2, None), version("b", 2, "  ")]
    assert run(spark, versions, REVS)[0] == set()


def test_empty_snapshot_removes_everything(spark):
    assert run(spark, [version("a", 1, "h"), version("b", 7, None)], REVS)[0] == {("b", 1, "removed")}


def test_nulls_and_unknown_revisions(spark):
    versions = [version(None, 1, "h"), version("a", None, "h"), version("unknown", 1, "h"), version("a", 1, "h"), version("b", 1, "h")]
    assert run(spark, versions, [*REVS, (None, None, None, None), ("z", None, None, None)])[0] == set()


@pytest.mark.parametrize("versions,revisions", [([], REVS), ([version("a", 1, "h")], []), ([], [])])
def test_empty_tables(spark, versions, revisions):
    assert run(spark, versions, revisions)[0] == set()


def test_ties_take_the_greatest_hash_and_details(spark):
    versions = [version("a", 1, "aa", 1, 5), version("a", 1, "bb", 1, 6), version("b", 1, "bb", 1, 6), version("b", 2, "cc", 1, 8)]
    got, changes = run(spark, versions, REVS)
    assert got == {("b", 2, "added")}
    assert [r.new_size for r in change_details(changes, spark.createDataFrame(versions, FV)).collect()] == [8]


def test_equal_times_are_ordered_by_rev(spark):
    revs = [("r2", None, 1.0, "x"), ("r1", None, 1.0, "x"), ("r1", None, 9.0, "x")]
    assert run(spark, [version("r1", 1, "h"), version("r2", 2, "h")], revs)[0] == {("r2", 1, "removed"), ("r2", 2, "added")}


def test_one_delivery_at_a_time(spark):
    """Kept index: each delivery is compared with the last snapshot of its repositories only, the others stay."""
    index = SnapshotIndex(spark, buckets=3)

    def deliver(rev, *rows, repos=("x",)):
        snapshot = spark.createDataFrame(rows, "repo_name string, file_id bigint, hash string")
        revs = spark.createDataFrame([(r, rev) for r in repos], "repo_name string, rev string")
        return {(r.repo_name, r.rev, r.file_id, r.change_kind, r.old_hash, r.new_hash) for r in index.deliver(snapshot, revs).collect()}

    assert deliver("a", ("x", 1, "h1"), ("x", 2, "h2"), ("z", 9, "h9")) == {("x", "a", 1, "added", None, "h1"), ("x", "a", 2, "added", None, "h2")}
    assert deliver("b", ("y", 1, "k1"), repos=("y",)) == {("y", "b", 1, "added", None, "k1")}
    assert deliver("c", ("x", 1, "h1"), ("x", 2, "new")) == {("x", "c", 2, "changed", "h2", "new")}
    assert deliver("d", ("x", 1, "h1"), ("y", 1, "k2"), repos=("x", "y")) == {("x", "d", 2, "removed", "new", None), ("y", "d", 1, "changed", "k1", "k2")}
    assert deliver("e") == {("x", "e", 1, "removed", "h1", None)}
    assert {tuple(r) for r in index.last().collect()} == {("y", 1, "k2")}
