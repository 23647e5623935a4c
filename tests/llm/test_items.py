"""Problems 5, 6 and 7 against brute force and exact round trips."""

import random
from datetime import datetime

import pytest

from sparkloom.llm.packing import container_fill, fill, pack_texts, token_parts
from sparkloom.llm.splitting import cut_files, cut_sections, split_oversized, split_text
from sparkloom.llm.topn import top_n

RISK = "risk_id bigint, review_id bigint, risk_type string, file_path string, line_number struct<start int, end int>, confidence double, created_at timestamp_ntz, rank int, is_bound boolean, _type string"
ALIAS = [("race", "R"), ("R", "R"), ("lint", "S"), (None, "x")]


def item(risk_id, path="a/b", kind="race", start=1, end=None, confidence=0.5, day=1):
    return (risk_id, 1, kind, path, None if start is None else (start, start if end is None else end), confidence, datetime(2025, 1, day), 9, None, "clash")


def best(spark, rows, n=3):
    aliases = spark.createDataFrame(ALIAS, "written_type string, risk_type string")
    return {(r.risk_id, r.rank) for r in top_n(spark.createDataFrame(rows, RISK), aliases, n).collect()}


def test_top_n_ties_and_order(spark):
    rows = [item(5, confidence=0.9, start=7), item(4, confidence=0.9, start=7), item(3, confidence=0.9, start=2), item(2, confidence=None), item(1, confidence=0.4), item(9, kind="lint")]
    assert best(spark, rows) == {(3, 1), (4, 2), (5, 3), (9, 1)}


def test_top_n_paths_types_and_versions(spark):
    rows = [item(1, "./a/b"), item(2, ".\\a\\b", "R"), item(3, "a\\b"), item(4, "a/b", confidence=0.1), item(4, "a/b", confidence=0.9, day=2), item(5, "a/b", confidence=1.0), item(5, "a/b", confidence=0.0, day=3)]
    assert best(spark, rows) == {(4, 1), (1, 2), (2, 3)}


def test_top_n_rejects(spark):
    rows = [item(1, confidence=float("nan")), item(2, confidence=1.01), item(3, confidence=-0.1), item(4, start=0), item(5, start=4, end=3), item(6, None), item(7, "  "), item(8, kind="misc"), item(9, kind=None), item(None), item(10, start=None), item(11, confidence=1.0), item(11, confidence=7.0, day=9)]
    assert best(spark, rows) == {(11, 1)}


def test_top_n_empty_and_repeated(spark):
    assert best(spark, []) == set()
    assert best(spark, [item(1)] * 5) == {(1, 1)}
    with pytest.raises(ValueError):
        best(spark, [item(1)], 0)


def test_bounds_cut_before_the_ranking(spark, monkeypatch):
    """A partition of better items sets a bound that drops another partition's items; the same without broadcasts."""
    from sparkloom.llm import topn

    rows = [item(i, confidence=0.9) for i in range(10)] + [item(i, confidence=0.1) for i in range(10, 20)] + [item(3, confidence=0.2, day=2)]
    for limit in (1_000_000, -1):
        monkeypatch.setattr(topn, "BROADCAST_ROWS", limit)
        assert best(spark, rows) == {(0, 1), (1, 2), (2, 3)}


def test_top_n_of_hot_groups_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [item(i, rnd.choice(["hot"] * 8 + ["x", "y"]), start=rnd.randrange(1, 4), confidence=rnd.choice([0.1, 0.5, 0.5, 0.9, None])) for i in range(3000)]
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((-(0.5 if r[5] is None else r[5]), r[4][0], r[0]))
    want = {(g[2], k) for group in groups.values() for k, g in enumerate(sorted(group)[:4], 1)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert best(spark, rows, 4) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- Splitting ------------------------------------------------------------------------------------------------------


def joined(text, limit, overlap):
    pieces = [text[max(0, a - overlap) : b] for a, b in split_text(text, limit, overlap)[0]]
    assert all(len(p) <= limit for p in pieces)
    for before, after, (a, _) in zip(pieces, pieces[1:], split_text(text, limit, overlap)[0][1:]):
        shared = min(overlap, a)
        assert after[:shared] == before[-shared:] or not shared
    return pieces[0] + "".join(p[min(overlap, a) :] for p, (a, _) in zip(pieces[1:], split_text(text, limit, overlap)[0][1:]))


def test_split_round_trip_on_random_diffs():
    rnd = random.Random(1)
    parts = ["diff --git a/x b/x\n", "@@ -1 +1 @@\n", "+line\r\n", " \n", "-" + "y" * 90 + "\n", "+" + "z" * 300, "é中\n", "diff --cc q\n", " diff --git no\n"]
    for _ in range(150):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 120)))
        assert joined(text, 200, 20) == text


def test_split_prefers_natural_ends():
    file = "diff --git a/x b/x\n" + "+abc\n" * 10
    ends = [b for _, b in split_text(file * 6, 150, 10)[0]]
    assert all(e % len(file) == 0 for e in ends)
    hunks = "diff --git a/x b/x\n" + ("@@ -1 +1 @@\n" + "+abc\n" * 10) * 5
    assert all(hunks[b:].startswith("@@") or b == len(hunks) for _, b in split_text(hunks, 150, 10)[0])


def test_sections_that_cannot_stay_whole():
    def cut(text, limit=40):
        return [k for _, k in cut_files(text, split_text(text, limit, 5)[1], limit)]

    small, big, edge = "diff --git a b\nx\n", "diff --git c d\n" + "+y\n" * 20, "diff --cc q\n" + "z" * 28
    assert cut("mail\n" * 20 + small + big + small) == [2] and cut(small * 9) == [] and cut("mail\n" * 20) == [] and cut(big + " diff --git no\n") == [1]
    assert len(edge) == 40 and cut(small + edge) == [] and cut(small + edge + "z") == [2]
    rnd = random.Random(3)
    for _ in range(100):
        parts = ["diff --git x\n" + "+l\n" * rnd.randrange(25) for _ in range(rnd.randrange(1, 8))]
        text = "head\n" + "".join(parts)
        want = [k for k, p in enumerate(parts, 1) if len(p) > 40] if len(text) > 40 else []
        assert cut(text) == want


STATE = "review_id bigint, diff_context string, updated_at timestamp_ntz, piece string, overlap string"


def states(spark, *rows):
    return spark.createDataFrame([(i, t, datetime(2025, 1, d), "x", "y") for i, t, d in rows], STATE)


def test_split_table(spark):
    big = "diff --git a b\n" + "+x\n" * 2000
    rows = [(1, "small", 1), (2, big + "diff --git c d\n", 2), (2, "stale", 1), (3, None, 1), (4, "", 1), (None, big, 1), (5, big, 1), (5, None, 9), (6, "y" * 9001, 1), (6, "y" * 9001, 1)]
    pieces = split_oversized(states(spark, *rows)).cache()
    assert {(r.review_id, r.file_no) for r in cut_sections(pieces).collect()} == {(2, 1)}
    for review, text in ((2, big + "diff --git c d\n"), (6, "y" * 9001)):
        got = pieces.where(f"review_id = {review}").orderBy("piece_no").collect()
        assert [r.piece_no for r in got] == [*range(1, len(got) + 1)]
        assert "".join(r.piece[r.overlap :] for r in got) == text and all(len(r.piece) <= 4000 for r in got)
        assert all(r.overlap == 200 for r in got[1:])
    assert {r.review_id for r in pieces.select("review_id").collect()} == {2, 6}
    assert split_oversized(states(spark)).count() == 0


# --- Packing --------------------------------------------------------------------------------------------------------


def test_fill_never_overflows():
    rnd = random.Random(2)
    for _ in range(50):
        lengths = [rnd.randrange(1, 101) for _ in range(rnd.randrange(1, 300))]
        at = fill(lengths, 100, (25, 50, 100))
        loads = {}
        for n, k in zip(lengths, at):
            loads[k] = loads.get(k, 0) + n
        assert max(loads.values()) <= 100 and set(loads) == set(range(len(loads)))
        assert len(loads) <= 1.3 * sum(lengths) / 100 + 2


def test_tiers_change_the_result_and_cost_little():
    rnd = random.Random(7)
    differing = 0
    for _ in range(40):
        lengths = [rnd.choice([rnd.randrange(1, 12), rnd.randrange(1, 40), rnd.randrange(40, 101)]) for _ in range(rnd.randrange(50, 300))]
        tiered, plain = fill(lengths, 100, (25, 50, 100)), fill(lengths, 100, (100,))
        groups = lambda at: {tuple(i for i, k in enumerate(at) if k == c) for c in set(at)}
        differing += groups(tiered) != groups(plain)
        assert len(set(tiered)) <= len(set(plain)) * 1.05 + 1
    assert differing > 20


def test_containers_do_not_depend_on_partitions(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join("word" for _ in range(rnd.randrange(1, 60)))) for i in range(300)]
    made = []
    for parts in (1, 7):
        placed = pack_texts(documents(spark, *rows).repartition(parts), capacity=100, tiers=(25, 50), group_containers=20, step=4)
        made.append({(r.doc_id, r.container_id, r.step_group) for r in placed.collect()})
    assert made[0] == made[1]


def test_rows_of_one_id_are_dealt_out(spark):
    placed = pack_texts(documents(spark, *[(7, "one two three four five six")] * 600), capacity=50, tiers=(25,), group_containers=4, step=2).collect()
    assert len(placed) == 600 and len({r.container_id >> 6 for r in placed}) > 5 and len({r.container_id for r in placed}) < 600 * 6 / 50 * 1.4


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id bigint, text string, n_tokens int, container_id string")


def test_pack_places_everything_once(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("word" for _ in range(rnd.randrange(1, 60)))) for i in range(400)] + [(900, "long text " * 200), (901, None), (902, " \n"), (903, "same"), (903, "same"), (None, "no id")]
    placed = pack_texts(documents(spark, *rows), capacity=100, tiers=(25, 50), group_containers=20, step=4).cache()
    got = placed.collect()
    assert sorted(r.doc_id for r in got if r.part_no == 1 and r.doc_id is not None) == sorted([*range(400), 900, 903, 903])
    assert sum(r.doc_id is None for r in got) == 1
    parts = sorted((r.part_no, r.token_start, r.n_tokens) for r in got if r.doc_id == 900)
    assert [p[1] for p in parts] == [100 * k for k in range(len(parts))] and all(p[2] == 100 for p in parts[:-1])
    assert all(r.n_parts == 1 for r in got if r.doc_id != 900)
    fills = container_fill(placed, 100).collect()
    assert max(r.n_tokens for r in fills) <= 100 and sum(r.n_tokens for r in fills) / len(fills) > 90
    assert sum(r.n_tokens for r in fills) == sum(r.n_tokens for r in token_parts(documents(spark, *rows), 100).collect())


def test_pack_empty(spark):
    assert pack_texts(documents(spark)).count() == 0
    assert pack_texts(documents(spark, (1, None), (2, ""))).count() == 0
