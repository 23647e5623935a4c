import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import diffs, store, textsearch
from sparkloom.streaming import jobs


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("path,lang", [("a/b.PY", "python"), ("x.tsx", "typescript"), ("Makefile", None), (None, None), ("a.go", "go")])
def test_language(spark, path, lang):
    assert one(spark, path, text.language) == lang


@pytest.mark.parametrize("path,plain", [("./a/b", "a/b"), (".\\a\\b", "a/b"), ("b/src/x", "src/x"), ("//x", "x"), ("ab/x", "ab/x")])
def test_plain_path(spark, path, plain):
    assert one(spark, path, text.plain_path) == plain


@pytest.mark.parametrize("path,weight", [("src/test/a.py", 0.4), ("tests/a.py", 0.4), ("a/b_test.py", 0.4), ("doc/x.md", 0.2), ("c/x.yaml", 0.6), ("a.py", 1.0)])
def test_type_weight(spark, path, weight):
    assert one(spark, path, text.type_weight) == weight


@pytest.mark.parametrize("path,hit", [("dist/a.js", True), ("a/dist/b/c.js", True), ("package.lock", True), ("a/b.lock", True), ("distant/a.js", False), ("a/lock", False)])
def test_globs_match_at_any_depth(spark, path, hit):
    assert one(spark, path, lambda c: text.excluded(c, ["**/dist/**", "**/*.lock"])) is hit


def test_scalar_functions(spark):
    row = spark.createDataFrame([("retry the Cache, retry", "cache retry once", "api_key = 'abc' token:xyz", "  def f():\n  return open(x)\n")], "a string, b string, c string, d string")
    got = row.select(
        text.jaccard(text.words(F.col("a")), text.words(F.col("b"))).alias("j"), text.jaccard(text.words(F.lit("")), text.words(F.col("b"))).alias("z"),
        text.count_words(F.col("a"), text.RISKY_WORDS).alias("n"), text.redacted(F.col("c")).alias("c"), text.shortened(F.col("a"), 5).alias("s"),
        *text.heuristic_summary(F.col("d")), text.severity_rank(F.lit(" Error")).alias("rank"), text.two_levels(F.lit("a/x/y/z")).alias("two"),
        text.is_binary(F.lit(b"ab\x00c")).alias("bin"), text.is_binary(F.lit(b"plain text")).alias("txt"),
    ).first()
    assert got.j == 0.5 and got.z == 0 and got.n == 3 and got.c == "api_key = '***REDACTED***' token:***REDACTED***" and got.s == "retry... [17 more]"
    assert (got.first_line, got.has_return, got.may_throw, got.has_side_effects, got.rank, got.two, got.bin, got.txt) == ("def f():", True, False, True, 3, "x/y", True, False)


DIFF = """mail header
diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,4 @@
 one
-two
+TWO
+more
 three
@@ -10 +11,2 @@ def f
+new
 ten
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/p.png b/p.png
Binary files differ
-- 
2.4"""


def states(spark, *texts):
    rows = [(1, "repo", t, datetime(2025, 1, i + 1), 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "review_id bigint, repo_name string, diff_context string, updated_at timestamp_ntz, line int")


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_diff_lines(spark, newline):
    lines = diffs.diff_lines(diffs.latest_diffs(states(spark, "old", DIFF.replace("\n", newline))))
    got = [(r.path, r.marker, r.content, r.old_line, r.new_line, r.is_modified) for r in lines.orderBy("pos").collect()]
    assert got == [
        ("x.py", " ", "one", 1, 1, False), ("x.py", "-", "two", 2, 2, False), ("x.py", "+", "TWO", 3, 2, True), ("x.py", "+", "more", 3, 3, False), ("x.py", " ", "three", 3, 4, False),
        ("x.py", "+", "new", 10, 11, False), ("x.py", " ", "ten", 10, 12, False), (None, "-", "a", 1, 0, False), (None, "-", "b", 2, 0, False),
    ]
    counts = {(r.file_no, r.n_added, r.n_removed, r.n_modified) for r in diffs.changes_per_file(lines).collect()}
    assert counts == {(1, 3, 1, 1), (2, 0, 2, 0)}


def test_empty_and_missing_diffs(spark):
    assert diffs.diff_lines(diffs.latest_diffs(states(spark, DIFF, None))).count() == 0
    assert diffs.diff_lines(diffs.latest_diffs(states(spark, ""))).count() == 0
    assert diffs.diff_lines(diffs.latest_diffs(states(spark))).count() == 0


def test_anchoring_and_scores(spark):
    lines = diffs.diff_lines(diffs.latest_diffs(states(spark, DIFF))).cache()
    items = spark.createDataFrame([(1, 1, "repo/x.py", 2, 2), (2, 1, "repo/x.py", 17, 40), (3, 1, "repo/x.py", 14, 15), (4, 1, "repo/y.py", 2, 2), (5, 2, "repo/x.py", 2, 2)], "risk_id int, review_id bigint, path string, start int, end int")
    got = {r.risk_id: (r.is_anchored, r.first_line) for r in diffs.near_changes(items, lines).collect()}
    assert got == {1: (True, 2), 2: (False, 0), 3: (True, 11), 4: (False, 0), 5: (False, 0)}
    (score,) = [r for r in diffs.file_scores(lines).collect()]
    assert (score.path, score.api, score.danger, score.strong) == ("x.py", 0, 0, False) and score.score > 0


def test_merged_ranges(spark):
    items = spark.createDataFrame([(1, "p", "t", 1, 4, 0.5), (2, "p", "t", 9, 9, 0.7), (3, "p", "t", 15, 15, 0.1), (4, "p", "u", 9, 9, 0.2)], "risk_id int, path string, risk_type string, start int, end int, confidence double")
    got = {(r.risk_type, r.start, r.end, r.confidence, r.n_items) for r in diffs.merged_ranges(items).collect()}
    assert got == {("t", 1, 9, 0.7, 2), ("t", 15, 15, 0.1, 1), ("u", 9, 9, 0.2, 1)}


def test_store(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", None, "w")], "k string, at int, v string")
    assert {(r.k, r.v) for r in store.last_wins(rows, ["k"], [F.col("at")]).collect()} == {("a", "y"), ("b", "w")}
    assert {(r.k, r.v) for r in store.first_per_group(rows, ["k"], [F.col("at")], 2).collect()} == {("a", "x"), ("a", "z"), ("b", "w")}
    assert {(r.v, r.is_exact) for r in store.names_like(rows, "v", "X").collect()} == {("x", False)}
    assert {(r.v, r.is_exact) for r in store.names_like(rows, "v", "y").collect()} == {("y", True)}
    assert store.names_like(rows, "v", "%").count() == 0
    prints = lambda order: {(r.k, r.n_items, r.fingerprint) for r in store.fingerprint(rows.orderBy(order), ["k"], F.col("v")).collect()}
    assert prints("v") == prints("at") and len(prints("v")) == 2


def test_text_search(spark):
    parsed = spark.createDataFrame(
        [(1, "a.py", bytearray(b"import os\r\nfrom a.b import c\r\ndef f():\r\n  raise X\r\n"), 1), (1, "a.py", bytearray(b"old"), 0), (2, "b.rb", bytearray(b"require 'json'\nclass Q\nend"), 1), (3, "c.ts", bytearray(b"import { x } from \"./y\";\nexport async function go() {}"), 1), (4, "d.py", None, 1), (5, "e.py", bytearray(b""), 1)],
        "file_id bigint, path string, source binary, parsed_at int",
    )
    texts = textsearch.latest_text(parsed)
    assert {(r.file_id, r.line_no, r.line) for r in textsearch.grep(texts, "raise").collect()} == {(1, 4, "  raise X")}
    assert [r.context for r in textsearch.grep_context(texts, "raise").collect()] == ["def f():\n  raise X\n"]
    assert [r.context for r in textsearch.grep_context(texts, "^import os").collect()] == ["import os\nfrom a.b import c"]
    assert {(r.file_id, r.module) for r in textsearch.imports(texts).collect()} == {(1, "os"), (1, "a.b"), (2, "json"), (3, "./y")}
    assert {(r.lang, r.name) for r in textsearch.declarations(texts).collect()} == {("python", "f"), ("ruby", "Q"), ("typescript", "go")}
    docs = spark.createDataFrame([(1, "Lock the cache"), (2, "cache"), (3, None)], "id int, t string")
    assert [r.id for r in textsearch.with_all_terms(docs, "id", "t", ["CACHE", "lock"]).collect()] == [1]


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"


def events(minutes):
    begin = datetime(2025, 1, 1)
    return [(i, begin + timedelta(minutes=m), 1, "signup") for i, m in enumerate(minutes)]


def test_jobs_of_a_table(spark):
    rows = spark.createDataFrame([*events([0, 10, 61]), (9, None, None, "signup"), (8, datetime(2025, 1, 1), 2, "view")], EVENTS)
    assert {r.event_id for r in jobs.first_jobs(jobs.admitted(rows, ["signup"])).collect()} == {0, 2}
    assert {r.event_id for r in jobs.cooled(rows.where("user_id = 1"), 1200).collect()} == {0, 2}


def test_jobs_of_a_stream(spark, tmp_path):
    for part, rows in enumerate([events([0, 5]), [(7, datetime(2025, 1, 1, 0, 1), 1, "signup"), (8, datetime(2025, 1, 1, 3), 2, "view")]]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = jobs.stream_first_jobs(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENTS).schema, ["signup"])
    assert {(r.event_id, r.user_id) for r in got.collect()} == {(0, 1)}


def test_cooldown_state(spark, tmp_path):
    spark.createDataFrame(events([0, 10, 25, 30, 50]), EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    taken = jobs.stream_cooldown(jobs.parquet_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENTS).schema), 1200)
    query = taken.writeStream.format("memory").queryName("taken").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert {r.event_id for r in spark.table("taken").collect()} == {0, 2, 4}


def cooled_brute(rows, seconds):
    last, taken = {}, set()
    for event, at, user, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if user not in last or (at - last[user]).total_seconds() >= seconds:
            taken.add(event)
            last[user] = at
    return taken


def jobs_of_users():
    rnd, begin = random.Random(3), datetime(2025, 1, 1)
    busy = [(k, begin + timedelta(minutes=k * 7), 1, "view") for k in range(700)]  # never pauses, over several days
    others = [(1000 + k, begin + timedelta(minutes=rnd.randrange(6000)), rnd.randrange(2, 6), "view") for k in range(400)]
    rows = busy + others
    rnd.shuffle(rows)
    return rows


def test_cooldown_counts_from_the_last_taken(spark):
    rows = jobs_of_users()
    events = spark.createDataFrame([*rows, (5000, None, 1, "view"), (5001, datetime(2025, 1, 1), None, "view")], EVENTS)
    for seconds, span in ((3600, 86_400), (3600, 1800), (600, 7200), (0, 60)):
        assert {r.event_id for r in jobs.accepted(events, seconds, span).collect()} == cooled_brute(rows, seconds)


def test_cooldown_state_over_arrow_batches(spark, tmp_path):
    rows = jobs_of_users()
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        taken = jobs.stream_cooldown(jobs.parquet_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENTS).schema), 3600)
        query = taken.writeStream.format("memory").queryName("taken_batches").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {r.event_id for r in spark.table("taken_batches").collect()} == cooled_brute(rows, 3600)


def test_latest_text_decides_ties_and_keeps_single_files(spark):
    rows = [(1, 1, "a/x.py", b"old"), (1, 2, "a/x.py", b"new\r\nline"), (1, 2, "a/x.py", b"neu"), (2, None, "a/y.py", b"only"), (3, 1, "a/z.py", None), (None, 1, "a/n.py", b"n")]
    parsed = spark.createDataFrame(rows, "file_id bigint, parsed_at int, path string, source binary")
    assert {r.file_id: r.text for r in textsearch.latest_text(parsed).collect()} == {1: "new\nline", 2: "only"}
    assert textsearch.latest_text(parsed.limit(0)).count() == 0


def test_snippets_equal_brute_force(spark):
    lines = [f"line {k}" for k in range(1, 31)]
    texts = spark.createDataFrame([(1, "a", "\n".join(lines)), (2, "b", "")], "file_id bigint, path string, text string")
    wanted = [("a", 1, 1), ("a", 10, 12), ("a", 10, 12), ("a", 2, 29), ("a", 40, 50), ("b", 1, 3), ("a", 5, 4), (None, 1, 2), ("none", 1, 2), ("a", None, 2)]
    ranges = spark.createDataFrame(wanted, "path string, start int, end int")
    got = {(r.path, r.start, r.end): r.snippet for r in textsearch.snippets(texts, ranges, context=2, max_lines=8).collect()}
    shown = lambda a, b: "\n".join(f"{k}: {lines[k - 1]}" for k in range(a, b + 1))
    assert got == {("a", 1, 1): shown(1, 3), ("a", 10, 12): shown(8, 14), ("a", 2, 29): shown(11, 18), ("a", 40, 50): shown(28, 30), ("b", 1, 3): "1: "}


# --- Paths, JSON, diffs' contexts -----------------------------------------------------------------------------------


def test_default_excludes_and_includes(spark):
    paths = ["a/go.sum", "x/dist/y.js", "dist/y.js", "a/__generated__/b.py", "a/@gen/b.go", "i.PNG", "i.png", "a/b.lock", "src/a.py", "distant/a.py", ".next/x", "a/gen.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    out = {r.p for r in rows.where(text.excluded(F.col("p"))).collect()}
    assert out == {"a/go.sum", "x/dist/y.js", "dist/y.js", "a/__generated__/b.py", "a/@gen/b.go", "i.png", "a/b.lock", ".next/x"}
    kept = {r.p for r in rows.where(text.excluded(F.col("p"), included=["**/dist/**", "*.png"])).collect()}
    assert out - kept == {"x/dist/y.js", "dist/y.js", "i.png"}
    assert not rows.where(text.excluded(F.col("p"), [])).count()


def test_danger_counts(spark):
    cases = {"auth and Token, tokens": 2, "select x from": 1, "selectx": 0, "select": 0, "yaml.load(f)": 1, "feature  flag": 1, "featureflag": 1, "await lock_ lock": 2, "UPDATE\tt": 1}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.count_danger(F.col("v")).alias("n"))
    assert {r.v: r.n for r in rows.collect()} == cases


def test_labels_keys_and_ids(spark):
    rows = spark.createDataFrame([("r/x..y", "b\\c", "k", "p:12-40", 3, 3), (None, "", None, "p:1-x", 3, 9), ("r", "b" * 300, "k", "nothing", 1, 2)], "repo string, branch string, c string, node string, a int, b int")
    got = rows.select(text.asset_key(F.col("repo"), F.col("branch"), F.col("c")).alias("k"), text.byte_range(F.col("node")).alias("r"), text.line_label(F.col("a"), F.col("b")).alias("l")).collect()
    assert [r.k for r in got[:2]] == ["repo_map_r_xy_b_c_k", "repo_map_unknown_repo_unknown_branch_unknown_commit"] and len(got[2].k) == len("repo_map_r_") + 12
    assert [tuple(r.r) for r in got] == [(12, 40), (0, 0), (0, 0)] and [r.l for r in got] == ["3", "3:9", "1:2"]


def test_json_in_text(spark):
    from sparkloom.functions.json_text import extract_json, found_json

    cases = {'x ```json\n{"a": 1}\n``` y': '{"a": 1}', 'say {"a": {"b": 2}} now': '{"a": {"b": 2}}', "{bad} {\"c\": 3}": '{"c": 3}', "none": None, "": None, "```\n[1, 2]\n```": "[1, 2]", "} {\"a\": 1}": None, ' {"a": "}"} ': '{"a": "}"}'}
    assert {k: found_json(k) for k in cases} == cases
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "v string")
    assert {r.v: r.j for r in rows.select("v", extract_json(F.col("v")).alias("j")).collect()} == {**cases, None: None}


def _context_tables(spark):
    states = spark.createDataFrame([(1, "r", DIFF, datetime(2025, 1, 1))], "review_id bigint, repo_name string, diff_context string, updated_at timestamp_ntz")
    rows = diffs.latest_diffs(states)
    return rows, diffs.diff_lines(rows)


def test_context_of_files(spark):
    rows, lines = _context_tables(spark)
    (whole,) = [r.context for r in diffs.context_texts(lines).where("path = 'x.py'").collect()]
    rule = "=" * 80
    assert whole.split("\n") == ["File: x.py", rule, "     1: one", "~    2: TWO", "+    3: more", "     4: three", "+   11: new", "    12: ten", rule]
    (changed,) = [r.context for r in diffs.context_texts(lines, changed_only=True).where("path = 'x.py'").collect()]
    assert changed.split("\n")[2:-1] == ["~    2: TWO", "+    3: more", "+   11: new"]
    places = spark.createDataFrame([(1, "r/x.py", 3), (1, "r/x.py", 1), (1, "r/x.py", 7), (1, "r/none", 1), (2, "r/x.py", 1)], "review_id bigint, path string, line int")
    got = {(r.review_id, r.path, r.line): (r.content, r.is_changed) for r in diffs.line_lookup(places, lines).collect()}
    assert got == {(1, "r/x.py", 3): ("more", True), (1, "r/x.py", 1): ("one", False), (1, "r/x.py", 7): (None, False), (1, "r/none", 1): (None, False), (2, "r/x.py", 1): (None, False)}
    wanted = spark.createDataFrame([(1, "x.py"), (1, "absent.py")], "review_id bigint, path string")
    found = {r.path: r.diff for r in diffs.file_diffs(wanted, rows, lines, fallback=11).collect()}
    assert found == {"x.py": whole, "absent.py": "mail header"}


def test_files_of_a_diff(spark):
    text_ = "diff --git a/o.py b/n.py\nrename from o.py\nrename to n.py\ndiff --git a/gone.py b/gone.py\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n--- a/go.sum\n+++ b/go.sum\n+++ /abs.py\n"
    rows = spark.createDataFrame([(1, "r", text_), (2, "r", "")], "review_id bigint, repo_name string, diff_context string")
    assert {(r.review_id, r.path) for r in diffs.changed_paths(rows).collect()} == {(1, p) for p in ("o.py", "n.py", "gone.py", "abs.py")}


def test_anchors_of_any_range(spark):
    _, lines = _context_tables(spark)
    items = spark.createDataFrame(
        [(1, 1, "r/x.py", 1, 2**31 - 10), (2, 1, "r/x.py", 3, 3), (3, 1, "r/x.py", 20, 30), (4, 1, "r/x.py", 16, 2), (5, 1, "r/y.py", 1, 1), (6, 1, "r/x.py", 9, 9)],
        "risk_id bigint, review_id bigint, path string, start bigint, end bigint",
    )
    near = {r.risk_id: (r.is_anchored, r.first_line) for r in diffs.near_changes(items, lines).collect()}
    assert near == {1: (True, 2), 2: (True, 2), 3: (False, 0), 4: (False, 0), 5: (False, 0), 6: (True, 11)}
    assert {r.risk_id: r.line for r in diffs.snapped_lines(items, lines).collect()} == {1: 2, 2: 3, 3: None, 4: 11, 5: None, 6: 11}


def test_gate_and_places(spark):
    _, lines = _context_tables(spark)
    items = spark.createDataFrame(
        [(1, 1, "r/x.py", "A", 3, 3, 0.5, "error"), (2, 1, "r/x.py", "A", 90, 91, 0.9, "error"), (3, 1, "r/x.py", "S", 90, 91, 0.9, "info"), (4, 1, "r/x.py", None, 3, 3, 0.7, "info"), (5, 1, "r/x.py", "A", 11, 11, 0.9, "warning"), (6, 1, "r/x.py", "A", 90, 91, 0.1, "info")],
        "risk_id bigint, review_id bigint, path string, risk_type string, start bigint, end bigint, confidence double, severity string",
    )
    assert {r.risk_id for r in diffs.anchor_gate(items, lines, "S").collect()} == {1, 3, 4, 5}
    assert {r.risk_id: r.confidence for r in diffs.anchor_gate(items, lines, "S", cap=0.2).collect()} == {1: 0.5, 2: 0.2, 3: 0.9, 4: 0.7, 5: 0.9, 6: 0.1}
    places = diffs.comment_places(items, lines).orderBy("place").collect()
    assert [(r.line, r.severity_rank, r.confidence, r.n_items) for r in places] == [(3, 3, 0.7, 2), (11, 2, 0.9, 1)]


def test_grep_options_and_snippets(spark):
    texts = spark.createDataFrame([(1, "a/x.py", "one (a.b)\nTwo\n"), (2, "a/y.go", "one (a.b)"), (3, "t/x.py", "one (a.b)\none (a,b)")], "file_id int, path string, text string")
    found = lambda *a, **k: {(r.file_id, r.line_no) for r in textsearch.grep(texts, *a, **k).collect()}
    assert found("(a.b)", literal=True) == {(1, 1), (2, 1), (3, 1)} and found("a.b") == {(1, 1), (2, 1), (3, 1), (3, 2)}
    assert found("two", ignore_case=True) == {(1, 2)} and found("two") == set()
    assert found("one", include=["*.py"], exclude=["t/**"]) == {(1, 1)}
    assert [(r.path, r.line_no) for r in textsearch.first_hits(textsearch.grep(texts, "one"), 2).collect()] == [("a/x.py", 1), ("a/y.go", 1)]
    docs = spark.createDataFrame([(1, "a b c d e f The Cache, and the lock g h i j k"), (2, "cache"), (3, None)], "doc_id int, body string")
    assert {r.doc_id: r.snippet for r in textsearch.marked_snippets(docs, "doc_id", "body", ["lock", "cache"], 3).collect()} == {1: "e f The [Cache,] and the [lock]"}
