"""Unified diffs as rows and what is asked of them.

A diff's lines are exploded once; files, hunks and line numbers are running sums over a review's lines, so everything
stays in Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sparkloom.operators.latest import latest_rows
from sparkloom.functions.text import API_WORDS, STRONG_WORDS, count_danger, excluded, has_word, line_label, severity_rank, type_weight

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def latest_diffs(states: DataFrame) -> DataFrame:
    """``(review_id, repo_name, diff_context)`` of each review's latest state; only repeated reviews are moved."""
    rows = states.where("review_id is not null").select("review_id", "updated_at", "diff_context", "repo_name")
    best = latest_rows(rows, "review_id", "updated_at", ["diff_context", "repo_name"])
    return best.select("review_id", "repo_name", "diff_context").where("diff_context is not null")


def diff_lines(diffs: DataFrame) -> DataFrame:
    """``(review_id, repo_name, file_no, path, hunk_no, pos, marker, content, old_line, new_line, is_modified)``.

    Lines of hunks only; ``marker`` is ``+``, ``-`` or a blank. An added line is modified when a removed one within three
    lines precedes it immediately (D1). Deleted files have no new side; binary and combined diffs have no hunks.
    """
    lines = diffs.select("review_id", "repo_name", F.posexplode(F.split(F.regexp_replace("diff_context", "\r\n", "\n"), "\n")).alias("pos", "line"))
    review = Window.partitionBy("review_id").orderBy("pos")
    heads = F.col("line").rlike(r"^diff --(?:git|cc) ")
    hunks = F.col("line").rlike(HUNK)
    number = lambda k, default: F.coalesce(F.nullif(F.regexp_extract("line", HUNK, k), F.lit("")).cast("int"), F.lit(default))
    # A file's head also ends the hunk before it.
    lines = (
        lines.withColumn("file_no", F.sum(heads.cast("int")).over(review))
        .withColumn("hunk_no", F.sum((hunks | heads).cast("int")).over(review))
        .withColumn("head", F.when(hunks, F.struct(number(1, 0).alias("a"), number(2, 1).alias("n"), number(3, 0).alias("b"), number(4, 1).alias("m"))))
    )
    hunk = Window.partitionBy("review_id", "hunk_no")
    ordered = hunk.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marker = F.when(F.col("line") == "", " ").otherwise(F.left("line", F.lit(1)))
    file = Window.partitionBy("review_id", "file_no")
    numbered = (
        lines.withColumn("head", F.max("head").over(hunk))
        .withColumn("path", F.max(F.nullif(F.regexp_extract("line", r"^\+\+\+ b/(.*)$", 1), F.lit(""))).over(file))
        .where("head is not null").where(~hunks).withColumn("marker", marker).where(F.col("marker").isin("+", "-", " "))
        .withColumn("new_line", F.col("head.b") + F.coalesce(F.count_if(F.col("marker") != "-").over(ordered), F.lit(0)))
        .withColumn("old_line", F.col("head.a") + F.coalesce(F.count_if(F.col("marker") != "+").over(ordered), F.lit(0)))
    )
    within = F.when(F.col("marker") == "-", F.col("old_line") < F.col("head.a") + F.col("head.n")).otherwise(F.col("new_line") < F.col("head.b") + F.col("head.m"))
    before = hunk.orderBy("pos")
    modified = (F.col("marker") == "+") & (F.lag("marker").over(before) == "-") & (F.abs(F.lag("old_line").over(before) - F.col("new_line")) <= 3)
    kept = numbered.where(within & (F.col("file_no") > 0)).withColumn("is_modified", F.coalesce(modified, F.lit(False)))
    return kept.select(
        "review_id", "repo_name", F.col("file_no").cast("int").alias("file_no"), "path", F.col("hunk_no").cast("int").alias("hunk_no"), "pos", "marker",
        F.substring("line", 2, 1 << 30).alias("content"), F.col("old_line").cast("int").alias("old_line"), F.col("new_line").cast("int").alias("new_line"), "is_modified",
    )


def changes_per_file(lines: DataFrame) -> DataFrame:
    """Added, removed and modified lines of every file in a diff."""
    return lines.groupBy("review_id", "file_no", "path").agg(
        F.count_if(F.col("marker") == "+").alias("n_added"), F.count_if(F.col("marker") == "-").alias("n_removed"), F.count_if("is_modified").alias("n_modified")
    )


def file_scores(lines: DataFrame) -> DataFrame:
    """Score of every changed file (E3-E6): size of the change, public declarations, risky words, weighted by file type."""
    text = F.col("content")
    per_file = lines.where("path is not null").groupBy("review_id", "file_no", "path").agg(
        F.count_if(F.col("marker") == "+").alias("added"), F.count_if("is_modified").alias("modified"),
        F.count_if((F.col("marker") == "+") & has_word(text, API_WORDS)).alias("api"),
        F.sum(count_danger(text).cast("bigint")).alias("danger"), F.max(has_word(text, STRONG_WORDS)).alias("strong"),
    )
    score = (2 * F.log1p(F.col("added") + F.col("modified")) + 0.6 * F.least(F.lit(6), "api") + 0.9 * F.least(F.lit(6), "danger") + 4 * F.col("strong").cast("int")) * type_weight(F.col("path"))
    return per_file.select("review_id", "file_no", "path", "api", "danger", "strong", F.round(score, 6).alias("score"))


def changed_paths(diffs: DataFrame) -> DataFrame:
    """``(review_id, path)``: files that a diff names as old or new, renames and deletions included (F2), once each and
    without those that reviews leave out (F1). Paths are within the repository."""
    lines = diffs.select("review_id", F.explode(F.split(F.regexp_replace("diff_context", "\r\n", "\n"), "\n")).alias("line"))
    named = F.nullif(F.regexp_extract("line", r"^(?:---|\+\+\+) (.*)$", 1), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.when(F.trim(named) != "/dev/null", named)), "^[ab]/", ""), "^/", "")
    renamed = F.nullif(F.regexp_extract("line", r"^rename (?:from|to) (.+)$", 1), F.lit(""))
    path = F.nullif(F.coalesce(renamed, bare), F.lit(""))
    return lines.select("review_id", path.alias("path")).where(F.col("path").isNotNull()).where(~excluded(F.col("path"))).distinct()


def context_texts(lines: DataFrame, changed_only: bool = False) -> DataFrame:
    """``(review_id, file_no, path, context)``: the new side of every file in a diff with line numbers and marks.

    ``~`` marks modified lines, ``+`` other added ones; ``changed_only`` leaves the rest out, ``context`` is then without lines
    where none is changed. One text a file of one diff: never larger than a few times the diff.
    """
    mark = F.when(F.col("marker") == " ", " ").when(F.col("is_modified"), "~").otherwise("+")
    shown = F.format_string("%s %4d: %s", mark, "new_line", F.regexp_replace("content", r"\r+$", ""))
    kept = (F.col("marker") == "+") if changed_only else (F.col("marker") != "-")
    numbered = F.when(kept, F.struct("new_line", "pos", shown.alias("shown")))
    files = lines.where("path is not null").groupBy("review_id", "file_no", "path").agg(F.array_sort(F.collect_list(numbered)).alias("lines"))
    head, rule = F.concat(F.lit("File: "), F.col("path")), F.lit("=" * 80)
    full = F.concat_ws("\n", head, rule, F.array_join("lines.shown", "\n"), rule)
    empty = F.concat(head, F.lit("\n(No new content in this file)\n"))
    return files.select("review_id", "file_no", "path", F.when(F.size("lines") > 0, full).otherwise(empty).alias("context"))


def line_lookup(places: DataFrame, lines: DataFrame) -> DataFrame:
    """``places`` (``review_id``, ``path``, ``line``) with ``content`` and ``is_changed`` of the new file's line (D5), null and
    false where the diff does not show it. Diffs name paths within their repository."""
    new = lines.where("marker <> '-' and path is not null").select("review_id", F.concat_ws("/", "repo_name", "path").alias("path"), F.col("new_line").alias("line"), "content", F.col("marker").alias("_m"))
    new = new.groupBy("review_id", "path", "line").agg(F.min("content").alias("content"), F.max(F.col("_m") == "+").alias("is_changed"))
    return places.join(new, ["review_id", "path", "line"], "left").withColumn("is_changed", F.coalesce("is_changed", F.lit(False)))


def file_diffs(wanted: DataFrame, diffs: DataFrame, lines: DataFrame, fallback: int = 3000) -> DataFrame:
    """``wanted`` (``review_id``, ``path`` within the repository) with ``diff``: the file's context text, else its raw section,
    else the diff's first ``fallback`` characters (D6)."""
    contexts = context_texts(lines).groupBy("review_id", "path").agg(F.min("context").alias("context"))
    rows = wanted.join(contexts, ["review_id", "path"], "left").join(diffs.select("review_id", "diff_context"), "review_id")
    # Sections begin with ``diff --git``; the first that names the path counts.
    sections = F.filter(F.split("diff_context", "\n(?=diff --git)"), lambda s: F.startswith(s, F.lit("diff --git")) & F.contains(F.substring_index(s, "\n", 1), F.col("path")))
    return rows.select("review_id", "path", F.coalesce("context", F.try_element_at(sections, F.lit(1)), F.left("diff_context", F.lit(fallback))).alias("diff"))


def _lines_of_files(lines: DataFrame) -> DataFrame:
    """``(review_id, path, changed)``: the sorted added lines of every file in a diff. No more than the diff has lines."""
    changed = lines.where("marker = '+' and path is not null").select("review_id", F.concat_ws("/", "repo_name", "path").alias("path"), "new_line")
    return changed.groupBy("review_id", "path").agg(F.array_sort(F.collect_set("new_line")).alias("changed"))


def near_changes(items: DataFrame, lines: DataFrame, window: int = 5) -> DataFrame:
    """``(risk_id, is_anchored, first_line)`` for items ``(risk_id, review_id, path, start, end)``: whether an added line of
    the review lies within ``window`` lines of the item's range, and the first such line (V2, J6).

    The range join is an equality join on the file with its sorted lines: ranges may be of any length, and however many
    items a file has, they are not paired with lines.
    """
    low, high = F.col("start") - window, F.col("end") + window
    rows = items.select("risk_id", "review_id", "path", "start", "end").join(_lines_of_files(lines), ["review_id", "path"], "left")
    first = F.try_element_at(F.filter("changed", lambda line: (line >= low) & (line <= high)), F.lit(1))
    return rows.select("risk_id", first.isNotNull().alias("is_anchored"), F.coalesce(first, F.lit(0)).alias("first_line"))


def snapped_lines(items: DataFrame, lines: DataFrame, fuzz: int = 5) -> DataFrame:
    """``(risk_id, line)``: the added line that a comment on the item goes to (J8): the range's start, else the first within
    ``fuzz`` lines of the range, else none."""
    rows = items.select("risk_id", "review_id", "path", "start", F.greatest("start", "end").alias("end")).join(_lines_of_files(lines), ["review_id", "path"], "left")
    near = F.try_element_at(F.filter("changed", lambda line: (line >= F.col("start") - fuzz) & (line <= F.col("end") + fuzz)), F.lit(1))
    return rows.select("risk_id", F.when(F.array_contains("changed", F.col("start")), F.col("start")).otherwise(near).alias("line"))


def anchor_gate(items: DataFrame, lines: DataFrame, kept_type: str, window: int = 5, cap: float | None = None) -> DataFrame:
    """Items near an added line, and those of ``kept_type`` wherever they are (V2). Others are dropped, or with ``cap`` kept with a
    confidence of at most that."""
    near = near_changes(items, lines, window).select("risk_id", "is_anchored")
    rows = items.join(near, "risk_id").withColumn("is_anchored", F.col("is_anchored") | F.coalesce(F.col("risk_type") == kept_type, F.lit(False)))
    if cap is None:
        return rows.where("is_anchored")
    return rows.withColumn("confidence", F.when(F.col("is_anchored"), F.col("confidence")).otherwise(F.least("confidence", F.lit(cap))))


def comment_places(items: DataFrame, lines: DataFrame, fuzz: int = 5) -> DataFrame:
    """``(review_id, path, line, severity_rank, confidence, n_items, place)``: lines of a diff that get a comment, in the order of their
    worst severity, then highest confidence, path and line within a review (V14, A4). Items without such a line have none.
    """
    snapped = snapped_lines(items, lines, fuzz).where("line is not null")
    rows = items.select("risk_id", "review_id", "path", severity_rank(F.col("severity")).alias("rank"), "confidence").join(snapped, "risk_id")
    places = rows.groupBy("review_id", "path", "line").agg(F.max("rank").alias("severity_rank"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_items"))
    order = Window.partitionBy("review_id").orderBy(F.col("severity_rank").desc(), F.col("confidence").desc(), "path", "line")
    return places.withColumn("place", F.row_number().over(order))


def merged_ranges(items: DataFrame, window: int = 5) -> DataFrame:
    """Ranges of the same path and type that overlap or lie within ``window`` lines, merged (the interval part of V3).

    Items that start on one line are aggregated first, so that what is put in order for a path are lines, however many items it has.
    """
    keys = ["path", "risk_type"]
    starts = items.groupBy(*keys, "start").agg(F.max("end").alias("end"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_items"))
    group = Window.partitionBy(*keys).orderBy("start")
    reach = F.max("end").over(group.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("start") - reach <= window, 0).otherwise(1)
    numbered = starts.withColumn("begins", begins).withColumn("run", F.sum("begins").over(group))
    return numbered.groupBy(*keys, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"), F.sum("n_items").alias("n_items")
    ).drop("run")


def report_lines(items: DataFrame) -> DataFrame:
    """``(severity, n_items, place, line)``: items as the lines of a report, by severity (V13); ``place`` orders them within it.

    Items ``(risk_id, path, risk_type, start, end, confidence, severity, description, suggestion)``; other severities have no place in
    a report. Rows, not one text: a report of any size is written in order of (rank, place).
    """
    ranked = items.where(F.col("severity").isin("error", "warning", "info"))
    text = F.concat(
        F.lit("- **"), F.col("path"), F.lit(":"), line_label(F.col("start"), F.col("end")), F.lit("** ["), F.col("risk_type"), F.lit("] (confidence: "), F.format_string("%.2f", "confidence"), F.lit(")\n  "),
        F.coalesce("description", F.lit("")), F.when(F.length("suggestion") > 0, F.concat(F.lit("\n  Suggestion: "), F.col("suggestion"))).otherwise(""),
    )
    counts = ranked.groupBy("severity").agg(F.count(F.lit(1)).alias("n_items"))
    return ranked.join(F.broadcast(counts), "severity").select("severity", "n_items", F.col("risk_id").alias("place"), text.alias("line"))  # three rows at most
