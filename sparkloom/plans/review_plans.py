"""Diffs and risk items: what the review dataflow asks of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.text import asset_key, line_label, plain_path, severity_rank
from sparkloom.operators import diffs
from sparkloom.operators.latest import latest_rows
from sparkloom.sources.tables import table


def _lines(spark, sf_dir):
    return diffs.diff_lines(diffs.latest_diffs(table(spark, sf_dir, "review_states")))


def _items(spark, sf_dir):
    """Each risk item's latest delivery with a usable range."""
    rows = table(spark, sf_dir, "risk_items").where("line_number.start >= 1 and line_number.start <= line_number.end and file_path is not null and review_id is not null")
    value = F.struct("created_at", "review_id", plain_path(F.col("file_path")).alias("path"), "risk_type", F.col("line_number.start").alias("start"), F.col("line_number.end").alias("end"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("severity", F.lit("warning")).alias("severity"))
    best = rows.groupBy("risk_id").agg(F.max(value).alias("v"))
    return best.select("risk_id", *[F.col(f"v.{c}").alias(c) for c in ("review_id", "path", "risk_type", "start", "end", "confidence", "severity")]).where("not isnan(confidence)")


def d_diff_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("review_id", "file_no", "pos", "marker", "old_line", "new_line", "is_modified")


def d_changes_per_file(spark, sf_dir):
    return diffs.changes_per_file(_lines(spark, sf_dir)).where("path is not null")


def e_file_score(spark, sf_dir):
    return diffs.file_scores(_lines(spark, sf_dir))


def v_anchor_gate(spark, sf_dir):
    return diffs.near_changes(_items(spark, sf_dir), _lines(spark, sf_dir))


def v_merge_ranges(spark, sf_dir):
    return diffs.merged_ranges(_items(spark, sf_dir))


def v_comment_rank(spark, sf_dir):
    """Places by their worst severity and highest confidence: two maxima, each for itself (A4)."""
    rank = severity_rank(F.col("severity"))
    return _items(spark, sf_dir).groupBy("path", "start").agg(F.max(rank).alias("severity_rank"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_items"))


def _diffs(spark, sf_dir):
    return diffs.latest_diffs(table(spark, sf_dir, "review_states"))


def f_files_from_diff(spark, sf_dir):
    return diffs.changed_paths(_diffs(spark, sf_dir))


def d_context_text(spark, sf_dir):
    return diffs.context_texts(_lines(spark, sf_dir))


def d_context_changed(spark, sf_dir):
    return diffs.context_texts(_lines(spark, sf_dir), changed_only=True)


def d_line_lookup(spark, sf_dir):
    places = _items(spark, sf_dir).select("risk_id", "review_id", "path", F.col("start").alias("line"))
    return diffs.line_lookup(places, _lines(spark, sf_dir)).select("risk_id", "content", "is_changed")


def d_file_diff(spark, sf_dir):
    """The diff of every file that a review's latest state names as changed."""
    states = latest_rows(table(spark, sf_dir, "review_states").where("review_id is not null").select("review_id", "updated_at", "diff_context", "repo_name", "changed_files"), "review_id", "updated_at", ["diff_context", "repo_name"])
    paths = states.select("review_id", "repo_name", F.explode("changed_files").alias("full")).where(F.startswith("full", F.concat("repo_name", F.lit("/"))))
    wanted = paths.select("review_id", F.substring("full", F.length("repo_name") + 2, F.lit(1 << 30)).alias("path")).distinct()
    rows = states.select("review_id", "diff_context").where("diff_context is not null")
    return diffs.file_diffs(wanted, rows, _lines(spark, sf_dir))


def v_comment_anchor(spark, sf_dir):
    return diffs.snapped_lines(_items(spark, sf_dir), _lines(spark, sf_dir)).select("risk_id", F.coalesce("line", F.lit(-1)).alias("line"))


def _touching(spark, sf_dir):
    """Items with the last review whose diff touches their file, instead of the review they were written for, and the diffs' lines.

    In the given tables hardly an item lies in a file of its own review's diff.
    """
    lines = _lines(spark, sf_dir)
    touched = lines.where("path is not null").groupBy(F.concat_ws("/", "repo_name", "path").alias("path")).agg(F.max("review_id").alias("review_id"))
    return _items(spark, sf_dir).drop("review_id").join(touched, "path"), lines


def v_gated_items(spark, sf_dir):
    found = diffs.anchor_gate(*_touching(spark, sf_dir), "Syntax_Static_Errors", window=20)
    return found.select("risk_id", "confidence")


def v_capped_items(spark, sf_dir):
    found = diffs.anchor_gate(*_touching(spark, sf_dir), "Syntax_Static_Errors", window=20, cap=0.2)
    return found.select("risk_id", "is_anchored", "confidence")


def v_comment_places(spark, sf_dir):
    return diffs.comment_places(*_touching(spark, sf_dir), fuzz=20)


def v_report(spark, sf_dir):
    items = table(spark, sf_dir, "risk_items").where("line_number.start >= 1 and confidence between 0 and 1 and file_path is not null")
    rows = items.select("risk_id", F.col("file_path").alias("path"), "risk_type", F.col("line_number.start").alias("start"), F.col("line_number.end").alias("end"), "confidence", "severity", "description", "suggestion")
    return diffs.report_lines(rows.where("end is not null"))


def e_line_label(spark, sf_dir):
    rows = table(spark, sf_dir, "risk_items").where("line_number.start is not null and line_number.end is not null")
    return rows.groupBy(line_label(F.col("line_number.start"), F.col("line_number.end")).alias("label")).agg(F.count(F.lit(1)).alias("n_items"))


def e_asset_key(spark, sf_dir):
    rows = table(spark, sf_dir, "revisions")
    return rows.select("rev", asset_key(F.col("repo_name"), F.col("base_rev"), F.col("rev")).alias("asset_key"), asset_key(F.col("repo_name"), F.col("base_rev"), F.col("rev"), 24).alias("short_key"))


QUERIES = {f.__name__: f for f in (
    d_diff_lines, d_changes_per_file, e_file_score, v_anchor_gate, v_merge_ranges, v_comment_rank,
    f_files_from_diff, d_context_text, d_context_changed, d_line_lookup, d_file_diff, v_comment_anchor, v_gated_items, v_capped_items, v_comment_places, v_report, e_line_label, e_asset_key,
)}

_HEAD = "'^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@'"
_API = "regexp_matches(content, '\\b(export|public|def|class|interface|type)\\b', 'i')"
_STRONG = "regexp_matches(content, '\\b(eval|exec|token|secret|permission|acl|authorize|authorization|innerHTML|dangerouslySetInnerHTML)\\b', 'i')"
_DANGER = """len(regexp_extract_all(content, '(?i)\\b(auth|permission|acl|scope|role|token|secret|csrf|oauth|jwt|signature|sql|select\\s|insert\\s|update\\s|delete\\s|deserialize|pickle|yaml\\.load|subprocess|shell|cmd'
   || '|async|await|promise|thread|lock|transaction|retry|queue|task|cron|cache|session|cookie|feature\\s*flag|singleton|global)\\b'))"""
_DIFF = f"""latest AS (SELECT review_id, repo_name, replace(diff_context, chr(13) || chr(10), chr(10)) AS d FROM review_states WHERE review_id IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY updated_at DESC, diff_context DESC NULLS LAST, repo_name DESC) = 1),
raw AS (SELECT review_id, repo_name, unnest(string_split(d, chr(10))) AS line, (generate_subscripts(string_split(d, chr(10)), 1) - 1)::INTEGER AS pos FROM latest WHERE d IS NOT NULL),
told AS (SELECT *, regexp_matches(line, '^diff --(git|cc) ') AS is_head, regexp_matches(line, {_HEAD}) AS is_hunk FROM raw),
cut AS (SELECT *, sum(is_head::INT) OVER w AS file_no, sum((is_head OR is_hunk)::INT) OVER w AS hunk_no FROM told WINDOW w AS (PARTITION BY review_id ORDER BY pos)),
known AS (SELECT *, max(nullif(regexp_extract(line, '^\\+\\+\\+ b/(.*)$', 1), '')) OVER (PARTITION BY review_id, file_no) AS path,
   max(CASE WHEN is_hunk THEN regexp_extract(line, {_HEAD}, 1)::INT END) OVER h AS a, max(CASE WHEN is_hunk THEN coalesce(nullif(regexp_extract(line, {_HEAD}, 2), ''), '1')::INT END) OVER h AS n,
   max(CASE WHEN is_hunk THEN regexp_extract(line, {_HEAD}, 3)::INT END) OVER h AS b, max(CASE WHEN is_hunk THEN coalesce(nullif(regexp_extract(line, {_HEAD}, 4), ''), '1')::INT END) OVER h AS m
   FROM cut WINDOW h AS (PARTITION BY review_id, hunk_no)),
marked AS (SELECT *, CASE WHEN line = '' THEN ' ' ELSE left(line, 1) END AS marker, substr(line, 2) AS content FROM known WHERE a IS NOT NULL AND NOT is_hunk),
numbered AS (SELECT *, (b + coalesce(count(*) FILTER (marker <> '-') OVER p, 0))::INTEGER AS new_line, (a + coalesce(count(*) FILTER (marker <> '+') OVER p, 0))::INTEGER AS old_line FROM marked WHERE marker IN ('+', '-', ' ')
   WINDOW p AS (PARTITION BY review_id, hunk_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
inside AS (SELECT * FROM numbered WHERE CASE WHEN marker = '-' THEN old_line < a + n ELSE new_line < b + m END AND file_no > 0),
lines AS (SELECT *, coalesce(marker = '+' AND lag(marker) OVER w = '-' AND abs(lag(old_line) OVER w - new_line) <= 3, false) AS is_modified FROM inside WINDOW w AS (PARTITION BY review_id, hunk_no ORDER BY pos))"""
_ITEMS = """items AS (SELECT * FROM (SELECT risk_id, review_id, regexp_replace(replace(trim(file_path), '\\', '/'), '^(\\./+|[ab]/|/+)', '') AS path, risk_type, line_number.start AS start, line_number."end" AS "end", created_at,
   coalesce(confidence, 0.5) AS confidence, coalesce(severity, 'warning') AS severity FROM risk_items WHERE line_number.start >= 1 AND line_number.start <= line_number."end" AND file_path IS NOT NULL AND review_id IS NOT NULL)
   QUALIFY row_number() OVER (PARTITION BY risk_id ORDER BY created_at DESC, review_id DESC, path DESC, risk_type DESC, start DESC, "end" DESC, confidence DESC, severity DESC) = 1), good AS (SELECT * FROM items WHERE NOT isnan(confidence))"""
_WEIGHTS = "CASE WHEN regexp_matches(lower(path), '/test|^tests/|_test\\.py$|\\.spec\\.tsx?$') THEN 0.4 WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') THEN 0.2 WHEN regexp_matches(lower(path), '\\.(ya?ml|json|toml|ini|cfg)$') THEN 0.6 ELSE 1.0 END"
_TOUCHING = """changed AS (SELECT DISTINCT review_id, repo_name || '/' || path AS path, new_line FROM lines WHERE marker = '+' AND path IS NOT NULL),
   touched AS (SELECT repo_name || '/' || path AS path, max(review_id) AS review_id FROM lines WHERE path IS NOT NULL GROUP BY 1), placed AS (SELECT g.* EXCLUDE (review_id), t.review_id FROM good g JOIN touched t USING (path))"""
_SHOWN = "printf('%s %4d: %s', CASE WHEN marker = ' ' THEN ' ' WHEN is_modified THEN '~' ELSE '+' END, new_line, regexp_replace(content, '\\r+$', ''))"
_NORMAL = "regexp_replace(replace(trim(path), '\\', '/'), '^(\\./+|[ab]/|/+)', '')"
#: Paths that reviews leave out: by name, by ending, by folder.
_LEFT_OUT = (
    "'(^|/)(package-lock\\.json|pnpm-lock\\.yaml|bun\\.lockb|go\\.(sum|mod))$|\\.(lock|log|exe|dll|so|dylib|class|o|a|wasm|jar|war|zip|tar|gz|bz2|xz|7z|rar|png|jpe?g|gif|bmp|tiff|webm|svg|pdf|docx?|xlsx?|pptx?|ttf|otf|woff2?)$"
    "|(^|/)(dist|build|out|\\.next|\\.nuxt|\\.svelte-kit|\\.cache|coverage|node_modules|([@_]|__)?generated|__generated__|([@_]|__)?gen|__gen__)/.'"
)
SQL = {
    "d_diff_lines": f"WITH {_DIFF} SELECT review_id, file_no::INTEGER AS file_no, pos, marker, old_line, new_line, is_modified FROM lines",
    "d_changes_per_file": f"""WITH {_DIFF} SELECT review_id, file_no::INTEGER AS file_no, path, count(*) FILTER (marker = '+') AS n_added, count(*) FILTER (marker = '-') AS n_removed, count(*) FILTER (is_modified) AS n_modified
        FROM lines WHERE path IS NOT NULL GROUP BY 1, 2, 3""",
    "e_file_score": f"""WITH {_DIFF}, per AS (SELECT review_id, file_no::INTEGER AS file_no, path, count(*) FILTER (marker = '+') AS added, count(*) FILTER (is_modified) AS modified, count(*) FILTER (marker = '+' AND {_API}) AS api,
        sum({_DANGER})::BIGINT AS danger, bool_or({_STRONG}) AS strong FROM lines WHERE path IS NOT NULL GROUP BY 1, 2, 3)
        SELECT review_id, file_no, path, api, danger, strong, round((2 * ln(1 + added + modified) + 0.6 * least(6, api) + 0.9 * least(6, danger) + 4 * strong::INT) * {_WEIGHTS}, 6)::DOUBLE AS score FROM per""",
    "f_files_from_diff": f"""WITH {_DIFF}, named AS (SELECT review_id, CASE WHEN regexp_matches(line, '^rename (from|to) .') THEN regexp_extract(line, '^rename (?:from|to) (.+)$', 1)
          WHEN regexp_matches(line, '^(---|\\+\\+\\+) ') AND trim(substr(line, 5)) <> '/dev/null' THEN regexp_replace(regexp_replace(trim(substr(line, 5)), '^[ab]/', ''), '^/', '') END AS path FROM raw)
        SELECT DISTINCT review_id, path FROM named WHERE path <> '' AND NOT regexp_matches({_NORMAL}, {_LEFT_OUT})""",
    "d_context_text": f"""WITH {_DIFF} SELECT review_id, file_no::INTEGER AS file_no, path, CASE WHEN count(*) FILTER (marker <> '-') > 0 THEN 'File: ' || path || chr(10) || repeat('=', 80) || chr(10) ||
        string_agg({_SHOWN}, chr(10) ORDER BY new_line, pos) FILTER (marker <> '-') || chr(10) || repeat('=', 80) ELSE 'File: ' || path || chr(10) || '(No new content in this file)' || chr(10) END AS context FROM lines WHERE path IS NOT NULL GROUP BY 1, 2, 3""",
    "d_context_changed": f"""WITH {_DIFF} SELECT review_id, file_no::INTEGER AS file_no, path, CASE WHEN count(*) FILTER (marker = '+') > 0 THEN 'File: ' || path || chr(10) || repeat('=', 80) || chr(10) ||
        string_agg({_SHOWN}, chr(10) ORDER BY new_line, pos) FILTER (marker = '+') || chr(10) || repeat('=', 80) ELSE 'File: ' || path || chr(10) || '(No new content in this file)' || chr(10) END AS context FROM lines WHERE path IS NOT NULL GROUP BY 1, 2, 3""",
    "d_line_lookup": f"""WITH {_DIFF}, {_ITEMS}, new AS (SELECT review_id, repo_name || '/' || path AS path, new_line, min(content) AS content, bool_or(marker = '+') AS changed FROM lines WHERE marker <> '-' AND path IS NOT NULL GROUP BY 1, 2, 3)
        SELECT risk_id, content, coalesce(changed, false) AS is_changed FROM good g LEFT JOIN new n ON n.review_id = g.review_id AND n.path = g.path AND n.new_line = g.start""",
    "d_file_diff": f"""WITH {_DIFF}, state AS (SELECT review_id, repo_name, diff_context, changed_files FROM review_states WHERE review_id IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY updated_at DESC, diff_context DESC NULLS LAST, repo_name DESC, changed_files DESC) = 1),
        wanted AS (SELECT DISTINCT review_id, diff_context, substr(f, length(repo_name) + 2) AS path FROM (SELECT *, unnest(changed_files) AS f FROM state) WHERE starts_with(f, repo_name || '/') AND diff_context IS NOT NULL),
        per AS (SELECT review_id, file_no, path, CASE WHEN count(*) FILTER (marker <> '-') > 0 THEN 'File: ' || path || chr(10) || repeat('=', 80) || chr(10) ||
          string_agg({_SHOWN}, chr(10) ORDER BY new_line, pos) FILTER (marker <> '-') || chr(10) || repeat('=', 80) ELSE 'File: ' || path || chr(10) || '(No new content in this file)' || chr(10) END AS context FROM lines WHERE path IS NOT NULL GROUP BY 1, 2, 3),
        ctx AS (SELECT review_id, path, min(context) AS context FROM per GROUP BY 1, 2),
        cuts AS (SELECT review_id, path, diff_context, list_filter(string_split_regex(replace(diff_context, chr(10) || 'diff --git', chr(10) || chr(1) || 'diff --git'), chr(10) || chr(1)), lambda s: starts_with(s, 'diff --git') AND contains(string_split(s, chr(10))[1], path)) AS found FROM wanted)
        SELECT c.review_id, c.path, coalesce(context, found[1], left(diff_context, 3000)) AS diff FROM cuts c LEFT JOIN ctx USING (review_id, path)""",
    "v_comment_anchor": f"""WITH {_DIFF}, {_ITEMS}, changed AS (SELECT DISTINCT review_id, repo_name || '/' || path AS path, new_line FROM lines WHERE marker = '+' AND path IS NOT NULL)
        SELECT risk_id, coalesce(max(CASE WHEN new_line = start THEN new_line END), min(new_line), -1)::INTEGER AS line FROM good g LEFT JOIN changed c ON c.review_id = g.review_id AND c.path = g.path AND new_line BETWEEN start - 5 AND "end" + 5 GROUP BY risk_id""",
    "v_gated_items": f"""WITH {_DIFF}, {_ITEMS}, {_TOUCHING}
        SELECT risk_id, confidence FROM placed g WHERE risk_type = 'Syntax_Static_Errors' OR EXISTS (SELECT 1 FROM changed c WHERE c.review_id = g.review_id AND c.path = g.path AND c.new_line BETWEEN g.start - 20 AND g."end" + 20)""",
    "v_capped_items": f"""WITH {_DIFF}, {_ITEMS}, {_TOUCHING},
        gated AS (SELECT *, coalesce(risk_type = 'Syntax_Static_Errors', false) OR EXISTS (SELECT 1 FROM changed c WHERE c.review_id = g.review_id AND c.path = g.path AND c.new_line BETWEEN g.start - 20 AND g."end" + 20) AS is_anchored FROM placed g)
        SELECT risk_id, is_anchored, CASE WHEN is_anchored THEN confidence ELSE least(confidence, 0.2) END AS confidence FROM gated""",
    "v_comment_places": f"""WITH {_DIFF}, {_ITEMS}, {_TOUCHING},
        put AS (SELECT risk_id, any_value(g.review_id) AS review_id, any_value(g.path) AS path, any_value(confidence) AS confidence, any_value(severity) AS severity, coalesce(max(CASE WHEN new_line = start THEN new_line END), min(new_line)) AS line
          FROM placed g JOIN changed c ON c.review_id = g.review_id AND c.path = g.path AND new_line BETWEEN start - 20 AND "end" + 20 GROUP BY risk_id),
        per AS (SELECT review_id, path, line, max(CASE lower(trim(severity)) WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS severity_rank, max(confidence) AS confidence, count(*) AS n_items FROM put GROUP BY 1, 2, 3)
        SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY severity_rank DESC, confidence DESC, path, line)::INTEGER AS place FROM per""",
    "v_report": """WITH r AS (SELECT * FROM risk_items WHERE line_number.start >= 1 AND confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) AND file_path IS NOT NULL AND line_number."end" IS NOT NULL AND severity IN ('error', 'warning', 'info'))
        SELECT severity, count(*) OVER (PARTITION BY severity) AS n_items, risk_id AS place, '- **' || file_path || ':' || CASE WHEN line_number.start = line_number."end" THEN line_number.start::VARCHAR ELSE line_number.start || ':' || line_number."end" END
        || '** [' || risk_type || '] (confidence: ' || printf('%.2f', confidence) || ')' || chr(10) || '  ' || coalesce(description, '') || CASE WHEN length(suggestion) > 0 THEN chr(10) || '  Suggestion: ' || suggestion ELSE '' END AS line FROM r""",
    "e_line_label": """SELECT CASE WHEN line_number.start = line_number."end" THEN line_number.start::VARCHAR ELSE line_number.start || ':' || line_number."end" END AS label, count(*) AS n_items FROM risk_items
        WHERE line_number.start IS NOT NULL AND line_number."end" IS NOT NULL GROUP BY 1""",
    "e_asset_key": """WITH k AS (SELECT rev, replace(replace(replace(coalesce(nullif(repo_name, ''), 'unknown_repo'), '/', '_'), chr(92), '_'), '..', '') AS repo, replace(coalesce(nullif(base_rev, ''), 'unknown_branch'), '/', '_') AS b, replace(coalesce(nullif(rev, ''), 'unknown_commit'), '/', '_') AS c FROM revisions),
        w AS (SELECT *, 'repo_map_' || repo || '_' || b || '_' || c AS key FROM k)
        SELECT rev, key AS asset_key, CASE WHEN length(key) > 24 THEN 'repo_map_' || repo || '_' || left(md5(key), 12) ELSE key END AS short_key FROM w""",
    "v_anchor_gate": f"""WITH {_DIFF}, {_ITEMS}, changed AS (SELECT DISTINCT review_id, repo_name || '/' || path AS path, new_line FROM lines WHERE marker = '+' AND path IS NOT NULL),
        met AS (SELECT risk_id, min(new_line) AS first_line FROM good g JOIN changed c ON c.review_id = g.review_id AND c.path = g.path AND c.new_line BETWEEN greatest(1, g.start - 5) AND g."end" + 5 GROUP BY risk_id)
        SELECT risk_id, first_line IS NOT NULL AS is_anchored, coalesce(first_line, 0) AS first_line FROM good LEFT JOIN met USING (risk_id)""",
    "v_merge_ranges": f"""WITH {_ITEMS}, begun AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY path, risk_type ORDER BY start, "end", risk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 5 THEN 0 ELSE 1 END AS b FROM good),
        runs AS (SELECT *, sum(b) OVER (PARTITION BY path, risk_type ORDER BY start, "end", risk_id ROWS UNBOUNDED PRECEDING) AS run FROM begun)
        SELECT path, risk_type, min(start) AS start, max("end") AS "end", max(confidence) AS confidence, count(*) AS n_items FROM runs GROUP BY path, risk_type, run""",
    "v_comment_rank": f"WITH {_ITEMS} SELECT path, start, max(CASE lower(trim(severity)) WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS severity_rank, max(confidence) AS confidence, count(*) AS n_items FROM good GROUP BY path, start",
}
