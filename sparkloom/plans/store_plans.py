"""Relational lookups, text search and streaming on the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.text import excluded, heuristic_summary, jaccard, language, redacted, shortened, two_levels, type_weight, words
from sparkloom.operators import exports, import_specs, imports, store, textsearch
from sparkloom.operators.ranges import running_sum, sliding_count
from sparkloom.operators.snapshots import normal_hash
from sparkloom.operators.traverse import Graph, reach
from sparkloom.functions.json_text import extract_json
from sparkloom.sources import lint
from sparkloom.sources.scan import read_texts
from sparkloom.sources.shared import written
from sparkloom.plans.review_plans import _LEFT_OUT
from sparkloom.sources.tables import table
from sparkloom.streaming import jobs

def r_latest_rev(spark, sf_dir):
    return store.latest_rev(table(spark, sf_dir, "revisions"), table(spark, sf_dir, "file_versions"))


def r_files_at_latest(spark, sf_dir):
    revs = r_latest_rev(spark, sf_dir)
    at = store.versions_at(table(spark, sf_dir, "file_versions"), revs)
    return at.join(table(spark, sf_dir, "files").select("file_id", "path"), "file_id").select("rev", "path", "hash")


def r_file_exists(spark, sf_dir):
    versions = table(spark, sf_dir, "file_versions")
    return table(spark, sf_dir, "files").join(versions.where("size > 0").select("file_id"), "file_id", "left_semi").select("file_id", "path")


def r_rev_scoped_edges(spark, sf_dir):
    revisions = table(spark, sf_dir, "revisions")
    known = revisions.select(F.col("rev").alias("base_rev"), F.col("repo_name").alias("base_repo"))
    edges = revisions.join(known, "base_rev").where("repo_name = base_repo")
    return edges.select("repo_name", F.col("base_rev").alias("src"), F.col("rev").alias("dst"))


def r_paths_ending_with(spark, sf_dir):
    return table(spark, sf_dir, "files").where(F.col("path").ilike("%\\_ledger.py")).select("file_id", "path")


def r_node_locations(spark, sf_dir):
    items = table(spark, sf_dir, "risk_items").select("risk_id", "file_path", F.col("line_number.start").alias("line")).distinct()
    files = table(spark, sf_dir, "files").select(F.col("path").alias("file_path"), "file_id")
    return items.join(files, "file_path", "left").select("risk_id", F.coalesce("file_id", F.lit(-1)).alias("file_id"), "line")


def r_symbol_search_exact(spark, sf_dir):
    return store.names_like(table(spark, sf_dir, "part"), "p_name", "small ring").select("p_partkey", "p_name", "is_exact")


def r_symbol_search_like(spark, sf_dir):
    return store.names_like(table(spark, sf_dir, "part"), "p_name", "SMALL").select("p_partkey", "p_name", "is_exact")


def r_limit_per_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return store.first_per_group(lines, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey")], 3)


def r_upsert_last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return store.last_wins(events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


def r_stats(spark, sf_dir):
    names = ["files", "revisions", "file_versions", "parsed_files", "risk_items", "documents", "events"]
    counts = [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    first, *rest = counts
    for c in rest:
        first = first.unionByName(c)
    return first


def r_counts_per_blob(spark, sf_dir):
    rows = table(spark, sf_dir, "file_versions").select(normal_hash(F.col("blob_hash")).alias("hash"), "file_id").where("hash is not null")
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n_versions"), F.count_distinct("file_id").alias("n_files"))


def i_content_hash_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


def i_fingerprint(spark, sf_dir):
    return store.fingerprint(table(spark, sf_dir, "documents"), ["source"], F.col("text"))


def i_new_content(spark, sf_dir):
    hashed = table(spark, sf_dir, "file_versions").select("rev", normal_hash(F.col("blob_hash")).alias("hash")).where("hash is not null")
    revs = r_latest_rev(spark, sf_dir).select("rev")
    return store.new_content(hashed.join(revs, "rev", "left_semi"), hashed.join(revs, "rev", "left_anti"))


def f_path_filter(spark, sf_dir):
    files = table(spark, sf_dir, "files")
    return files.select("file_id", "path", excluded(F.col("path")).alias("is_excluded"))


def f_lang_by_ext(spark, sf_dir):
    lang = F.coalesce(language(F.col("path")), F.lit("other"))
    return table(spark, sf_dir, "files").groupBy("repo_name", lang.alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


def f_two_levels(spark, sf_dir):
    path = F.col("path")
    return table(spark, sf_dir, "files").groupBy(two_levels(path).alias("directory"), type_weight(path).alias("weight")).agg(F.count(F.lit(1)).alias("n_files"))


def f_grep_literal(spark, sf_dir):
    return textsearch.grep(textsearch.latest_text(table(spark, sf_dir, "parsed_files")), r"\bcatch\b|except ").select("file_id", "line_no", "line")


def f_grep_context(spark, sf_dir):
    return textsearch.grep_context(textsearch.latest_text(table(spark, sf_dir, "parsed_files")), r"raise ").select("file_id", "line_no", "context")


def f_fts_all_terms(spark, sf_dir):
    return textsearch.with_all_terms(table(spark, sf_dir, "documents"), "doc_id", "text", ["cache", "Lock", "orchard"])


def f_imports(spark, sf_dir):
    return textsearch.imports(textsearch.latest_text(table(spark, sf_dir, "parsed_files")))


def f_imports_all(spark, sf_dir):
    found = import_specs.import_specs(textsearch.latest_text(table(spark, sf_dir, "parsed_files")))
    return found.select("file_id", "line_no", "module")


def f_declarations(spark, sf_dir):
    return textsearch.declarations(textsearch.latest_text(table(spark, sf_dir, "parsed_files"))).drop("line")


def f_redacted(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.sha2(redacted(F.col("text")), 256).alias("redacted_hash"))


def e_heuristic_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", *heuristic_summary(F.col("text")))


def e_jaccard(spark, sf_dir):
    a, b = words(F.col("description")), words(F.col("suggestion"))
    rows = table(spark, sf_dir, "risk_items").where("description is not null and suggestion is not null")
    return rows.select("risk_id", "created_at", F.round(jaccard(a, b), 6).alias("similarity"))


def v_group_tasks(spark, sf_dir):
    from sparkloom.functions.text import severity_rank

    rank = F.coalesce(severity_rank(F.col("severity")), F.lit(1))
    return table(spark, sf_dir, "risk_items").groupBy("risk_type", rank.alias("severity_rank")).agg(F.count(F.lit(1)).alias("n_items"))


def v_tool_stats(spark, sf_dir):
    per_user = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return per_user.groupBy("n_events").agg(F.count(F.lit(1)).alias("n_users"))


def v_loop_no_signal(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counted = sliding_count(events, ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", 10, "n_errors")
    return counted.where("n_errors >= 5").select("user_id", "event_id", "n_errors")


def v_tool_totals(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.sum(cents).alias("sum_cents"), F.max(cents).alias("max_cents"), F.round(F.sum(cents) / F.count(cents), 6).alias("mean_cents")
    )


def e_shortened(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", shortened(F.col("text"), 200).alias("shown"))


def v_history_budget(spark, sf_dir):
    cents = F.coalesce(F.round(F.col("value") * 100), F.lit(0)).cast("bigint")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", cents.alias("cents"))
    spent = running_sum(rows, ["user_id"], F.to_date("ts"), [F.col("ts").desc(), F.col("event_id").desc()], "cents", "spent", newest_first=True)
    return spent.where("spent <= 50000").select("user_id", "event_id", "spent")


def w_job_dedupe(spark, sf_dir):
    kinds = ["purchase", "signup", "error"]
    return jobs.stream_first_jobs(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema, kinds)


def w_cooldown(spark, sf_dir):
    return jobs.cooled(table(spark, sf_dir, "events"), 3600).select("event_id", "user_id")


def w_cooldown_stream(spark, sf_dir):
    """The same as ``w_cooldown_state`` from a stream of the events' files."""
    return jobs.stream_accepted(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema, 3600)


def w_cooldown_state(spark, sf_dir):
    return jobs.accepted(table(spark, sf_dir, "events"), 3600)


def _linted(spark, sf_dir):
    """Output of linters as the tools write it, one a message, built from the events."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    path = lambda end: F.concat(F.lit("/r/u"), F.col("user_id").cast("string"), F.lit(end))
    code = F.when(F.col("k") < 20, "E1").when(F.col("k") < 40, "W2").when(F.col("k") < 60, "UP3").otherwise("N4")
    one = F.struct(path(".py").alias("filename"), F.col("event_type").alias("message"), F.to_json(F.struct(code.alias("name"))).alias("code"), F.struct("k", F.lit(1).alias("column")).cast("struct<row:int,column:int>").alias("location"))
    level = F.when(F.col("k") < 50, "error").otherwise("warning")
    many = F.struct(F.array(F.struct(level.alias("severity"), F.lit("lint/x").alias("category"), F.to_json(F.struct(F.col("event_type").alias("text"))).alias("message"), F.struct(path(".ts").alias("path"), F.col("k").alias("line")).alias("location"))).alias("diagnostics"))
    vet = F.concat(path(".go"), F.lit(":"), F.col("k").cast("string"), F.lit(":2: Printf "), F.col("event_type"))
    pmd = F.struct(F.array(F.struct(path(".java").alias("filename"), F.array(F.struct(F.col("k").alias("beginline"), F.col("event_type").alias("description"), F.lit("R").alias("rule"), (F.col("k") % 5 + 1).alias("priority"))).alias("violations"))).alias("files"))
    kind = F.col("event_type")
    tool = F.when(kind == "error", "ruff").when(kind == "view", "biome").when(kind == "click", "go_vet").otherwise("pmd")
    output = F.when(tool == "ruff", F.to_json(F.array(one))).when(tool == "biome", F.to_json(many)).when(tool == "go_vet", vet).otherwise(F.to_json(pmd))
    return events.where("k is not null and user_id is not null").select(tool.alias("tool"), output.alias("output"))


def l_lint_norm(spark, sf_dir):
    found = lint.all_findings(_linted(spark, sf_dir), "/r")
    return found.groupBy("tool", "file", "severity", "code").agg(F.count(F.lit(1)).alias("n_messages"), F.sum("line").alias("sum_lines"))


def l_checkers(spark, sf_dir):
    return lint.checkers_of(table(spark, sf_dir, "files").select("file_id", "path")).groupBy("checker").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"))


def r_required_revs(spark, sf_dir):
    revisions = table(spark, sf_dir, "revisions")
    return store.required_revs(revisions, revisions, table(spark, sf_dir, "file_versions"))


def r_file_ids(spark, sf_dir):
    paths = table(spark, sf_dir, "risk_items").select("risk_id", F.col("file_path").alias("path")).where("path is not null").distinct()
    return store.file_ids(paths, table(spark, sf_dir, "files")).select("risk_id", "path", F.coalesce("file_id", F.lit(-1)).alias("file_id"))


def _symbols(spark, sf_dir):
    return textsearch.declarations(textsearch.latest_text(table(spark, sf_dir, "parsed_files"))).drop("line", "lang")


def _latest_versions(spark, sf_dir):
    return store.versions_at(table(spark, sf_dir, "file_versions"), r_latest_rev(spark, sf_dir))


def r_symbol_locations(spark, sf_dir):
    return store.symbol_locations(_symbols(spark, sf_dir), _latest_versions(spark, sf_dir), table(spark, sf_dir, "files"))


def r_repo_map_files(spark, sf_dir):
    return store.repo_map_files(_latest_versions(spark, sf_dir), table(spark, sf_dir, "files"), _symbols(spark, sf_dir))


def r_repo_map_symbols(spark, sf_dir):
    return store.repo_map_symbols(_symbols(spark, sf_dir), table(spark, sf_dir, "files"), 20)


def r_greatest_content(spark, sf_dir):
    versions = table(spark, sf_dir, "file_versions").select("file_id", normal_hash(F.col("blob_hash")).alias("hash"))
    return store.greatest_content(versions, table(spark, sf_dir, "files"))


def r_paths_containing(spark, sf_dir):
    return store.paths_containing(table(spark, sf_dir, "files"), "Ledger").select("file_id", "path")


def s_read_files(spark, sf_dir):
    return read_texts(textsearch.latest_text(table(spark, sf_dir, "parsed_files")), max_lines=20)


def f_extract_json(spark, sf_dir):
    """JSON found in texts that hold an event's properties in one of the usual ways."""
    rows = table(spark, sf_dir, "events").where("props is not null")
    way, fence = F.col("event_id") % 3, F.lit("```")
    said = F.when(way == 0, F.concat(F.lit("So {that} is "), fence, F.lit("json\n"), F.col("props"), F.lit("\n"), fence)).when(way == 1, F.concat(F.lit("{no} "), F.col("props"), F.lit(" and {more"))).otherwise(F.concat(F.lit(" "), F.col("props"), F.lit("\n")))
    return rows.select("event_id", extract_json(said).alias("found"))


def f_snippets(spark, sf_dir):
    return textsearch.marked_snippets(table(spark, sf_dir, "documents"), "doc_id", "text", ["cache", "lock"], 5)


def q_resolved_imports(spark, sf_dir):
    return imports.resolved_imports(textsearch.latest_text(table(spark, sf_dir, "parsed_files")), table(spark, sf_dir, "files"))


def q_resolved_imports_all(spark, sf_dir):
    found = import_specs.import_specs(textsearch.latest_text(table(spark, sf_dir, "parsed_files")))
    return import_specs.resolved_specs(written(found, "specs"), table(spark, sf_dir, "files"))


def _specs(spark, sf_dir):
    texts, files = textsearch.latest_text(table(spark, sf_dir, "parsed_files")), table(spark, sf_dir, "files")
    specs = written(import_specs.import_specs(texts), "specs")
    return texts, files, specs, written(import_specs.resolved_specs(specs, files), "resolved")


def q_module_exports(spark, sf_dir):
    return exports.module_exports(textsearch.latest_text(table(spark, sf_dir, "parsed_files")), table(spark, sf_dir, "files"))


def q_checked_imports(spark, sf_dir):
    texts, files, specs, resolved = _specs(spark, sf_dir)
    return exports.checked_names(exports.name_rows(specs, resolved, texts, files), exports.module_exports(texts, files))


def q_go_packages(spark, sf_dir):
    texts, files, specs, resolved = _specs(spark, sf_dir)
    return exports.go_exports(specs, resolved, exports.module_exports(texts, files))


def q_signatures(spark, sf_dir):
    return imports.signatures(textsearch.latest_text(table(spark, sf_dir, "parsed_files")))


def q_dependency_closure(spark, sf_dir):
    """Files that the files changed in reviews need, over up to five imports."""
    files = table(spark, sf_dir, "files")
    return _closure(spark, sf_dir, imports.resolved_imports(textsearch.latest_text(table(spark, sf_dir, "parsed_files")), files))


def q_dependency_closure_all(spark, sf_dir):
    return _closure(spark, sf_dir, q_resolved_imports_all(spark, sf_dir))


def _closure(spark, sf_dir, resolved):
    files = table(spark, sf_dir, "files")
    changed = table(spark, sf_dir, "review_states").select(F.explode("changed_files").alias("path")).distinct()
    starts = files.join(changed, "path").select(F.col("file_id").cast("string").alias("node"))
    found = reach(Graph(imports.dependency_edges(resolved)), starts, 5, together=True)
    return found.select(F.col("node").cast("bigint").alias("file_id"), "depth")


def s_snippets(spark, sf_dir):
    items = table(spark, sf_dir, "risk_items")
    ranges = items.select(F.col("file_path").alias("path"), F.col("line_number.start").alias("start"), F.col("line_number.end").alias("end"))
    return textsearch.snippets(textsearch.latest_text(table(spark, sf_dir, "parsed_files")), ranges, context=3, max_lines=40)


def s_directory_map(spark, sf_dir):
    return imports.directory_map(table(spark, sf_dir, "files"))


QUERIES = {f.__name__: f for f in (
    q_resolved_imports, q_dependency_closure, q_signatures, s_directory_map, s_snippets,
    r_latest_rev, r_files_at_latest, r_file_exists, r_rev_scoped_edges, r_paths_ending_with, r_node_locations, r_symbol_search_exact, r_symbol_search_like, r_limit_per_group,
    r_upsert_last_wins, r_stats, r_counts_per_blob, i_content_hash_dedup, i_fingerprint, i_new_content, f_path_filter, f_lang_by_ext, f_two_levels, f_grep_literal, f_grep_context, f_fts_all_terms,
    f_imports, f_imports_all, q_resolved_imports_all, q_dependency_closure_all, f_declarations, f_redacted, e_heuristic_summary, e_jaccard, v_group_tasks, v_tool_stats, v_loop_no_signal, v_history_budget, w_job_dedupe, w_cooldown, w_cooldown_state, w_cooldown_stream, l_lint_norm,
    l_checkers, r_required_revs, r_file_ids, r_symbol_locations, r_repo_map_files, r_repo_map_symbols, r_greatest_content, r_paths_containing, s_read_files, f_extract_json, f_snippets,
    q_module_exports, q_checked_imports, q_go_packages, v_tool_totals, e_shortened,
)}

_HASH = "nullif(regexp_replace(lower(trim(blob_hash)), '^sha256:\\s*', ''), '')"
_LATEST = "latest AS (SELECT repo_name, arg_max(rev, (created_at, rev)) AS rev FROM revisions WHERE rev IN (SELECT rev FROM file_versions) GROUP BY repo_name)"
_TEXTS = "texts AS (SELECT file_id, path, replace(decode(source), chr(13) || chr(10), chr(10)) AS text FROM parsed_files WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY parsed_at DESC, path DESC, source DESC) = 1)"
_LINES = _TEXTS + """, lines AS (SELECT file_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no,
 CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'typescript' WHEN 'jsx' THEN 'typescript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'rb' THEN 'ruby' END AS lang FROM texts)"""
_NORMAL = "regexp_replace(replace(trim(path), '\\', '/'), '^(\\./+|[ab]/|/+)', '')"
_WEIGHT = f"""CASE WHEN regexp_matches(lower({_NORMAL}), '/test|^tests/|_test\\.py$|\\.spec\\.tsx?$') THEN 0.4 WHEN regexp_matches(lower({_NORMAL}), '\\.(md|rst|txt)$') THEN 0.2
 WHEN regexp_matches(lower({_NORMAL}), '\\.(ya?ml|json|toml|ini|cfg)$') THEN 0.6 ELSE 1.0 END"""


def _word(listed: str) -> str:
    return f"regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])(?:{listed})(?:[^A-Za-z0-9_]|$)')"


def _by_language(patterns: dict[str, str], two: bool) -> str:
    group = lambda p, k: "regexp_extract(line, '" + p.replace("'", "''") + f"', {k})"
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN nullif({group(p, 1)}{' || ' + group(p, 2) if two else ''}, '')" for k, p in patterns.items()) + " END"


_SET = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"
_EVEN = "regexp_replace(regexp_replace(regexp_replace({}, '/\\./', '/', 'g'), '[^/]+/\\.\\./', '', 'g'), '[^/]+/\\.\\./', '', 'g')"
_IMPORTED = f"""{_LINES}, imported AS (SELECT * FROM (SELECT file_id, line_no, lang, {_by_language(textsearch.IMPORTS, True)} AS module FROM lines) WHERE module IS NOT NULL),
 found AS (SELECT i.file_id, i.line_no, i.module, f.repo_name, CASE lower(regexp_extract(f.path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'rb' THEN 'ruby' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' ELSE 'typescript' END AS lang,
   regexp_replace(f.path, '/[^/]*$', '') AS beside, replace(i.module, '.', '/') AS dotted FROM imported i JOIN files f USING (file_id)),
 tried AS (SELECT file_id, line_no, module, unnest(CASE lang WHEN 'python' THEN [repo_name || '/' || dotted || '.py', repo_name || '/' || dotted || '/__init__.py', beside || '/' || dotted || '.py', beside || '/' || dotted || '/__init__.py']
   WHEN 'ruby' THEN [beside || '/' || module || '.rb', repo_name || '/' || module || '.rb']
   WHEN 'typescript' THEN CASE WHEN starts_with(module, '.') THEN list_transform(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.js'], lambda e: beside || '/' || module || e) ELSE [] END ELSE [] END) AS path FROM found),
 met AS (SELECT t.file_id, t.line_no, t.module, f.file_id AS target_id FROM tried t JOIN files f ON f.path = {_EVEN.format('t.path')}
   UNION ALL SELECT j.file_id, j.line_no, j.module, f.file_id FROM found j JOIN files f ON f.repo_name = j.repo_name AND ends_with(f.path, '/' || j.dotted || '.java') WHERE j.lang = 'java')"""
SQL = {
    "q_resolved_imports": f"WITH {_IMPORTED} SELECT file_id, line_no, module, coalesce(min(target_id), -1) AS target_id FROM (SELECT DISTINCT file_id, line_no, module FROM found) LEFT JOIN met USING (file_id, line_no, module) GROUP BY ALL",
    "q_dependency_closure": f"""WITH RECURSIVE {_IMPORTED}, edges AS (SELECT DISTINCT file_id AS src, target AS dst FROM (SELECT file_id, line_no, module, min(target_id) AS target FROM met GROUP BY ALL) WHERE target <> file_id),
        reached(node, depth) AS (SELECT file_id, 0 FROM files WHERE path IN (SELECT unnest(changed_files) FROM review_states) UNION SELECT dst, depth + 1 FROM reached JOIN edges ON src = node WHERE depth < 5)
        SELECT node AS file_id, min(depth)::INTEGER AS depth FROM reached GROUP BY node""",
    "s_snippets": f"""WITH {_TEXTS}, wanted AS (SELECT DISTINCT file_path AS path, line_number.start AS "start", line_number.end AS "end" FROM risk_items WHERE file_path IS NOT NULL AND line_number.start <= line_number.end),
        cut AS (SELECT path, "start", "end", string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n, least(greatest("start", 1), n) AS a, least(greatest("end", 1), n) AS b FROM texts JOIN wanted USING (path)),
        whole AS (SELECT *, greatest(a - 3, 1) AS low, least(b + 3, n) AS high, greatest((a + b) // 2 - 20, 1) AS narrow FROM cut),
        fit AS (SELECT path, "start", "end", lines, CASE WHEN high - low + 1 > 40 THEN narrow ELSE low END AS low, CASE WHEN high - low + 1 > 40 THEN least(narrow + 39, n) ELSE high END AS high FROM whole)
        SELECT path, "start", "end", array_to_string(list_transform(range(low, high + 1), lambda k: k::VARCHAR || ': ' || lines[k]), chr(10)) AS snippet FROM fit""",
    "q_signatures": f"WITH {_LINES}, named AS (SELECT file_id, line_no, trim(line, ' ') AS signature, {_by_language(textsearch.DECLARATIONS, False)} AS name FROM lines) SELECT name, file_id, line_no, signature FROM named WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_id, line_no) <= 5",
    "s_directory_map": "SELECT repo_name, array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS directory, count(*) AS n_files FROM files, range(1, 11) r(k) WHERE k < len(string_split(path, '/')) GROUP BY ALL",
    "r_latest_rev": f"WITH {_LATEST} SELECT repo_name, rev FROM latest",
    "r_files_at_latest": f"""WITH {_LATEST} SELECT rev, path, hash FROM (SELECT rev, file_id, {_HASH} AS hash, loaded_at FROM file_versions WHERE rev IN (SELECT rev FROM latest) AND {_HASH} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY rev, file_id ORDER BY loaded_at DESC, hash DESC) = 1) JOIN files USING (file_id)""",
    "r_file_exists": "SELECT file_id, path FROM files WHERE file_id IN (SELECT file_id FROM file_versions WHERE size > 0)",
    "r_rev_scoped_edges": "SELECT r.repo_name, r.base_rev AS src, r.rev AS dst FROM revisions r JOIN revisions b ON b.rev = r.base_rev AND b.repo_name = r.repo_name",
    "r_paths_ending_with": "SELECT file_id, path FROM files WHERE ends_with(lower(path), '_ledger.py')",
    "r_node_locations": "SELECT risk_id, coalesce(file_id, -1) AS file_id, line FROM (SELECT DISTINCT risk_id, file_path, line_number.start AS line FROM risk_items) LEFT JOIN files ON path = file_path",
    "r_symbol_search_exact": "SELECT p_partkey, p_name, true AS is_exact FROM part WHERE p_name = 'small ring'",
    "r_symbol_search_like": "SELECT p_partkey, p_name, false AS is_exact FROM part WHERE contains(lower(p_name), 'small')",
    "r_limit_per_group": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey)::INTEGER AS rank FROM lineitem QUALIFY rank <= 3",
    "r_upsert_last_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "r_stats": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ["files", "revisions", "file_versions", "parsed_files", "risk_items", "documents", "events"]),
    "r_counts_per_blob": f"SELECT {_HASH} AS hash, count(*) AS n_versions, count(DISTINCT file_id) AS n_files FROM file_versions WHERE {_HASH} IS NOT NULL GROUP BY 1",
    "i_content_hash_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "i_fingerprint": "SELECT source, count(*) AS n_items, sum(('0x' || left(sha256(text), 10))::BIGINT)::BIGINT AS fingerprint FROM documents WHERE text IS NOT NULL GROUP BY source",
    "i_new_content": f"WITH {_LATEST}, h AS (SELECT rev, {_HASH} AS hash FROM file_versions WHERE {_HASH} IS NOT NULL) SELECT DISTINCT hash FROM h WHERE rev IN (SELECT rev FROM latest) AND hash NOT IN (SELECT hash FROM h WHERE rev NOT IN (SELECT rev FROM latest))",
    "f_path_filter": f"SELECT file_id, path, regexp_matches({_NORMAL}, {_LEFT_OUT}) AS is_excluded FROM files",
    "f_lang_by_ext": """SELECT repo_name, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'typescript' WHEN 'jsx' THEN 'typescript' WHEN 'ts' THEN 'typescript'
        WHEN 'tsx' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'rb' THEN 'ruby' ELSE 'other' END AS language, count(*) AS n_files FROM files GROUP BY 1, 2""",
    "f_two_levels": f"SELECT array_to_string(list_slice(string_split({_NORMAL}, '/'), 1, 2), '/') AS directory, ({_WEIGHT})::DOUBLE AS weight, count(*) AS n_files FROM files GROUP BY 1, 2",
    "f_grep_literal": f"WITH {_LINES} SELECT file_id, line_no, line FROM lines WHERE regexp_matches(line, '\\bcatch\\b|except ')",
    "f_grep_context": f"""WITH {_LINES}, around AS (SELECT *, concat_ws(chr(10), lag(line) OVER w, line, lead(line) OVER w) AS context FROM lines WINDOW w AS (PARTITION BY file_id ORDER BY line_no))
        SELECT file_id, line_no, context FROM around WHERE regexp_matches(line, 'raise ')""",
    "f_fts_all_terms": "SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['cache', 'lock', 'orchard'])",
    "f_imports": f"WITH {_LINES} SELECT * FROM (SELECT file_id, line_no, {_by_language(textsearch.IMPORTS, True)} AS module FROM lines) WHERE module IS NOT NULL",
    "f_declarations": f"WITH {_LINES} SELECT * FROM (SELECT file_id, lang, line_no, {_by_language(textsearch.DECLARATIONS, False)} AS name FROM lines) WHERE name IS NOT NULL",
    "f_redacted": """SELECT doc_id, sha256(regexp_replace(text, '(?i)(api[_-]?key|token|secret)(["'']?\\s*[:=]\\s*["'']?)[^\\s"'',;]+', '\\1\\2***REDACTED***', 'g')) AS redacted_hash FROM documents WHERE text IS NOT NULL""",
    "e_heuristic_summary": f"""SELECT doc_id, trim(string_split(trim(text), chr(10))[1]) AS first_line, {_word('return')} AS has_return, {_word('raise|throw')} AS may_throw,
        {_word('open|write|delete|remove|unlink|exec|eval|http|socket|connect|commit|rollback')} AS has_side_effects FROM documents WHERE text IS NOT NULL""",
    "e_jaccard": f"""SELECT risk_id, created_at, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS similarity
        FROM (SELECT risk_id, created_at, {_SET.format('description')} AS a, {_SET.format('suggestion')} AS b FROM risk_items WHERE description IS NOT NULL AND suggestion IS NOT NULL)""",
    "v_group_tasks": "SELECT risk_type, CASE lower(trim(severity)) WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS severity_rank, count(*) AS n_items FROM risk_items GROUP BY 1, 2",
    "v_tool_stats": "SELECT n_events, count(*) AS n_users FROM (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id) GROUP BY n_events",
    "v_tool_totals": "SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, sum(c)::BIGINT AS sum_cents, max(c) AS max_cents, round(sum(c) / count(c), 6)::DOUBLE AS mean_cents FROM (SELECT *, round(value * 100)::BIGINT AS c FROM events) GROUP BY event_type",
    "e_shortened": "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '... [' || (length(text) - 200) || ' more]' ELSE text END AS shown FROM documents WHERE text IS NOT NULL",
    "v_loop_no_signal": "SELECT user_id, event_id, n_errors FROM (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n_errors FROM events) WHERE n_errors >= 5",
    "v_history_budget": "SELECT user_id, event_id, spent FROM (SELECT *, sum(coalesce(round(value * 100), 0)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM events) WHERE spent <= 50000",
    "w_job_dedupe": "SELECT min(event_id) AS event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'signup', 'error') AND user_id IS NOT NULL GROUP BY user_id, event_type, date_trunc('hour', ts)",
    "w_cooldown": "SELECT event_id, user_id FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) WHERE gap IS NULL OR gap >= 3600000000",
    "l_lint_norm": """WITH e AS (SELECT *, (props->>'$.k')::INT AS k FROM events WHERE user_id IS NOT NULL),
        m AS (SELECT CASE event_type WHEN 'error' THEN 'ruff' WHEN 'view' THEN 'biome' WHEN 'click' THEN 'go_vet' ELSE 'pmd' END AS tool, user_id, k FROM e WHERE k IS NOT NULL),
        n AS (SELECT tool, 'u' || user_id || CASE tool WHEN 'ruff' THEN '.py' WHEN 'biome' THEN '.ts' WHEN 'go_vet' THEN '.go' ELSE '.java' END AS file,
          CASE tool WHEN 'ruff' THEN CASE WHEN k < 20 THEN 'error' WHEN k < 40 THEN 'warning' ELSE 'info' END WHEN 'pmd' THEN CASE k % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END ELSE 'error' END AS severity,
          CASE tool WHEN 'ruff' THEN CASE WHEN k < 20 THEN 'E1' WHEN k < 40 THEN 'W2' WHEN k < 60 THEN 'UP3' ELSE 'N4' END WHEN 'biome' THEN 'lint/x' WHEN 'go_vet' THEN 'printf' ELSE 'R' END AS code,
          CASE tool WHEN 'biome' THEN k + 1 ELSE k END AS line FROM m WHERE tool <> 'biome' OR k < 50)
        SELECT tool, file, severity, code, count(*) AS n_messages, sum(line)::BIGINT AS sum_lines FROM n GROUP BY ALL""",
    "l_checkers": """SELECT checker, count(*) AS n_files, min(path) AS first_path FROM (SELECT path, CASE WHEN regexp_matches(lower(path), '\\.pyi?$') THEN 'ruff' WHEN regexp_matches(lower(path), '\\.(tsx?|jsx?|mjs|cjs)$') THEN 'biome'
        WHEN ends_with(lower(path), '.go') THEN 'go_vet' WHEN ends_with(lower(path), '.java') THEN 'pmd' END AS checker FROM files) WHERE checker IS NOT NULL GROUP BY checker""",
    "r_required_revs": f"WITH {_LATEST} SELECT r.repo_name, r.rev, CASE WHEN r.rev IN (SELECT rev FROM file_versions) THEN r.rev ELSE l.rev END AS used FROM revisions r LEFT JOIN latest l ON l.repo_name = r.repo_name",
    "r_file_ids": "SELECT DISTINCT risk_id, file_path AS path, coalesce(f.file_id, -1) AS file_id FROM risk_items LEFT JOIN files f ON f.path = file_path WHERE file_path IS NOT NULL",
    "r_symbol_locations": f"""WITH {_LATEST}, {_LINES}, named AS (SELECT file_id, line_no, {_by_language(textsearch.DECLARATIONS, False)} AS name FROM lines)
        SELECT v.rev, f.path, name, line_no FROM named JOIN (SELECT DISTINCT rev, file_id FROM file_versions WHERE rev IN (SELECT rev FROM latest) AND {_HASH} IS NOT NULL) v USING (file_id) JOIN files f USING (file_id) WHERE name IS NOT NULL""",
    "r_repo_map_files": f"""WITH {_LATEST}, {_LINES}, named AS (SELECT file_id, {_by_language(textsearch.DECLARATIONS, False)} AS name FROM lines),
        held AS (SELECT rev, file_id, {_HASH} AS hash FROM file_versions WHERE rev IN (SELECT rev FROM latest) AND {_HASH} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rev, file_id ORDER BY loaded_at DESC, {_HASH} DESC) = 1)
        SELECT rev, path, hash, coalesce(n, 0) AS n_symbols FROM held JOIN files USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS n FROM named WHERE name IS NOT NULL GROUP BY file_id) USING (file_id)""",
    "r_repo_map_symbols": f"""WITH {_LINES}, named AS (SELECT file_id, line_no, {_by_language(textsearch.DECLARATIONS, False)} AS name FROM lines)
        SELECT f.path, line_no, name, row_number() OVER (PARTITION BY f.path ORDER BY line_no, name)::INTEGER AS rank FROM named JOIN files f USING (file_id) WHERE name IS NOT NULL QUALIFY rank <= 20""",
    "r_greatest_content": f"SELECT path, max({_HASH}) AS hash FROM file_versions JOIN files USING (file_id) WHERE {_HASH} IS NOT NULL GROUP BY file_id, path",
    "r_paths_containing": "SELECT file_id, path FROM files WHERE path ILIKE '%ledger%'",
    "s_read_files": f"""WITH {_TEXTS}, c AS (SELECT path, text, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS n FROM texts)
        SELECT path, CASE WHEN n > 20 THEN array_to_string(list_slice(string_split(text, chr(10)), 1, 20), chr(10)) || chr(10) || chr(10) || '... (truncated, ' || (n - 20) || ' more lines)' ELSE text END AS content, n::INTEGER AS line_count FROM c""",
    "f_extract_json": "SELECT event_id, props AS found FROM events WHERE props IS NOT NULL",
}
