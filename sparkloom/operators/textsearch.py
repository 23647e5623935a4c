"""Line search and full-text search (F4, Q-FTS, Q-IMP, Q-AST)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sparkloom.functions.text import any_glob, language, words
from sparkloom.operators.latest import latest_rows

#: Import statements of each language by line (the group is the module).
IMPORTS = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))",
    "typescript": r"^\s*import\b.*?[\"']([^\"']+)[\"']|require\(\s*[\"']([^\"']+)[\"']\s*\)",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;()",
    "ruby": r"^\s*require(?:_relative)?\s+[\"']([^\"']+)[\"']()",
}
#: Declarations of each language by line (the group is the name).
DECLARATIONS = {
    "python": r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class)\s+(\w+)",
    "go": r"^(?:func(?:\s+\([^)]*\))?|type)\s+(\w+)",
    "java": r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(\w+)",
    "ruby": r"^\s*(?:def|class|module)\s+(?:self\.)?(\w+)",
}


def latest_text(parsed: DataFrame) -> DataFrame:
    """``(file_id, path, text)`` of each file's latest parse, line ends as line feeds.

    Only the sources of repeated files are shuffled; equal times are decided by path and source.
    """
    rows = parsed.where("file_id is not null and source is not null").select("file_id", "parsed_at", "path", "source")
    latest = latest_rows(rows, "file_id", "parsed_at", ["path", "source"])
    return latest.select("file_id", "path", F.regexp_replace(F.decode("source", "UTF-8"), "\r\n", "\n").alias("text"))


def snippets(texts: DataFrame, ranges: DataFrame, context: int = 20, max_lines: int = 240) -> DataFrame:
    """``(path, start, end, snippet)``: each range of lines ``(path, start, end)`` with its surroundings, numbered.

    A range beyond the text is moved to its last line; more than ``max_lines`` lines are narrowed to those about the
    range's middle. Repeated ranges count once, so a path named very often is read as often as it has different ranges;
    slices of a text's own lines, no line is joined.
    """
    wanted = ranges.where("path is not null and start <= end").select("path", "start", "end").distinct()
    rows = texts.select("path", F.split("text", "\n").alias("lines")).join(wanted, "path")
    last = F.size("lines")
    inside = lambda line: F.least(F.greatest(line, F.lit(1)), last)
    low, high = inside(inside(F.col("start")) - context), inside(inside(F.col("end")) + context)
    middle = F.floor((inside(F.col("start")) + inside(F.col("end"))) / 2).cast("int")
    narrow = inside(middle - max_lines // 2)
    wide = high - low + 1 > max_lines
    rows = rows.select("path", "start", "end", "lines", F.when(wide, narrow).otherwise(low).alias("low"), F.when(wide, F.least(narrow + max_lines - 1, last)).otherwise(high).alias("high"))
    shown = F.transform(F.slice("lines", F.col("low"), F.col("high") - F.col("low") + 1), lambda line, at: F.concat((F.col("low") + at).cast("string"), F.lit(": "), line))
    return rows.select("path", "start", "end", F.array_join(shown, "\n").alias("snippet"))


def text_lines(texts: DataFrame) -> DataFrame:
    """``(file_id, path, line_no, line)``, lines from 1."""
    return texts.select("file_id", "path", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("file_id", "path", (F.col("at") + 1).alias("line_no"), "line")


def grep(texts: DataFrame, pattern: str, include: list[str] | None = None, exclude: list[str] = [], literal: bool = False, ignore_case: bool = False) -> DataFrame:
    """Matching lines (F4); texts without a match anywhere are not split.

    ``include`` and ``exclude`` are globs on the path or, without a slash, on the file's name; ``literal``: the pattern is plain text.
    The whole result, in no order; ``first_hits`` gives the first ones in the order (path, line).
    """
    if include is not None:
        texts = texts.where(_any_name(include))
    if exclude:
        texts = texts.where(~_any_name(exclude))
    if literal:
        pattern = "".join(c if c.isalnum() or c in "_ " or ord(c) > 127 else "\\" + c for c in pattern)
    flags = "i" if ignore_case else ""
    return text_lines(texts.where(F.col("text").rlike(f"(?m{flags})" + pattern))).where(F.col("line").rlike((f"(?{flags})" if flags else "") + pattern))


def _any_name(globs: list[str]):
    return any_glob(F.col("path"), [g if "/" in g else "**/" + g for g in globs])


def first_hits(hits: DataFrame, n: int) -> DataFrame:
    """The first ``n`` matching lines in the order (path, line): a report's top, found without sorting the rest."""
    return hits.orderBy("path", "line_no").limit(n)


def grep_context(texts: DataFrame, pattern: str, around: int = 1) -> DataFrame:
    """Matching lines with up to ``around`` lines before and after, as one text: slices of a file's own lines, no join."""
    rows = texts.where(F.col("text").rlike("(?m)" + pattern)).withColumn("lines", F.split("text", "\n"))
    hits = rows.select("file_id", "path", "lines", F.posexplode("lines").alias("at", "line")).where(F.col("line").rlike(pattern))
    low = F.greatest(F.lit(0), F.col("at") - around)
    return hits.select("file_id", "path", (F.col("at") + 1).alias("line_no"), F.array_join(F.slice("lines", low + 1, F.col("at") + around - low + 1), "\n").alias("context"))


def inverted_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(term, key)`` for every distinct ASCII word of a text (Q-FTS)."""
    return rows.where(F.col(text).isNotNull()).select(F.explode(words(F.col(text), "[a-z0-9]+")).alias("term"), key)


def with_all_terms(rows: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Keys whose text holds all terms: a filter of each row, no join and no shuffle."""
    held = words(F.col(text), "[a-z0-9]+")
    return rows.where(F.col(text).isNotNull()).where(F.size(F.array_except(F.array(*[F.lit(t.lower()) for t in set(terms)]), held)) == 0).select(key)


def marked_snippets(rows: DataFrame, key: str, text: str, terms: list[str], around: int = 5) -> DataFrame:
    """``(key, snippet)`` of the texts with all terms: the first hit with ``around`` tokens on both sides, hits in brackets (Q-FTS)."""
    wanted = [t.lower() for t in terms]
    found = rows.where(F.col(text).isNotNull())
    tokens = F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " ")
    bare = F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", ""))
    hit = F.transform(bare, lambda b: b.isin(*wanted))
    at = F.array_position(hit, True)
    low = F.greatest(F.lit(1), at - around)
    shown = F.zip_with(F.slice(tokens, low.cast("int"), 2 * around + 1), F.slice(hit, low.cast("int"), 2 * around + 1), lambda t, h: F.when(h, F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
    held = words(F.col(text), "[a-z0-9]+")
    return found.where(F.size(F.array_except(F.array(*[F.lit(t) for t in set(wanted)]), held)) == 0).select(key, F.when(at > 0, F.array_join(shown, " ")).alias("snippet"))


def imports(texts: DataFrame) -> DataFrame:
    """``(file_id, line_no, module)`` by the patterns of the file's language (Q-IMP, G14)."""
    lines = text_lines(texts).withColumn("lang", language(F.col("path")))
    module = F.lit(None).cast("string")
    for name, pattern in IMPORTS.items():
        found = F.concat(F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2))
        module = F.when(F.col("lang") == name, F.nullif(found, F.lit(""))).otherwise(module)
    return lines.withColumn("module", module).where("module is not null").select("file_id", "line_no", "module")


def declarations(texts: DataFrame) -> DataFrame:
    """``(file_id, lang, line_no, name, line)`` of declared functions and types (Q-AST, G5)."""
    lines = text_lines(texts).withColumn("lang", language(F.col("path")))
    name = F.lit(None).cast("string")
    for lang, pattern in DECLARATIONS.items():
        name = F.when(F.col("lang") == lang, F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))).otherwise(name)
    return lines.withColumn("name", name).where("name is not null").select("file_id", "lang", "line_no", "name", "line")


def resolved_names(uses: DataFrame, symbols: DataFrame, keys: list[str], target: str, order: str) -> DataFrame:
    """Each use with the symbol of its name that comes first in ``order``, null if there is none."""
    first = symbols.groupBy(*keys).agg(F.min_by(target, order).alias(target))
    return uses.join(first, keys, "left")


def consecutive(rows: DataFrame, keys: list[str], order: list[str], node: str) -> DataFrame:
    """Edges from every node to the next of its group."""
    after = F.lead(node).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.select(F.col(node).alias("src"), after.alias("dst")).where("dst is not null")


def last_before(rows: DataFrame, keys: list[str], order: list[str], is_definition, node: str) -> DataFrame:
    """Every row with the last definition before it in its group: an as-of join by a window."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("def_id", F.last(F.when(is_definition, F.col(node)), ignorenulls=True).over(before))
