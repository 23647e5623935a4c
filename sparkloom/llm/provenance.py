"""Generated, minified, vendored source files and data saved as code (problem 2).

Every file is lexed and emitted again in a canonical layout: one statement or block edge a line, comments dropped, white
space evened out. Each emitted line is compared with the layout it had: a file that grows many times over was compressed for
delivery; one made of a few forms that differ by their numbering only, each laid out alike every time, was written by a
tool; one whose tokens are almost all literals is data. Layout cannot tell two kinds of cases, which follow it: generated
files of an ordinary layout are known by their notice, files of another project by their canonical form (if more than one
repository holds it, whatever header or layout it got), a foreign notice or their folder.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.latest import latest_sources
from sparkloom.llm.lexing import LANGUAGES, TOKENS, decoded, language_of
from sparkloom.sources.shared import written

FEATURES = "file_id bigint, path string, canonical string, canonical_chars int, lines int, expansion double, uniform double, literal double, says_generated boolean, owner string"
#: What a verdict rests on, in this order, and the kind that follows from it. The first three compare layouts.
EVIDENCE = {"expansion": "minified", "literals": "data", "uniformity": "generated", "notice": "generated", "copies": "vendored", "owner": "vendored", "folder": "vendored"}

#: Thresholds; own code of the usual layout is far below each.
EXPANSION, UNIFORM, LITERAL = 8.0, 0.85, 0.65
#: Lines from which uniformity and tokens from which dominance tell anything; characters from which a form is a copy.
LEAST_LINES, LEAST_TOKENS, LEAST_CHARS = 12, 12, 120

_GENERATED = re.compile(
    r"(?i)@generated\b|\b(?:auto[- ]?|code[ -]|file[ -]|automatically[ -])generated\b|\bautogenerated\b|\bgenerated (?:by|from|with|using)\b[^\n]*(?:do not (?:edit|modify)|$)"
    r"|\bautomatically (?:produced|created|written)\b|do not (?:edit|modify)\W+(?:output|generated|this (?:file|code) (?:is|was))|\b(?:automatisch|maschinell) (?:erzeugt|erstellt|generiert)\b|自动生成|自動生成"
)
_FOREIGN = re.compile(r"(?i)(?:\(c\)|copyright|©)[^\n]{0,20}?\bthe ([\w.-]+) (?:authors|contributors|developers|project|foundation)\b")
#: Folders of other projects: with a version, of package managers, and by their usual names below a repository's root.
_FOLDERS = r"/[a-z][\w.-]*?-v?\d+\.\d+(?:\.\d+)?/|/(?:node_modules|site-packages|bower_components|third[_-]party|3rdparty)/|^[^/]+/(?:vendor|vendored|ext|extern|external|externals|deps)/"
_NAME, _NUMBER = re.compile(r"\b[^\W\d]\w*+"), re.compile(r"\b\d[\w.]*+")
_DIGITS = re.compile(r"\d+")


_STOPS = {True: re.compile(r"[{};\n]"), False: re.compile(r"[\n;]")}


def emitted(code: str, braces: bool) -> list[tuple[int, int]]:
    """Spans of the lines that code without comments and literals is emitted as: statements end at semicolons and at line
    ends outside of parentheses, with braces also at every block edge."""
    spans, begun, seen, depth, count = [], 0, 0, 0, code.count
    for m in _STOPS[braces].finditer(code):
        c, at = m[0], m.start()
        if seen < at:
            depth += count("(", seen, at) + count("[", seen, at) - count(")", seen, at) - count("]", seen, at)
            if not braces:
                depth += count("{", seen, at) - count("}", seen, at)
            depth = max(0, depth)
        seen = at + 1
        if c == "}":
            if begun < at:
                spans.append((begun, at))
                begun = at
        elif c == "{" or not depth:
            spans.append((begun, seen))
            begun = seen
    spans.append((begun, len(code)))
    return spans


def features(text: str, language: str) -> tuple:
    """The columns of ``FEATURES`` after the path."""
    # Of the same length as the text: without comments, and without literals too.
    whole, bare, last, literals, comments = [], [], 0, 0, []
    for m in TOKENS[language].finditer(text):
        between = text[last : m.start()]
        whole.append(between)
        bare.append(between)
        blank = " " * (m.end() - m.start())
        bare.append(blank)
        if m["c"] is None:
            whole.append(m[0])
            literals += 1
        else:
            # What follows a comment's line end is a line of its own.
            whole.append(blank if "\n" not in m[0] else blank[1:] + "\n")
            comments.append((m.start(), m.end()))
        last = m.end()
    whole.append(text[last:])
    bare.append(text[last:])
    shown, code = "".join(whole), "".join(bare)
    spans = emitted(code, language in ("typescript", "go", "java"))
    forms, layouts = [], []
    for a, b in spans:
        layout = shown[a:b]
        form = " ".join(layout.split())
        if form:
            forms.append(form)
            layouts.append(layout.strip("\n"))
    canonical = "\n".join(forms)
    lines = sum(1 for x in text.split("\n") if x.strip())
    expansion = len(forms) / max(1, lines)
    # Lines with words that are the same but for their numbers, each form at least four times and always laid out alike.
    uniform = 0.0
    if len(forms) >= LEAST_LINES:
        met: dict[str, list] = {}
        for form, layout in zip(_DIGITS.sub("0", canonical).split("\n"), _DIGITS.sub("0", "\0".join(layouts)).split("\0")):
            if len(form) > 8:
                seen = met.setdefault(form, [0, layout, True])
                seen[0] += 1
                seen[2] = seen[2] and seen[1] == layout
        worded = sum(n for n, *_ in met.values())
        uniform = sum(n for n, _, alike in met.values() if n >= 4 and alike) / worded if worded >= LEAST_LINES else 0.0
    names, numbers = len(_NAME.findall(code)), len(_NUMBER.findall(code))
    tokens = literals + numbers + names
    # Dominant are literals that are most of the tokens and most of the characters.
    told = 1 - sum(map(len, _NUMBER.sub("", code).split())) / max(1, len(canonical.replace(" ", "").replace("\n", "")))
    literal = min((literals + numbers) / tokens, told) if tokens >= LEAST_TOKENS else 0.0
    # A notice is a comment before the first or after the last line of code.
    first, end = 0, len(text)
    marks = []
    for a, b in comments:
        if text[first:a].strip():
            break
        marks.append(text[a:b])
        first = b
    for a, b in reversed(comments):
        if text[b:end].strip():
            break
        marks.append(text[a:b])
        end = a
    notice = "\n".join(marks)
    owner = _FOREIGN.search(notice)
    digest = hashlib.md5(" ".join(canonical.split()).encode("utf-8", "replace")).hexdigest()
    return digest, len(canonical), lines, expansion, uniform, literal, bool(_GENERATED.search(notice)), owner and owner[1].lower()


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file, path, source in zip(batch["file_id"], batch["path"], batch["source"]):
            rows.append((file, path, *features(decoded(bytes(source)), language_of(path))))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])


def provenance(files: DataFrame, parsed: DataFrame, versions: DataFrame) -> DataFrame:
    """``(file_id, repo_name, size, kind, evidence)`` of every code file with content; ``kind`` is ``generated``, ``minified``,
    ``vendored``, ``data`` or ``own``, by the first evidence that holds in the order of ``EVIDENCE``.

    Folders and repository are those of ``files`` (smallest path of repeated ones), the language that of the parsed path's
    extension, so that a missing or odd ``lang`` does no harm. ``size`` is the greatest one delivered for the file, else the
    source's. Files without source, with an empty one, of other extensions or without id give no row; of repeated parses the
    latest counts; a missing repository counts as one; empty tables give no rows; further columns are ignored.

    Sources are read once and not moved: only the features are joined.
    """
    known = files.select(F.col("file_id").cast("bigint").alias("file_id"), "path", F.coalesce("repo_name", F.lit("")).alias("repo_name"))
    known = known.where("file_id is not null and path is not null").groupBy("file_id").agg(F.min(F.struct("path", "repo_name")).alias("f"))
    known = known.select("file_id", F.col("f.path").alias("at"), "f.repo_name")
    rows = written(latest_sources(parsed, tuple(LANGUAGES)).mapInPandas(_featured, FEATURES), "provenance")
    rows = rows.drop("path").join(known, "file_id")
    copied = (
        rows.where(F.col("canonical_chars") >= LEAST_CHARS).groupBy("canonical").agg(F.min("repo_name").alias("a"), F.max("repo_name").alias("z"))
        .where("a <> z").select("canonical", F.lit(True).alias("is_copied"))
    )
    sizes = versions.select(F.col("file_id").cast("bigint").alias("file_id"), "size").groupBy("file_id").agg(F.max("size").alias("size"))
    holds = {
        "expansion": F.col("expansion") >= EXPANSION, "literals": F.col("literal") >= LITERAL, "uniformity": F.col("uniform") >= UNIFORM, "notice": F.col("says_generated"),
        "copies": F.col("is_copied"), "owner": F.col("owner") != F.lower("repo_name"), "folder": F.col("at").rlike(_FOLDERS),
    }
    evidence = F.coalesce(*[F.when(holds[name], name) for name in EVIDENCE], F.lit("none"))
    kind = F.create_map(*[F.lit(x) for pair in {**EVIDENCE, "none": "own"}.items() for x in pair])
    judged = rows.join(copied, "canonical", "left").select("file_id", "repo_name", "canonical_chars", evidence.alias("evidence"))
    judged = judged.select("*", kind[F.col("evidence")].alias("kind"))
    return judged.join(sizes, "file_id", "left").select("file_id", "repo_name", F.coalesce("size", "canonical_chars").alias("size"), "kind", "evidence").distinct()


def foreign_files(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("kind <> 'own'").select("file_id").distinct()


def provenance_totals(verdicts: DataFrame) -> DataFrame:
    """Files and bytes of each kind per repository."""
    return verdicts.groupBy("repo_name", "kind").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))
