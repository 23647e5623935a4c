"""Import statements read from whole texts, not by line, and the files that they name (Q-IMP, Q-RES, G14)."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkloom.functions.text import language

#: Characters of a Python text up to which it is parsed; longer ones and those that do not parse are read by pattern.
PARSED = 1_000_000

_NAMES = r"(?:[^\n#;\\]|\\\n)"
_PYTHON = re.compile(rf"(?:from(?:[ \t]+|(?=\.))(\.*[ \t]*[\w.]*?)[ \t]*\bimport\b[ \t]*(\([^)]*\)|{_NAMES}*)|import[ \t]+({_NAMES}+))")
_PYTHON_LINE = re.compile(r"^[ \t]*(?=from\b|import\b)", re.M)
_PYTHON_NEXT = re.compile(r"[ \t]*;[ \t]*")
_SCRIPT = re.compile(r"""^[ \t]*(?:import|export)\b[^;"'`()=]*?\bfrom\s*["']([^"'\n]+)["']|^[ \t]*import\s*["']([^"'\n]+)["']|\b(?:require|import)\(\s*["']([^"'\n]+)["']\s*\)""", re.M)
_JAVA = re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M)
_RUBY = re.compile(r"""^[ \t]*require(?:_relative)?(?:[ \t]+|[ \t]*\([ \t]*)["']([^"'\n]+)["']""", re.M)
_GO_BODY = re.compile(r"^(?:func|type|var|const)\b", re.M)
_GO_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|"([^"\n]*)"|`([^`]*)`|\bimport\b|[(){}]""", re.S)
_ENDS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]


def _named(listed: str) -> list[str]:
    plain = re.sub(r"#[^\n]*|\\\n|[()]", " ", listed)
    return [x.split()[0] for x in plain.split(",") if re.match(r"\s*(?:[\w.]+|\*)(?:\s|$)", x)]


def _python_by_pattern(text: str) -> Iterator[tuple[int, str, list[str]]]:
    for line in _PYTHON_LINE.finditer(text):
        found = _PYTHON.match(text, line.end())
        while found:
            if found[3] is not None:
                yield from ((found.start(), name, []) for name in _named(found[3]))
            else:
                yield found.start(), re.sub(r"\s", "", found[1]), _named(found[2])
            more = _PYTHON_NEXT.match(text, found.end())
            found = more and _PYTHON.match(text, more.end())


def _python(text: str) -> Iterator[tuple[int, str, list[str]]]:
    try:
        if len(text) > PARSED:
            raise ValueError
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        for at, module, names in _python_by_pattern(text):
            yield text.count("\n", 0, at) + 1, module, names
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ((node.lineno, x.name, []) for x in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield node.lineno, "." * node.level + (node.module or ""), [x.name for x in node.names]


def _go(text: str) -> Iterator[tuple[int, str]]:
    """Specs of single and block imports; imports stand before all other declarations."""
    body = _GO_BODY.search(text)
    wanted, block = False, False
    for token in _GO_TOKEN.finditer(text, 0, body.start() if body else len(text)):
        whole, module = token[0], token[1] if token[1] is not None else token[2]
        if whole == "import":
            wanted = True
        elif whole == "(":
            block = wanted
        elif whole in "){}":
            wanted = block = False
        elif module is not None and wanted:
            yield token.start(), module
            wanted = block


def specs(lang: str, text: str) -> list[tuple[int, str, list[str]]]:
    """``(line, module, names)`` of a text's imports, once each; names only of Python's ``from``."""
    if lang == "python":
        found = _python(text) if "import" in text else []
    else:
        if lang == "go":
            at = _go(text)
        else:
            pattern = {"typescript": _SCRIPT, "java": _JAVA, "ruby": _RUBY}.get(lang)
            at = ((m.start(m.lastindex), m[m.lastindex], m.start()) for m in pattern.finditer(text)) if pattern else ()
            at = ((begin + len(text[begin:end]) - len(text[begin:end].lstrip()), module) for end, module, begin in at)
        found = ((text.count("\n", 0, begin) + 1, module, []) for begin, module in at)
    merged: dict[tuple[int, str], list[str]] = {}
    for line, module, names in found:
        merged.setdefault((line, module), []).extend(n for n in names if n != "*")
    return [(line, module, list(dict.fromkeys(names))) for (line, module), names in merged.items() if module]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(file, lang, *spec) for file, lang, text in zip(batch["file_id"], batch["lang"], batch["text"]) for spec in specs(lang, text)]
        yield pd.DataFrame(rows, columns=["file_id", "lang", "line_no", "module", "names"])


def import_specs(texts: DataFrame) -> DataFrame:
    """``(file_id, lang, line_no, module, names)``: every imported module of Python, TypeScript, Go, Java and Ruby texts.

    Statements may span lines and hold several modules; the line is the statement's first, in Go's blocks the spec's.
    Python is parsed where it parses. Null texts have no imports; a module named twice on a line counts once.
    """
    rows = texts.select("file_id", language(F.col("path")).alias("lang"), "text").where("lang is not null and text is not null")
    return rows.mapInPandas(_read, "file_id bigint, lang string, line_no int, module string, names array<string>")


def even(path):
    """A path without ``.`` and ``..``, however many; those leading out of the root stay and match nothing."""
    step = lambda done, part: (
        F.when(part.isin("", "."), done)
        .when((part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved_specs(found: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, line_no, module, name, target_id)``: imports with the files of the same repository that they name.

    A module's row has no name, its target is the smallest matching id, or -1; a name of Python's ``from`` has a row if it
    is a module itself. What names a package (Go, Java's ``.*``) has a row for each file of the folder. Candidate paths and
    folders are joined by equality; Java's by the last part and then compared by their end. Go's modules are folders
    below the repository, by themselves or after the repository's name.
    """
    known = files.select("file_id", "path", "repo_name").where("file_id is not null and path is not null")
    rows = found.select("file_id", "lang", "line_no", "module", "names").join(known, "file_id").withColumn("beside", F.regexp_replace("path", r"/?[^/]*$", ""))
    key = ["file_id", "line_no", "module", "name"]
    none = F.lit(None).cast("string")
    module, beside, repo = F.col("module"), F.col("beside"), F.col("repo_name")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    dots = F.length(F.regexp_extract("module", r"^\.+", 0))
    rest = F.regexp_replace(F.regexp_replace("module", r"^\.+", ""), r"\.", "/")
    bases = F.when(dots > 0, F.array(join(beside, "/", F.expr("repeat('../', greatest(length(regexp_extract(module, '^\\\\.+', 0)) - 1, 0))")))).otherwise(F.array(join(repo, "/"), join(beside, "/")))
    python = rows.where("lang = 'python'").select("file_id", "line_no", "module", F.explode(F.concat(F.array(none), "names")).alias("name"), rest.alias("rest"), bases.alias("bases"))
    inner = F.when(F.col("name").isNull(), F.col("rest")).otherwise(F.concat_ws("/", F.nullif("rest", F.lit("")), "name"))
    python = python.withColumn("inner", inner).withColumn("ends", F.when(F.col("inner") == "", F.array(F.lit("/__init__.py"))).otherwise(F.array(F.lit(".py"), F.lit("/__init__.py"))))
    python = python.select(*key, F.explode("bases").alias("base"), "inner", "ends").select(*key, F.explode("ends").alias("end"), "base", "inner").select(*key, F.concat("base", "inner", "end").alias("at"))
    script = rows.where("lang = 'typescript' and startswith(module, '.')").select("file_id", "line_no", "module", none.alias("name"), F.explode(F.array(*[join(beside, "/", module, e) for e in _ENDS])).alias("at"))
    ruby = rows.where("lang = 'ruby'").select("file_id", "line_no", "module", none.alias("name"), F.explode(F.array(join(beside, "/", module, ".rb"), join(repo, "/", module, ".rb"))).alias("at"))
    tried = python.unionByName(script).unionByName(ruby).select(*key, even(F.col("at")).alias("path"))
    by_path = tried.join(known.select("path", F.col("file_id").alias("target_id")), "path").select(*key, "target_id")

    java = rows.where("lang = 'java'").withColumn("name", none)
    classes = java.select(*key, "repo_name", F.explode(F.array(module, F.regexp_replace("module", r"\.[^.]*$", ""))).alias("dotted"))
    classes = classes.where("not endswith(dotted, '*')").select(*key, "repo_name", F.concat(F.substring_index("dotted", ".", -1), F.lit(".java")).alias("last"), join("/", F.regexp_replace("dotted", r"\.", "/"), ".java").alias("end"))
    named = known.select(F.substring_index("path", "/", -1).alias("last"), "repo_name", F.col("path").alias("other"), F.col("file_id").alias("target_id"))
    by_class = classes.join(named, ["last", "repo_name"]).where(F.endswith(join("/", F.col("other")), "end")).select(*key, "target_id")
    single = by_path.unionByName(by_class).groupBy(*key).agg(F.min("target_id").alias("target_id"))

    folders = known.select("repo_name", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), language(F.col("path")).alias("lang"), F.col("file_id").alias("target_id"))
    go = rows.where("lang = 'go'").withColumn("name", none)
    cut = F.expr("instr(concat('/', module, '/'), concat('/', repo_name, '/'))")
    ways = F.when(module.startswith("."), F.array(join(beside, "/", module))).when(cut > 0, F.array(join(repo, "/", module), F.expr("substring(module, instr(concat('/', module, '/'), concat('/', repo_name, '/')))"))).otherwise(F.array(join(repo, "/", module)))
    go = go.select(*key, "repo_name", F.explode(ways).alias("at")).select(*key, "repo_name", even(F.col("at")).alias("folder"))
    by_folder = go.join(folders.where("lang = 'go'"), ["repo_name", "folder"]).select(*key, "target_id")
    package = java.where("endswith(module, '.*')").select(*key, "repo_name", F.regexp_replace(F.regexp_replace("module", r"\.\*$", ""), r"\.", "/").alias("inner")).withColumn("last", F.substring_index("inner", "/", -1))
    packages = folders.where("lang = 'java'").withColumn("last", F.substring_index("folder", "/", -1))
    by_package = package.join(packages, ["repo_name", "last"]).where(F.endswith(join("/", F.col("folder")), join("/", F.col("inner")))).select(*key, "target_id")

    met = single.unionByName(by_folder).unionByName(by_package).distinct()
    alone = rows.select("file_id", "line_no", "module").distinct().join(met.where("name is null").select("file_id", "line_no", "module").distinct(), ["file_id", "line_no", "module"], "left_anti")
    return met.unionByName(alone.select("file_id", "line_no", "module", none.alias("name"), F.lit(-1).cast("bigint").alias("target_id")))
