"""What modules export, and whether imported names are among it (Q-RES, Q-RES-PY, Q-RES-TS, Q-RES-GO, Q-RES-JAVA, Q-RES-RUBY)."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkloom.functions.text import language
from sparkloom.operators.import_specs import even
from sparkloom.sources.shared import written

#: ``of``: the module that an export is passed on from, ``source_name`` its name there (``*``: all of it).
EXPORTS = "file_id bigint, lang string, name string, of string, source_name string"

_NAME = r"[A-Za-z_$][\w$]*"
_SCRIPT = re.compile(
    rf"^[ \t]*export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|type|enum|namespace|const\s+enum|const|let|var)\s+({_NAME})"
    rf"|^[ \t]*export\s+(?:type\s+)?\{{([^}}]*)\}}(?:\s*from\s*[\"']([^\"'\n]+)[\"'])?|^[ \t]*export\s+\*(?:\s+as\s+({_NAME}))?\s+from\s*[\"']([^\"'\n]+)[\"']|^[ \t]*export\s+(default)\b",
    re.M,
)
_DECLARED = {
    "go": re.compile(r"^(?:func|type|var|const)[ \t]+([A-Za-z_]\w*)", re.M),
    "java": re.compile(r"^[ \t]*(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed)\s+)*(?:class|interface|enum|record|@interface)\s+(\w+)", re.M),
    "ruby": re.compile(r"^[ \t]*(?:class|module|def)\s+(?:self\.)?([A-Za-z_]\w*)", re.M),
}
_IMPORTED = re.compile(rf"^[ \t]*import\s+(?:type\s+)?(?:({_NAME})\s*,?\s*)?(?:\{{([^}}]*)\}})?\s*from\s*[\"']([^\"'\n]+)[\"']", re.M)


def _listed(names: str) -> list[tuple[str, str]]:
    """``(name, name outside)`` of a list such as ``a, b as c``."""
    found = [re.match(rf"\s*(?:type\s+)?({_NAME})(?:\s+as\s+({_NAME}))?\s*$", part) for part in names.split(",")]
    return [(m[1], m[2] or m[1]) for m in found if m]


def _script_exports(text: str) -> Iterator[tuple[str, str | None, str | None]]:
    for m in _SCRIPT.finditer(text):
        if m[1]:
            yield ("default" if re.match(r"\s*export\s+default\b", m[0]) else m[1]), None, None
        elif m[2] is not None:
            yield from ((outside, m[3], inside if m[3] else None) for inside, outside in _listed(m[2]))
        elif m[5]:
            yield m[4] or "*", None if m[4] else m[5], None if m[4] else "*"
        else:
            yield "default", None, None


def _bound(targets: ast.AST) -> Iterator[str]:
    yield from (n.id for n in ast.walk(targets) if isinstance(n, ast.Name))


def _python_exports(text: str) -> Iterator[tuple[str, str | None, str | None]]:
    """Names bound at module level, in its branches and blocks too, and those of ``__all__`` if ``__getattr__`` makes them."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            todo: list[ast.AST] = list(ast.parse(text).body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    names, listed = set(), []
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            names.add(node.name)
            continue
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            names |= {(x.asname or x.name).split(".")[0] for x in node.names}
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            names |= {n for t in targets for n in _bound(t)}
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(node.value, (ast.List, ast.Tuple)):
                listed = [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            names |= set(_bound(node.target))
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            names |= {n for item in node.items if item.optional_vars for n in _bound(item.optional_vars)}
        for field in ("body", "orelse", "finalbody", "handlers"):
            todo += getattr(node, field, [])
    yield from ((n, None, None) for n in sorted(names | (set(listed) if "__getattr__" in names else set())))


def exports_of(lang: str, text: str) -> list[tuple[str, str | None, str | None]]:
    """``(name, of, source_name)`` of what a module offers to others; names of Go count if they begin in upper case."""
    if lang == "python":
        return list(_python_exports(text))
    if lang == "typescript":
        return list(dict.fromkeys(_script_exports(text)))
    names = dict.fromkeys(m[1] for m in _DECLARED[lang].finditer(text))
    return [(n, None, None) for n in names if lang != "go" or n[0].isupper()]


def _exported(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(file, lang, *e) for file, lang, text in zip(batch["file_id"], batch["lang"], batch["text"]) for e in exports_of(lang, text)]
        yield pd.DataFrame(rows, columns=["file_id", "lang", "name", "of", "source_name"])


def _imported(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file, text in zip(batch["file_id"], batch["text"]):
            for m in _IMPORTED.finditer(text):
                names = [*(["default"] if m[1] else []), *(inside for inside, _ in _listed(m[2] or ""))]
                rows += [(file, text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1, m[3], n) for n in dict.fromkeys(names)]
        yield pd.DataFrame(rows, columns=["file_id", "line_no", "module", "name"])


_ENDS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]


def _beside(rows: DataFrame, known: DataFrame, module: str) -> DataFrame:
    """``rows`` (``path`` of the file that names the module) with the smallest ``target_id`` of a relative TypeScript module."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    tried = rows.where(F.startswith(F.col(module), F.lit("."))).withColumn("_at", F.explode(F.array(*[F.concat(folder, F.lit("/"), F.col(module), F.lit(e)) for e in _ENDS])))
    met = tried.withColumn("_path", even(F.col("_at"))).join(known.select(F.col("path").alias("_path"), F.col("file_id").alias("target_id")), "_path")
    return met.groupBy(*rows.columns).agg(F.min("target_id").alias("target_id"))


def module_exports(texts: DataFrame, files: DataFrame, depth: int = 8) -> DataFrame:
    """``(file_id, name)``: what every module exports, with what TypeScript modules pass on from others over up to ``depth`` modules.

    Each round joins what is passed on with what the round before found new; a cycle finds nothing new and ends.
    """
    rows = texts.select("file_id", language(F.col("path")).alias("lang"), "text").where("lang is not null and text is not null")
    found = written(rows.mapInPandas(_exported, EXPORTS), "exports")
    known = files.select("file_id", "path").where("file_id is not null and path is not null")
    passed = found.where("of is not null").join(known, "file_id").select("file_id", "name", "of", "source_name", "path")
    passed = written(_beside(passed, known, "of").select("file_id", "name", "source_name", "target_id"), "passed-on")
    new = written(found.where("of is null").select("file_id", "name").distinct(), "exported")
    rounds = [new]
    for _ in range(depth):
        there = new.select(F.col("file_id").alias("target_id"), F.col("name").alias("theirs"))
        met = passed.join(there, "target_id").where((F.col("source_name") == F.col("theirs")) | ((F.col("source_name") == "*") & (F.col("theirs") != "default")))
        met = met.select("file_id", F.when(F.col("source_name") == "*", F.col("theirs")).otherwise(F.col("name")).alias("name")).distinct()
        new = written(met.join(reduce(DataFrame.unionByName, rounds), ["file_id", "name"], "left_anti"), "exported")
        if new.isEmpty():
            break
        rounds.append(new)
    return reduce(DataFrame.unionByName, rounds)


def checked_names(names: DataFrame, exports: DataFrame) -> DataFrame:
    """``names`` (as from ``name_rows``) with ``is_exported``: whether the module that the name is imported from has it.

    A name that is a module itself is one of its package. Where the module is unknown (``target_id`` -1) nothing is proven.
    """
    offered = exports.select(F.col("file_id").alias("target_id"), "name", F.lit(True).alias("_there"))
    met = names.join(offered, ["target_id", "name"], "left")
    return met.select("file_id", "line_no", "module", "name", "target_id", (F.coalesce("_there", F.lit(False)) | F.col("is_module")).alias("is_exported"))


def name_rows(specs: DataFrame, resolved: DataFrame, texts: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, line_no, module, name, target_id, is_module)``: one row for each imported name, with the file of its module.

    Python's names of ``from``, TypeScript's in braces and its default, the class of a Java import, and for Ruby the class that a file
    is named after. Go imports packages, whose names are used as ``package.Name``: see ``go_exports``.
    """
    keys = ["file_id", "line_no", "module"]
    modules = resolved.where("name is null").groupBy(*keys).agg(F.min("target_id").alias("target_id"))
    python = specs.where("lang = 'python'").select(*keys, F.explode("names").alias("name"))
    java = specs.where("lang = 'java' and not endswith(module, '.*')").select(*keys, F.substring_index("module", ".", -1).alias("name"))
    camel = F.expr("array_join(transform(split(regexp_replace(substring_index(module, '/', -1), '[.]rb$', ''), '_'), w -> initcap(w)), '')")
    ruby = specs.where("lang = 'ruby'").select(*keys, camel.alias("name"))
    named = python.unionByName(java).unionByName(ruby).join(modules, keys, "left")
    scripts = texts.where(language(F.col("path")) == "typescript").select("file_id", "text").mapInPandas(_imported, "file_id bigint, line_no int, module string, name string")
    known = files.select("file_id", "path").where("file_id is not null and path is not null")
    scripts = scripts.join(known, "file_id")
    scripts = scripts.join(_beside(scripts, known, "module").select(*keys, "name", "target_id"), [*keys, "name"], "left").select(*keys, "name", "target_id")
    rows = named.unionByName(scripts)
    # A name that is a submodule is that file.
    inner = resolved.where("name is not null and target_id >= 0").groupBy(*keys, "name").agg(F.min("target_id").alias("inner_id"))
    rows = rows.join(inner, [*keys, "name"], "left")
    return rows.select(*keys, "name", F.coalesce("target_id", F.lit(-1)).alias("target_id"), F.col("inner_id").isNotNull().alias("is_module"))


def go_exports(specs: DataFrame, resolved: DataFrame, exports: DataFrame) -> DataFrame:
    """``(file_id, line_no, module, n_names)``: for every Go import how many names the package exports, 0 if it is not known."""
    keys = ["file_id", "line_no", "module"]
    offered = exports.select(F.col("file_id").alias("target_id"), F.col("name").alias("exported"))
    met = resolved.where("target_id >= 0").join(offered, "target_id").select(*keys, "exported")
    rows = specs.where("lang = 'go'").select(*keys).distinct().join(met, keys, "left")
    return rows.groupBy(*keys).agg(F.count_distinct("exported").alias("n_names"))
