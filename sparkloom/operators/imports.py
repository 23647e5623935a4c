"""Where imports lead, and what depends on what (Q-RES, G12-G14, J9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom.functions.text import language
from sparkloom.operators.import_specs import even
from sparkloom.operators.textsearch import imports

_TS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]


def resolved_imports(texts: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, line_no, module, target_id)``: imports with the file of the same repository that they name, else -1.

    Every import has a few candidate paths (module or package, beside the file or below the repository); the candidates
    are joined to the paths by equality. Java's are keyed by the file's name and then compared by their end. The smallest
    matching id counts.
    """
    known = files.select("file_id", "path", "repo_name").where("file_id is not null and path is not null")
    found = imports(texts).join(known, "file_id").withColumn("lang", language(F.col("path")))
    beside = F.regexp_replace("path", r"/[^/]*$", "")
    dotted = F.regexp_replace("module", r"\.", "/")
    lit = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    python = F.array(*[lit(base, "/", dotted, end) for base in (F.col("repo_name"), beside) for end in (".py", "/__init__.py")])
    script = F.when(F.col("module").startswith("."), F.array(*[lit(beside, "/", F.col("module"), end) for end in _TS])).otherwise(F.array())
    ruby = F.array(lit(beside, "/", F.col("module"), ".rb"), lit(F.col("repo_name"), "/", F.col("module"), ".rb"))
    candidates = F.when(F.col("lang") == "python", python).when(F.col("lang") == "typescript", script).when(F.col("lang") == "ruby", ruby)
    tried = found.select("file_id", "line_no", "module", F.explode(F.transform(candidates, even)).alias("path"))
    by_path = tried.join(known.select("path", F.col("file_id").alias("target_id")), "path").select("file_id", "line_no", "module", "target_id")
    java = found.where("lang = 'java'").withColumn("name", F.concat(F.substring_index("module", ".", -1), F.lit(".java"))).withColumn("end", F.concat(F.lit("/"), dotted, F.lit(".java")))
    named = known.select(F.substring_index("path", "/", -1).alias("name"), "repo_name", F.col("path").alias("other"), F.col("file_id").alias("target_id"))
    by_name = java.join(named, ["name", "repo_name"]).where(F.endswith("other", "end")).select("file_id", "line_no", "module", "target_id")
    target = by_path.unionByName(by_name).groupBy("file_id", "line_no", "module").agg(F.min("target_id").alias("target_id"))
    return found.select("file_id", "line_no", "module").distinct().join(target, ["file_id", "line_no", "module"], "left").withColumn("target_id", F.coalesce("target_id", F.lit(-1)))


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """Edges between files for ``traverse.reach``."""
    edges = resolved.where("target_id >= 0 and target_id <> file_id").select(F.col("file_id").cast("string").alias("src"), F.col("target_id").cast("string").alias("dst"))
    return edges.distinct().withColumn("kind", F.lit("IMPORT"))


def signatures(texts: DataFrame, per_name: int = 5) -> DataFrame:
    """``(name, file_id, line_no, signature)``: the declaring line of the first ``per_name`` declarations of a name (Q-SIG)."""
    from sparkloom.operators.store import first_per_group
    from sparkloom.operators.textsearch import declarations

    declared = declarations(texts).select("file_id", "line_no", "name", F.trim("line").alias("signature"))
    return first_per_group(declared, ["name"], [F.col("file_id"), F.col("line_no")], per_name).drop("rank")


def directory_map(files: DataFrame, depth: int = 10) -> DataFrame:
    """Files below every directory of a repository down to ``depth`` (S11): counts merge, no list is collected."""
    parts = F.split("path", "/")
    levels = F.sequence(F.lit(1), F.least(F.lit(depth), F.size(parts) - 1))
    inside = files.where(F.col("path").contains("/")).select("repo_name", F.explode(F.transform(levels, lambda k: F.array_join(F.slice(F.split(F.col("path"), "/"), F.lit(1), k), "/"))).alias("directory"))
    return inside.groupBy("repo_name", "directory").agg(F.count(F.lit(1)).alias("n_files"))
