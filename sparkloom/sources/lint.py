"""Output of linters as rows ``(file, line, message, severity, code)`` (L1-L5, L7, V1). The input column is ``output``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions.text import extension

ROW = "file string, line int, message string, severity string, code string"
_RUFF = "array<struct<filename:string,message:string,code:string,location:struct<row:int,column:int>>>"
_BIOME = "struct<diagnostics:array<struct<severity:string,category:string,message:string,location:struct<path:string,line:int>>>>"


def _field(text: Column, *names: str) -> Column:
    """A string, or the first of the named fields where the text is a JSON object with them."""
    inner = [F.nullif(F.get_json_object(F.when(F.startswith(text, F.lit("{")), text), f"$.{n}"), F.lit("")) for n in names]
    return F.when(F.startswith(text, F.lit("{")), F.coalesce(*inner, F.lit(""))).otherwise(text)


_PMD = "struct<files:array<struct<filename:string,violations:array<struct<beginline:int,description:string,rule:string,priority:int>>>>>"


def _relative(path: Column, root: str) -> Column:
    """Path below ``root``; null for an absolute path outside of it."""
    inside = F.startswith(path, F.lit(root.rstrip("/") + "/"))
    return F.when(inside, F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).when(~F.startswith(path, F.lit("/")), path)


def ruff(outputs: DataFrame, root: str) -> DataFrame:
    """JSON array, single object or JSON lines; ``W``/``I`` are warnings, ``N``/``UP`` informative, the rest errors."""
    text = F.trim("output")
    lines = F.regexp_replace(text, r"\}\s*\n\s*\{", "},{")
    found = F.from_json(F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), lines, F.lit("]"))), _RUFF)
    rows = outputs.select(F.explode(found).alias("d")).select("d.*").withColumn("code", _field(F.col("code"), "code", "name"))
    severity = F.when(F.col("code").rlike("^[WI]"), "warning").when(F.col("code").rlike("^(N|UP)"), "info").otherwise("error")
    return rows.select(_relative(F.col("filename"), root).alias("file"), F.col("location.row").alias("line"), "message", severity.alias("severity"), "code").where("file is not null")


def biome(outputs: DataFrame, root: str) -> DataFrame:
    """Errors only; lines are counted from 0."""
    rows = outputs.select(F.explode(F.from_json("output", _BIOME)["diagnostics"]).alias("d")).where("d.severity = 'error'")
    return rows.select(_relative(F.col("d.location.path"), root).alias("file"), (F.col("d.location.line") + 1).alias("line"), _field(F.col("d.message"), "text", "message").alias("message"), F.lit("error").alias("severity"), F.col("d.category").alias("code")).where("file is not null")


def go_vet(outputs: DataFrame, root: str) -> DataFrame:
    """``file:line[:column]: message`` lines; the code is inferred from the message."""
    pattern = r"^(.+?\.go):(\d+):(?:\d+:)?\s*(.+)$"
    lines = outputs.select(F.explode(F.split("output", "\n")).alias("l")).where(F.col("l").rlike(pattern))
    message = F.regexp_extract("l", pattern, 3)
    low = F.lower(message)
    code = F.when(low.contains("printf"), "printf").when(low.contains("unused"), "unused").when(low.contains("nil"), "nil").otherwise("vet")
    file = F.regexp_replace(F.regexp_extract("l", pattern, 1), r"^\./", "")
    return lines.select(_relative(file, root).alias("file"), F.regexp_extract("l", pattern, 2).cast("int").alias("line"), message.alias("message"), F.lit("error").alias("severity"), code.alias("code")).where("file is not null")


def pmd(outputs: DataFrame, root: str) -> DataFrame:
    """Priorities up to 2 are errors, 3 a warning, the rest informative."""
    files = outputs.select(F.explode(F.from_json("output", _PMD)["files"]).alias("f"))
    rows = files.select(_relative(F.col("f.filename"), root).alias("file"), F.explode("f.violations").alias("v"))
    severity = F.when(F.col("v.priority") <= 2, "error").when(F.col("v.priority") == 3, "warning").otherwise("info")
    return rows.select("file", F.col("v.beginline").alias("line"), F.col("v.description").alias("message"), severity.alias("severity"), F.col("v.rule").alias("code")).where("file is not null")


#: Checkers of each extension (fixed values).
CHECKERS = {"py": ["ruff"], "pyi": ["ruff"], "ts": ["biome"], "tsx": ["biome"], "js": ["biome"], "jsx": ["biome"], "mjs": ["biome"], "cjs": ["biome"], "go": ["go_vet"], "java": ["pmd"]}


def checkers_of(files: DataFrame) -> DataFrame:
    """``files`` (``path``) with a row for each ``checker`` of its extension (L5); others have none."""
    known = F.create_map(*[x for e, names in CHECKERS.items() for x in (F.lit(e), F.array(*map(F.lit, names)))])
    return files.withColumn("checker", F.explode(F.try_element_at(known, extension(F.col("path")))))


def requested(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of the files asked for (``path``), however the tool got at others (L4)."""
    return findings.join(files.select(F.col("path").alias("file")), "file", "left_semi")


TOOLS = {"ruff": ruff, "biome": biome, "go_vet": go_vet, "pmd": pmd}


def all_findings(outputs: DataFrame, root: str) -> DataFrame:
    """Findings of the known tools in ``(tool, output)``; what cannot be read gives no rows."""
    parts = [read(outputs.where(F.col("tool") == tool), root).withColumn("tool", F.lit(tool)) for tool, read in TOOLS.items()]
    return reduce(DataFrame.unionByName, parts)


def as_risks(findings: DataFrame) -> DataFrame:
    """Findings as risk items of confidence 0.8 on their line (V1)."""
    return findings.select(
        F.lit("Syntax_Static_Errors").alias("risk_type"), F.col("file").alias("file_path"), F.struct(F.col("line").alias("start"), F.col("line").alias("end")).alias("line_number"),
        F.concat(F.lit("["), "code", F.lit("] "), "message").alias("description"), F.lit(0.8).alias("confidence"), "severity",
    )
