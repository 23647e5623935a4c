"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.functions.text import LANGUAGE_OF, language

#: Directories that are never scanned (fixed values).
SKIPPED = [".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", "node_modules", "dist", "build", "target", "vendor", ".venv", "venv"]
MAX_BYTES = 2_000_000


def scan_tree(
    spark: SparkSession, root: str, languages: list[str] | None = None, skipped: list[str] = SKIPPED, max_bytes: int = MAX_BYTES, paths: DataFrame | None = None
) -> DataFrame:
    """``(path, lang, size, source, blob_hash)`` of the source files below ``root``, paths relative to it.

    Size and name filters reach the reader, so that no content of a file left out is read. Files of unknown extensions or
    above ``max_bytes`` and all below skipped directories are left out; an empty tree gives no rows. ``paths``: only the files whose
    relative ``path`` it has (S3), by the same rules.
    """
    names = "*.{" + ",".join(LANGUAGE_OF) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    inner = F.regexp_replace("path", "^.*?" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in root.rstrip("/")) + "/", "")
    barred = "(^|/)(" + "|".join(s.replace(".", "\\.") for s in skipped) + ")/"
    lang = language(inner)
    kept = rows.where((F.col("length") <= max_bytes) & ~inner.rlike(barred) & lang.isNotNull())
    if languages:
        kept = kept.where(lang.isin(*languages))
    kept = kept.select(inner.alias("path"), lang.alias("lang"), F.col("length").alias("size"), F.col("content").alias("source"), F.sha2("content", 256).alias("blob_hash"))
    return kept if paths is None else kept.join(paths.select("path"), "path", "left_semi")


def load_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of whole text files, such as diffs (S16): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_texts(texts: DataFrame, max_lines: int | None = None) -> DataFrame:
    """``texts`` (``path``, ``text``) as ``(path, content, line_count)``, at most ``max_lines`` lines with a note of how many more
    there are (S17, S18). A line ends at a line feed; what follows the last one is a line too."""
    ends = F.size(F.split("text", "\n")) - 1
    count = ends + F.when(F.endswith("text", F.lit("\n")) | (F.col("text") == ""), 0).otherwise(1)
    rows = texts.where("text is not null").select("path", F.col("text"), count.alias("line_count"))
    if not max_lines:
        return rows.select("path", F.col("text").alias("content"), "line_count")
    head = F.concat(F.substring_index("text", "\n", max_lines), F.lit("\n\n... (truncated, "), (F.col("line_count") - max_lines).cast("string"), F.lit(" more lines)"))
    return rows.select("path", F.when(F.col("line_count") > max_lines, head).otherwise(F.col("text")).alias("content"), "line_count")
