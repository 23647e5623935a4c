"""Store of syntax artifacts by content: nodes, edges, symbols and calls.

Contents are parsed once, whatever revisions and paths hold them. Artifacts are keyed by content alone; a revision's are
those of the contents that it holds, each under every path that has it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sparkloom.operators import frontend
from sparkloom.sources.blob_store import BlobStore
from sparkloom.sources.shared import written

#: Columns of each table; nodes are numbered within their content.
TABLES = {
    "nodes": "blob_hash string, seq int, parent int, kind string, name string, role string, start_line int, start_col int, end_line int, end_col int",
    "edges": "blob_hash string, src int, dst int, kind string, name string, via string",
    "symbols": "blob_hash string, seq int, name string, kind string, start_line int",
    "calls": "blob_hash string, seq int, name string, start_line int",
}


class ArtifactStore(BlobStore):
    def artifacts(self, name: str) -> DataFrame:
        return self._read(name, TABLES[name])

    def indexed(self) -> DataFrame:
        """``(blob_hash)`` of the contents that were parsed, those without a node included."""
        return self._read("indexed", "blob_hash string")

    def put(self, name: str, rows: DataFrame) -> None:
        """Appends a table's rows of contents that it has none of; doing it again changes nothing."""
        known = self.artifacts(name).select("blob_hash").distinct()
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows.join(known, "blob_hash", "left_anti").select(*columns).write.mode("append").parquet(f"{self.root}/{name}")

    def index_revision(self, rev: str, files: DataFrame) -> int:
        """Adds a revision of ``files`` (as from ``scan_tree``) and the artifacts of its new Python contents; how many these are."""
        self.add_revision(rev, files)
        new = files.where("lang = 'python'").select("blob_hash", "source").join(self.indexed(), "blob_hash", "left_anti").dropDuplicates(["blob_hash"])
        new = written(new, "new-contents")
        nodes = written(frontend.nodes_of(new.select(F.col("blob_hash").alias("file_id"), "source")), "nodes")
        none = F.lit(None).cast("string")
        plain = [frontend.tree_edges(nodes), frontend.flow_edges(nodes), frontend.branch_edges(nodes)]
        edges = reduce(DataFrame.unionByName, [e.select("file_id", "src", "dst", "kind", none.alias("name"), none.alias("via")) for e in plain])
        edges = edges.unionByName(frontend.value_flow(nodes).select("file_id", "src", "dst", "kind", "name", "via"))
        calls = nodes.where("role = 'call' and name is not null").select("file_id", "seq", "name", "start_line")
        for name, rows in (("nodes", nodes), ("edges", edges), ("symbols", frontend.tagged(frontend.symbols(nodes))), ("calls", calls)):
            self.put(name, rows.withColumnRenamed("file_id", "blob_hash"))
        new.select("blob_hash").write.mode("append").parquet(f"{self.root}/indexed")
        return new.count()

    def at_rev(self, name: str, rev: str, kinds: list[str] | None = None) -> DataFrame:
        """A table's rows in a revision, with ``path`` and ``lang``: of every file, though others have the same content."""
        files = self.versions().where(F.col("rev") == rev).select("path", "lang", "blob_hash")
        rows = self.artifacts(name)
        return (rows if kinds is None else rows.where(F.col("kind").isin(*kinds))).join(files, "blob_hash")

    def counts(self) -> DataFrame:
        """Symbols and calls of every content that has some."""
        count = lambda name: self.artifacts(name).groupBy("blob_hash").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        rows = count("symbols").join(count("calls"), "blob_hash", "full")
        return rows.select("blob_hash", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"))


def symbol_search(symbols: DataFrame, calls: DataFrame, query: str, lang: str | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Symbols of a name, or if there is none, those containing it in any case, the first ``limit`` in the order (exact, path, line);
    and the call sites of the names found, at most twenty times as many (Q-SYM).

    ``symbols`` and ``calls`` as from ``at_rev``. A dotted call counts by its last name.
    """
    if lang:
        symbols, calls = symbols.where(F.col("lang") == lang), calls.where(F.col("lang") == lang)
    exact = symbols.where(F.col("name") == query)
    hits = symbols.where(F.contains(F.lower("name"), F.lit(query.lower()))) if exact.isEmpty() else exact
    hits = hits.orderBy((F.col("name") != query), "path", "start_line", "seq").limit(limit)
    names = F.broadcast(hits.select(F.col("name").alias("called")).distinct())  # at most ``limit`` rows
    sites = calls.withColumn("called", F.substring_index("name", ".", -1)).join(names, "called", "left_semi").select("path", "start_line", "seq", "name").distinct()
    return hits.select("path", "name", "kind", "start_line"), sites.orderBy("path", "start_line", "seq").limit(20 * limit)


def file_outline(symbols: DataFrame, calls: DataFrame, limit: int = 500) -> DataFrame:
    """``(path, symbols, calls)``: each file's symbols and calls in the order of their lines, at most ``limit`` of each (Q-AST)."""
    from sparkloom.operators.store import first_per_group

    def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        first = first_per_group(rows.select("path", "start_line", "seq", *columns), ["path"], [F.col("start_line"), F.col("seq")], limit)
        ordered = F.array_sort(F.collect_list(F.struct("rank", "start_line", *columns)))
        return first.groupBy("path").agg(ordered.alias(name))

    return listed(symbols, "symbols", "name", "kind").join(listed(calls, "calls", "name"), "path", "full")
