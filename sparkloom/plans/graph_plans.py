"""Graph operators on edges derived from the order tables, from revisions and from Python sources."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sparkloom.functions.text import language
from sparkloom.operators import frontend
from sparkloom.operators.latest import latest_rows
from sparkloom.operators.ranges import last_value_before
from sparkloom.operators.textsearch import consecutive, resolved_names
from sparkloom.operators.traverse import Graph, expand, first_nodes, reach, reached_targets
from sparkloom.sources.artifact_store import ArtifactStore, file_outline, symbol_search
from sparkloom.sources.shared import shared_dir, written
from sparkloom.sources.tables import table


def _id(letter: str, column: str):
    return F.concat(F.lit(letter + ":"), F.col(column).cast("string"))


def order_edges(spark, sf_dir) -> DataFrame:
    """customer -> order -> supplier -> nation -> region and order -> part."""
    read = lambda name: table(spark, sf_dir, name)
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts = [
        read("orders").select(_id("C", "o_custkey").alias("src"), _id("O", "o_orderkey").alias("dst"), F.lit("ORDERED").alias("kind")),
        lines.select(_id("O", "l_orderkey").alias("src"), _id("S", "l_suppkey").alias("dst"), F.lit("SUPPLIED").alias("kind")),
        lines.select(_id("O", "l_orderkey").alias("src"), _id("P", "l_partkey").alias("dst"), F.lit("PART").alias("kind")),
        read("supplier").select(_id("S", "s_suppkey").alias("src"), _id("N", "s_nationkey").alias("dst"), F.lit("IN").alias("kind")),
        read("nation").select(_id("N", "n_nationkey").alias("src"), _id("R", "n_regionkey").alias("dst"), F.lit("IN").alias("kind")),
    ]
    return reduce(DataFrame.unionByName, parts)


_EDGES = """edges AS (
SELECT 'C:' || o_custkey AS src, 'O:' || o_orderkey AS dst, 'ORDERED' AS kind FROM orders
UNION ALL SELECT 'O:' || l_orderkey, 'S:' || l_suppkey, 'SUPPLIED' FROM lineitem
UNION ALL SELECT 'O:' || l_orderkey, 'P:' || l_partkey, 'PART' FROM lineitem
UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'IN' FROM supplier
UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'IN' FROM nation)"""
_REACH = "WITH RECURSIVE " + _EDGES + ", found(node, depth) AS ({starts} UNION SELECT {to}, depth + 1 FROM found JOIN edges ON {frm} = node WHERE depth < {steps} {more})"


def _nodes(rows: DataFrame, column: str, letter: str) -> DataFrame:
    return rows.select(_id(letter, column).alias("node"))


def _building(spark, sf_dir):
    """The customers of a segment; the ``_all`` queries start from all customers."""
    return _nodes(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey", "C")


_BUILDING = "SELECT 'C:' || c_custkey, 0 FROM customer WHERE c_mktsegment = 'BUILDING'"


def _one(spark, node: str) -> DataFrame:
    return spark.createDataFrame([(node,)], "node string")


def _customers(spark, sf_dir) -> DataFrame:
    return _nodes(table(spark, sf_dir, "customer"), "c_custkey", "C")


def _slice_forward(spark, sf_dir, starts: DataFrame) -> DataFrame:
    return reach(Graph(order_edges(spark, sf_dir)), starts, 4, together=True).select("node", "depth")


def g_slice_forward(spark, sf_dir):
    return _slice_forward(spark, sf_dir, _building(spark, sf_dir))


def g_slice_forward_all(spark, sf_dir):
    return _slice_forward(spark, sf_dir, _customers(spark, sf_dir))


def g_slice_backward(spark, sf_dir):
    return reach(Graph.reversed(order_edges(spark, sf_dir)), _one(spark, "N:3"), 3, together=True).select("node", "depth")


def _query_depth(spark, sf_dir, starts: DataFrame) -> DataFrame:
    found = reach(Graph(order_edges(spark, sf_dir)), starts, 2, together=True).select("node", "depth")
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"))


def g_query_depth(spark, sf_dir):
    return _query_depth(spark, sf_dir, _building(spark, sf_dir))


def g_query_depth_all(spark, sf_dir):
    return _query_depth(spark, sf_dir, _customers(spark, sf_dir))


def _regions(spark, sf_dir) -> DataFrame:
    return _nodes(table(spark, sf_dir, "region"), "r_regionkey", "R")


def _reachability_len(spark, sf_dir, starts: DataFrame) -> DataFrame:
    found = reached_targets(order_edges(spark, sf_dir), starts, _regions(spark, sf_dir), 5, kinds=["ORDERED", "SUPPLIED", "IN"])
    return found.select(F.col("start").alias("src"), F.col("target").alias("dst"), F.col("depth").alias("distance"))


def g_reachability_len(spark, sf_dir):
    return _reachability_len(spark, sf_dir, _building(spark, sf_dir))


def g_reachability_len_all(spark, sf_dir):
    return _reachability_len(spark, sf_dir, _customers(spark, sf_dir))


def g_slice_store_cap(spark, sf_dir):
    found = reach(Graph.reversed(order_edges(spark, sf_dir)), _one(spark, "R:2"), 3, together=True).select("node", "depth")
    return first_nodes(found, 500)


def g_callgraph_edges(spark, sf_dir):
    return expand(Graph(order_edges(spark, sf_dir)), _building(spark, sf_dir), 2)


def g_callgraph_edges_all(spark, sf_dir):
    return expand(Graph(order_edges(spark, sf_dir)), _customers(spark, sf_dir), 2)


def _taint_reach(spark, sf_dir, starts: DataFrame) -> DataFrame:
    """Regions that customers' orders reach when nothing passes the suppliers of nation 3 (the sanitizers)."""
    barred = _nodes(table(spark, sf_dir, "supplier").where("s_nationkey = 3"), "s_suppkey", "S")
    found = reached_targets(order_edges(spark, sf_dir), starts, _regions(spark, sf_dir), 5, blocked=barred)
    return found.select(F.col("start").alias("source"), F.col("target").alias("sink"))


def g_taint_reach(spark, sf_dir):
    return _taint_reach(spark, sf_dir, _building(spark, sf_dir))


def g_taint_reach_all(spark, sf_dir):
    return _taint_reach(spark, sf_dir, _customers(spark, sf_dir))


def _neighbors(spark, sf_dir, starts: DataFrame, limit: int, kinds: list[str] | None = None) -> DataFrame:
    frontier = starts.select(F.col("node").alias("src")).distinct()
    chars = frontier.agg(F.sum(F.length("src"))).first()[0] or 0
    return Graph(order_edges(spark, sf_dir)).leaving(frontier, chars, kinds, limit).select("src", "dst", "kind")


def g_neighbors(spark, sf_dir):
    """The first three neighbours of every customer's order, in the order (kind, node)."""
    return _neighbors(spark, sf_dir, _nodes(table(spark, sf_dir, "orders"), "o_orderkey", "O"), 3)


def g_neighbors_kinds(spark, sf_dir):
    """The same over edges of one kind."""
    return _neighbors(spark, sf_dir, _nodes(table(spark, sf_dir, "orders"), "o_orderkey", "O"), 2, ["SUPPLIED"])


def g_cfg_chain(spark, sf_dir):
    return consecutive(table(spark, sf_dir, "lineitem").distinct(), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_partkey")


def g_cfg_region(spark, sf_dir):
    chain = consecutive(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")
    edges = chain.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("CFG").alias("kind"))
    starts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).cast("string").alias("node"))
    return expand(Graph(edges), starts.select("node"), 2).select("level", "src", "dst")


def g_def_use(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    signed = F.when(F.col("event_type") == "signup", F.col("event_id"))
    linked = last_value_before(events, ["user_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], signed, "def_id")
    return linked.where("event_type = 'purchase' and def_id is not null").select("user_id", F.col("event_id").alias("use_id"), "def_id")


def g_resolve_calls(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    part = table(spark, sf_dir, "part")
    named = uses.join(part.select("p_partkey", "p_name"), "p_partkey")
    found = resolved_names(named, part.select("p_name", F.col("p_partkey").alias("symbol")), ["p_name"], "symbol", "symbol")
    return found.groupBy("p_name", "symbol").agg(F.count(F.lit(1)).alias("n_calls"))


def g_build_resolve(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    uses = part.select("p_partkey", "p_brand", "p_type")
    symbols = part.where("p_size <= 10").select("p_brand", "p_type", F.col("p_partkey").alias("symbol"))
    return resolved_names(uses, symbols, ["p_brand", "p_type"], "symbol", "symbol").select("p_partkey", F.coalesce("symbol", F.lit(-1)).alias("symbol"))


def g_revision_chain(spark, sf_dir):
    """Revisions reached over ``base_rev`` from each revision without a known base."""
    revisions = table(spark, sf_dir, "revisions")
    edges = revisions.where("base_rev is not null").select(F.col("base_rev").alias("src"), F.col("rev").alias("dst"), F.lit("BASE").alias("kind"))
    roots = revisions.where("base_rev is null").select(F.col("rev").alias("node"))
    return reach(Graph(edges), roots, 50).select("origin", "node", "depth")


def g_python_symbols(spark, sf_dir):
    return frontend.symbols(frontend.python_nodes(table(spark, sf_dir, "parsed_files")))


def g_python_tree(spark, sf_dir):
    return frontend.tree_edges(frontend.python_nodes(table(spark, sf_dir, "parsed_files")))


def g_python_flow(spark, sf_dir):
    return frontend.flow_edges(frontend.python_nodes(table(spark, sf_dir, "parsed_files")))


def g_python_calls(spark, sf_dir):
    return frontend.resolved_calls(written(frontend.python_nodes(table(spark, sf_dir, "parsed_files")), "nodes"))


def g_python_def_use(spark, sf_dir):
    return frontend.def_use_edges(frontend.python_nodes(table(spark, sf_dir, "parsed_files")))


def g_python_taint(spark, sf_dir):
    """What is read from a row or opened that reaches a call keeping or returning it in another order."""
    nodes = written(frontend.python_nodes(table(spark, sf_dir, "parsed_files")), "nodes")
    return frontend.taint(nodes, ["row.get", "open"], ["setdefault", "sorted", "append"], ["len"])


def _python(spark, sf_dir):
    return written(frontend.python_nodes(table(spark, sf_dir, "parsed_files")), "nodes")


def g_python_branches(spark, sf_dir):
    return frontend.branch_edges(_python(spark, sf_dir))


def g_python_value_flow(spark, sf_dir):
    return frontend.value_flow(_python(spark, sf_dir))


def g_python_call_edges(spark, sf_dir):
    return frontend.call_edges(frontend.resolved_calls(_python(spark, sf_dir), last_name=True))


def g_python_tagged(spark, sf_dir):
    """Calls whose names are sources, sinks or sanitizers, and symbols that have such a name."""
    nodes = _python(spark, sf_dir)
    calls = frontend.tagged_calls(nodes).select("file_id", "seq", "name", "role")
    named = frontend.tagged(frontend.symbols(nodes)).where("kind in ('source', 'sink')")
    return calls.unionByName(named.select("file_id", "seq", "name", F.col("kind").alias("role")))


def g_python_taint_paths(spark, sf_dir):
    return frontend.taint_paths(_python(spark, sf_dir), ["row.get", "open"], ["setdefault", "sorted", "append"], ["len"])


def _indexed(spark, sf_dir):
    """All parsed files as one revision of an artifact store in the shared folder."""
    rows = latest_rows(table(spark, sf_dir, "parsed_files").where("file_id is not null and source is not null").select("file_id", "parsed_at", "path", "source"), "file_id", "parsed_at", ["path", "source"])
    files = rows.select("path", language(F.col("path")).alias("lang"), F.octet_length("source").cast("bigint").alias("size"), "source", F.sha2("source", 256).alias("blob_hash"))
    store = ArtifactStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.index_revision("all", files)
    return store


def g_store_edges(spark, sf_dir):
    return _indexed(spark, sf_dir).at_rev("edges", "all", ["DDG", "CFG_BRANCH"]).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n_edges"))


def g_store_counts(spark, sf_dir):
    return _indexed(spark, sf_dir).counts()


def q_symbol_search(spark, sf_dir):
    store = _indexed(spark, sf_dir)
    return symbol_search(store.at_rev("symbols", "all"), store.at_rev("calls", "all"), "load", "python")[0]


def q_call_sites(spark, sf_dir):
    store = _indexed(spark, sf_dir)
    return symbol_search(store.at_rev("symbols", "all"), store.at_rev("calls", "all"), "load", "python")[1]


def q_file_outline(spark, sf_dir):
    store = _indexed(spark, sf_dir)
    return file_outline(store.at_rev("symbols", "all"), store.at_rev("calls", "all"))


_FORWARD = {"to": "dst", "frm": "src"}
QUERIES = {f.__name__: f for f in (
    g_slice_forward, g_slice_backward, g_query_depth, g_reachability_len, g_slice_store_cap, g_callgraph_edges, g_taint_reach, g_cfg_chain, g_cfg_region, g_def_use,
    g_resolve_calls, g_build_resolve, g_revision_chain, g_python_symbols, g_python_tree, g_python_flow, g_python_calls, g_python_def_use, g_python_taint,
    g_neighbors, g_neighbors_kinds, g_python_branches, g_python_value_flow, g_python_call_edges, g_python_tagged, g_python_taint_paths, g_store_edges, g_store_counts, q_symbol_search, q_call_sites, q_file_outline,
    g_slice_forward_all, g_query_depth_all, g_reachability_len_all, g_callgraph_edges_all, g_taint_reach_all,
)}
SQL = {
    "g_slice_forward": _REACH.format(starts=_BUILDING, steps=4, more="", **_FORWARD) + " SELECT node, min(depth)::INTEGER AS depth FROM found GROUP BY node",
    "g_slice_backward": _REACH.format(starts="SELECT 'N:3', 0", steps=3, more="", to="src", frm="dst") + " SELECT node, min(depth)::INTEGER AS depth FROM found GROUP BY node",
    "g_query_depth": _REACH.format(starts=_BUILDING, steps=2, more="", **_FORWARD) + " SELECT depth::INTEGER AS depth, count(*) AS n_nodes FROM (SELECT node, min(depth) AS depth FROM found GROUP BY node) GROUP BY depth",
    "g_reachability_len": "WITH RECURSIVE " + _EDGES + """, found(origin, node, depth) AS (SELECT 'C:' || c_custkey, 'C:' || c_custkey, 0 FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION SELECT origin, dst, depth + 1 FROM found JOIN edges ON src = node WHERE depth < 5 AND kind IN ('ORDERED', 'SUPPLIED', 'IN'))
        SELECT origin AS src, node AS dst, min(depth)::INTEGER AS distance FROM found WHERE starts_with(node, 'R:') GROUP BY ALL""",
    "g_slice_store_cap": _REACH.format(starts="SELECT 'R:2', 0", steps=3, more="", to="src", frm="dst") + " SELECT node, min(depth)::INTEGER AS depth FROM found GROUP BY node ORDER BY min(depth), node LIMIT 500",
    "g_callgraph_edges": "WITH " + _EDGES + """, starts AS (SELECT DISTINCT 'C:' || c_custkey AS src FROM customer WHERE c_mktsegment = 'BUILDING'), one AS (SELECT 1 AS level, src, dst, kind FROM edges JOIN starts USING (src)),
        inner_ends AS (SELECT DISTINCT dst AS src FROM one), two AS (SELECT 2 AS level, src, dst, kind FROM edges JOIN inner_ends USING (src)) SELECT * FROM one UNION ALL SELECT * FROM two""",
    "g_taint_reach": "WITH RECURSIVE " + _EDGES + """, found(origin, node, depth) AS (SELECT 'C:' || c_custkey, 'C:' || c_custkey, 0 FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION SELECT origin, dst, depth + 1 FROM found JOIN edges ON src = node WHERE depth < 5 AND node NOT IN (SELECT 'S:' || s_suppkey FROM supplier WHERE s_nationkey = 3))
        SELECT DISTINCT origin AS source, node AS sink FROM found WHERE starts_with(node, 'R:')""",
    "g_neighbors": "WITH " + _EDGES + " SELECT src, dst, kind FROM edges WHERE starts_with(src, 'O:') QUALIFY row_number() OVER (PARTITION BY src ORDER BY kind, dst) <= 3",
    "g_neighbors_kinds": "WITH " + _EDGES + " SELECT src, dst, kind FROM edges WHERE kind = 'SUPPLIED' QUALIFY row_number() OVER (PARTITION BY src ORDER BY kind, dst) <= 2",
    "g_cfg_chain": """SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst
        FROM (SELECT DISTINCT * FROM lineitem)) WHERE dst IS NOT NULL""",
    "g_cfg_region": """WITH chain AS (SELECT * FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER w AS dst, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE dst IS NOT NULL)
        SELECT k::INTEGER AS level, src::VARCHAR AS src, dst::VARCHAR AS dst FROM chain WHERE k <= 2""",
    "g_def_use": """SELECT user_id, event_id AS use_id, def_id FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_id FROM events) WHERE event_type = 'purchase' AND def_id IS NOT NULL""",
    "g_resolve_calls": """SELECT p_name, symbol, count(*) AS n_calls FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT p_name, min(p_partkey) AS symbol FROM part GROUP BY p_name) USING (p_name) GROUP BY ALL""",
    "g_build_resolve": "SELECT p_partkey, coalesce(symbol, -1) AS symbol FROM part LEFT JOIN (SELECT p_brand, p_type, min(p_partkey) AS symbol FROM part WHERE p_size <= 10 GROUP BY ALL) USING (p_brand, p_type)",
    "g_revision_chain": """WITH RECURSIVE found(origin, node, depth) AS (SELECT rev, rev, 0 FROM revisions WHERE base_rev IS NULL UNION SELECT origin, rev, depth + 1 FROM found JOIN revisions ON base_rev = node WHERE depth < 50)
        SELECT origin, node, min(depth)::INTEGER AS depth FROM found GROUP BY ALL""",
}
#: All customers instead of a segment's.
SQL |= {f"{name}_all": SQL[name].replace(" WHERE c_mktsegment = 'BUILDING'", "") for name in ("g_slice_forward", "g_query_depth", "g_reachability_len", "g_callgraph_edges", "g_taint_reach")}
