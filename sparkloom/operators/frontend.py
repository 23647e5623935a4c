"""Code property graph of Python sources (S4, G1-G11, G13, Q-RES-PY).

The parser runs inside the tasks and yields nodes in preorder; everything else (control flow, calls, definitions and
uses, name resolution) is derived from the node table by windows and joins.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sparkloom.functions.text import TAINT_NAMES
from sparkloom.operators.latest import latest_rows
from sparkloom.sources.tables import spread

NODES = "file_id bigint, seq int, parent int, kind string, name string, role string, start_line int, start_col int, end_line int, end_col int, around int"

_KINDS = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Call": "call", "Name": "identifier", "Attribute": "attribute",
    "Assign": "assignment", "AugAssign": "assignment", "AnnAssign": "assignment", "Expr": "expression_statement", "Return": "return_statement", "If": "if_statement", "For": "for_statement",
    "AsyncFor": "for_statement", "While": "while_statement", "With": "with_statement", "Try": "try_statement", "Raise": "raise_statement", "Assert": "assert_statement", "Import": "import_statement", "ImportFrom": "import_from_statement",
}


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return None


def _name(node: ast.AST) -> str | None:
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return node.name
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    if isinstance(node, ast.Import):
        return ",".join(a.name for a in node.names)
    if isinstance(node, ast.ImportFrom):
        return "." * node.level + (node.module or "")
    return _dotted(node)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file, source in zip(batch["file_id"], batch["source"]):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    todo = [(-1, None, ast.parse(bytes(source)))]
            except (SyntaxError, ValueError, RecursionError):
                continue
            seq = 0
            while todo:
                parent, around, node = todo.pop()
                at = parent
                if hasattr(node, "lineno"):
                    role = "declaration" if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else "statement" if isinstance(node, ast.stmt) else "call" if isinstance(node, ast.Call) else "store" if isinstance(getattr(node, "ctx", None), ast.Store) else "load" if isinstance(node, ast.Name) else "expression"
                    kind = _KINDS.get(type(node).__name__, type(node).__name__)
                    rows.append((file, seq, parent, kind, _name(node), role, node.lineno, node.col_offset + 1, node.end_lineno, node.end_col_offset + 1, around))
                    if role == "call" or kind == "assignment":
                        around = seq
                    at, seq = seq, seq + 1
                todo += [(at, around, child) for child in reversed(list(ast.iter_child_nodes(node)))]
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])
        yield frame.astype({"around": "Int32"})


def nodes_of(sources: DataFrame) -> DataFrame:
    """Nodes of Python ``source``s by their ``file_id`` (of any type); what does not parse has none."""
    kind = sources.schema["file_id"].dataType.simpleString()
    return sources.select("file_id", "source").mapInPandas(_parsed, NODES.replace("file_id bigint", f"file_id {kind}"))


def python_nodes(parsed: DataFrame) -> DataFrame:
    """Nodes of every Python file's latest parse; files that do not parse have none."""
    rows = parsed.where(F.col("path").rlike(r"(?i)\.py$") & F.col("source").isNotNull() & F.col("file_id").isNotNull())
    best = latest_rows(spread(rows.select("file_id", "parsed_at", "source")), "file_id", "parsed_at", ["source"])
    return nodes_of(best)


def tree_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent >= 0").select("file_id", F.col("parent").alias("src"), F.col("seq").alias("dst"), F.lit("AST").alias("kind"))


def flow_edges(nodes: DataFrame) -> DataFrame:
    """``CFG`` edges between consecutive statements of a file."""
    order = Window.partitionBy("file_id").orderBy("seq")
    statements = nodes.where(F.col("role").isin("statement", "declaration"))
    return statements.select("file_id", F.col("seq").alias("src"), F.lead("seq").over(order).alias("dst"), F.lit("CFG").alias("kind")).where("dst is not null")


_CONTROL = ["if_statement", "for_statement", "while_statement", "try_statement", "ExceptHandler", "Match", "match_case"]


def branch_edges(nodes: DataFrame) -> DataFrame:
    """``CFG_BRANCH`` edges from control statements to the statements and clauses directly within."""
    control = nodes.where(F.col("kind").isin(*_CONTROL)).select("file_id", F.col("seq").alias("src"))
    inner = nodes.where(F.col("role").isin("statement", "declaration") | F.col("kind").isin("ExceptHandler", "match_case"))
    inner = inner.select("file_id", F.col("parent").alias("src"), F.col("seq").alias("dst"))
    return inner.join(control, ["file_id", "src"]).select("file_id", "src", "dst", F.lit("CFG_BRANCH").alias("kind"))


def call_edges(resolved: DataFrame) -> DataFrame:
    """``CFG_IP_CALL`` edges from resolved calls to their symbols and ``CFG_IP_RET`` edges back (G7); ends are ``file:node``."""
    end = lambda file, seq: F.concat_ws(":", F.col(file).cast("string"), F.col(seq).cast("string"))
    met = resolved.where("target_seq is not null").select(end("file_id", "seq").alias("call"), end("target_file", "target_seq").alias("symbol"))
    there = met.select(F.col("call").alias("src"), F.col("symbol").alias("dst"), F.lit("CFG_IP_CALL").alias("kind"))
    return there.unionByName(met.select(F.col("symbol").alias("src"), F.col("call").alias("dst"), F.lit("CFG_IP_RET").alias("kind")))


def tagged(symbols: DataFrame, lang: str = "python") -> DataFrame:
    """``symbols`` with ``kind`` ``source`` or ``sink`` where the name is one (G8); a sink wins."""
    of = lambda role: F.col("name").isin(*TAINT_NAMES[role][lang])
    return symbols.withColumn("kind", F.when(of("sink"), "sink").when(of("source"), "source").otherwise(F.col("kind")))


def tagged_calls(nodes: DataFrame, lang: str = "python") -> DataFrame:
    """``(file_id, seq, name, start_line, role)``: calls that enter, act or make harmless, by the table of names."""
    calls = nodes.where("role = 'call' and name is not null")
    role = F.coalesce(*[F.when(F.col("name").isin(*TAINT_NAMES[r][lang]), r) for r in ("sink", "source", "sanitizer")])
    return calls.select("file_id", "seq", "name", "start_line", role.alias("role")).where("role is not null")


def symbols(nodes: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "function_definition", "function").otherwise("type")
    return nodes.where("role = 'declaration'").select("file_id", "seq", "name", kind.alias("kind"), "start_line")


def resolved_calls(nodes: DataFrame, last_name: bool = False) -> DataFrame:
    """Calls with the declaration of their name: of the own file, else the smallest (file, node) of all.

    ``last_name``: a dotted call counts by its last name, as a method of whatever it is called on.
    """
    declared = symbols(nodes)
    called = F.substring_index("name", ".", -1) if last_name else F.col("name")
    calls = nodes.where("role = 'call' and name is not null").select("file_id", "seq", "name", "start_line", called.alias("called"))
    own = declared.groupBy("file_id", F.col("name").alias("called")).agg(F.min("seq").alias("own"))
    anywhere = declared.groupBy(F.col("name").alias("called")).agg(F.min(F.struct("file_id", "seq")).alias("any"))
    found = calls.join(own, ["file_id", "called"], "left").join(anywhere, "called", "left")
    target = F.when(F.col("own").isNotNull(), F.col("file_id")).otherwise(F.col("any.file_id"))
    return found.select("file_id", "seq", "name", "start_line", target.alias("target_file"), F.coalesce("own", "any.seq").alias("target_seq"))


def def_use_edges(nodes: DataFrame) -> DataFrame:
    """``DDG`` edges from the last definition of a name to each use of it, in preorder of the file."""
    names = nodes.where("kind = 'identifier' and role in ('store', 'load')")
    before = Window.partitionBy("file_id", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role") == "store", F.col("seq")), ignorenulls=True).over(before)
    return names.withColumn("src", last).where("role = 'load' and src is not null").select("file_id", "src", F.col("seq").alias("dst"), "name", F.lit("DDG").alias("kind"))


def value_flow(nodes: DataFrame) -> DataFrame:
    """``DDG`` edges of a file (G9): definition to use, call on the right of an assignment to what it defines (``rhs_call``),
    and definition to the call that it is an argument of (``arg``), with the name that flows."""
    uses = def_use_edges(nodes).withColumn("via", F.lit("use"))
    calls = nodes.where("role = 'call'")
    stored = nodes.where("role = 'store' and name is not null").select("file_id", F.col("parent").alias("around"), F.col("seq").alias("dst"), "name")
    assigned = nodes.where("kind = 'assignment'").select("file_id", F.col("seq").alias("around"))
    made = calls.select("file_id", F.col("parent").alias("around"), F.col("seq").alias("src"))
    edge = lambda rows, via: rows.select("file_id", "src", "dst", "name", F.lit("DDG").alias("kind"), F.lit(via).alias("via"))
    rhs = edge(assigned.join(stored, ["file_id", "around"]).join(made, ["file_id", "around"]), "rhs_call")
    inside = nodes.select("file_id", F.col("seq").alias("dst"), F.col("parent").alias("around"))
    argument = uses.join(inside, ["file_id", "dst"]).join(calls.select("file_id", F.col("seq").alias("around")), ["file_id", "around"])
    argument = edge(argument.select("file_id", "src", F.col("around").alias("dst"), "name"), "arg")
    return uses.unionByName(rhs).unionByName(argument)


def value_edges(nodes: DataFrame) -> DataFrame:
    """``(src, dst, kind)`` along which values go: definition to use, use to the nearest call or assignment around it, call
    to the one around it, assignment to the names it stores. Ends are ``file:node``."""
    at = lambda c: F.concat_ws(":", F.col("file_id").cast("string"), F.col(c).cast("string"))
    edges = def_use_edges(nodes).select(at("src").alias("src"), at("dst").alias("dst"), "kind")
    # The parser tells the nearest call or assignment around each node.
    kinds = nodes.select("file_id", F.col("seq").alias("around"), F.col("kind").alias("outer_kind")).where("outer_kind in ('call', 'assignment')")
    nearest = nodes.where("role in ('load', 'call', 'store') and around is not null").select("file_id", "seq", "role", "around").join(kinds, ["file_id", "around"])
    into = nearest.where("role <> 'store'").select(at("seq").alias("src"), at("around").alias("dst"), F.lit("VALUE").alias("kind"))
    out = nearest.where("role = 'store' and outer_kind = 'assignment'").select(at("around").alias("src"), at("seq").alias("dst"), F.lit("VALUE").alias("kind"))
    return edges.unionByName(into).unionByName(out)


def named_calls(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``(node)``: calls of the given names, dotted names whole, undotted ones as the last part too."""
    last = F.substring_index("name", ".", -1)
    found = nodes.where("role = 'call' and name is not null").where(F.col("name").isin(*names) | last.isin(*[n for n in names if "." not in n]))
    return found.select(F.concat_ws(":", F.col("file_id").cast("string"), F.col("seq").cast("string")).alias("node"))


def taint(nodes: DataFrame, sources: list[str], sinks: list[str], sanitizers: list[str] = [], max_steps: int = 64) -> DataFrame:
    """``(source, sink, depth)``: sink calls that a source call's value reaches, not through a sanitizer."""
    from sparkloom.operators.traverse import reached_targets

    barred = named_calls(nodes, sanitizers) if sanitizers else None
    found = reached_targets(value_edges(nodes), named_calls(nodes, sources), named_calls(nodes, sinks), max_steps, blocked=barred)
    return found.where("depth > 0").select(F.col("start").alias("source"), F.col("target").alias("sink"), "depth")


def taint_paths(nodes: DataFrame, sources: list[str], sinks: list[str], sanitizers: list[str] = [], max_steps: int = 64) -> DataFrame:
    """``(source, sink, depth, path)``: one shortest path of nodes from each source to each sink of ``taint``."""
    from sparkloom.operators.traverse import Graph, paths, reach

    barred = named_calls(nodes, sanitizers) if sanitizers else None
    found = reach(Graph(value_edges(nodes)), named_calls(nodes, sources), max_steps, blocked=barred)
    met = found.where("depth > 0").join(named_calls(nodes, sinks), "node", "left_semi").select("origin", "node", "depth")
    return met.join(paths(found, met), ["origin", "node"]).select(F.col("origin").alias("source"), F.col("node").alias("sink"), "depth", "path")
