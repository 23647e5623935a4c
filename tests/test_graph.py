import random
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.operators import frontend
from sparkloom.operators.textsearch import consecutive, last_before, resolved_names
from sparkloom.operators import traverse
from sparkloom.operators.traverse import Graph, expand, first_nodes, path_to, paths, reach, reached_targets
from sparkloom.plans import graph_plans

EDGES = "src string, dst string, kind string, depth int"


def edges(spark, pairs):
    return spark.createDataFrame([(*p, 7) if len(p) == 3 else (*p, "e", 7) for p in pairs], EDGES)


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def depths(found):
    return {(r.origin, r.node): r.depth for r in found.collect()}


def brute(pairs, start, steps, blocked=()):
    seen, layer = {start: 0}, [start]
    for step in range(1, steps + 1):
        layer = sorted({b for a, b, *_ in pairs if a in layer and a not in blocked and b not in seen})
        seen.update({n: step for n in layer})
    return seen


def test_reach_equals_brute_force(spark):
    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(60)]
    found = depths(reach(Graph(edges(spark, pairs)), nodes(spark, "n1", "n2", "n1"), 4))
    want = {(s, n): d for s in ("n1", "n2") for n, d in brute(pairs, s, 4).items()}
    assert found == want


def test_large_frontiers_and_heavy_starts_give_the_same(spark, monkeypatch):
    """Bucketed edges, with and without salted starts, instead of a broadcast frontier."""
    rnd = random.Random(6)
    pairs = [("n0" if rnd.random() < 0.4 else f"n{rnd.randrange(20)}", f"n{rnd.randrange(20)}") for _ in range(80)]
    pairs += pairs[:5]
    graph = lambda heavy: Graph(edges(spark, pairs), heavy)
    near = [sorted(map(tuple, f.collect())) for f in (reach(graph(99), nodes(spark, "n0", "n1"), 3), expand(graph(99), nodes(spark, "n0"), 2), reach(graph(99), nodes(spark, "n0"), 3, fan_out=2))]
    monkeypatch.setattr(traverse, "BROADCAST_CHARS", 0)
    for heavy in (99, 7):
        far = [sorted(map(tuple, f.collect())) for f in (reach(graph(heavy), nodes(spark, "n0", "n1"), 3), expand(graph(heavy), nodes(spark, "n0"), 2))]
        assert far == near[:2]
    assert sorted(map(tuple, reach(graph(99), nodes(spark, "n0"), 3, fan_out=2).collect())) == near[2]


def test_targets_from_either_side(spark):
    rnd = random.Random(9)
    pairs = [(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(50)]
    barred = ["n3", "n4", "n7"]
    few, many = ["n1", "n3"], [f"n{k}" for k in range(0, 25, 2)] + ["n3"]
    for starts, targets in ((few, many), (many, few)):
        got = {(r.start, r.target): r.depth for r in reached_targets(edges(spark, pairs), nodes(spark, *starts, None), nodes(spark, *targets), 4, blocked=nodes(spark, *barred)).collect()}
        assert got == {(s, t): d for s in starts for t, d in brute(pairs, s, 4, barred).items() if t in targets}


def test_paths_are_shortest(spark):
    rnd = random.Random(4)
    pairs = [(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(50)]
    found = reach(Graph(edges(spark, pairs)), nodes(spark, "n1", "n2"), 6)
    want = depths(found)
    got = {(r.origin, r.node): r.path for r in paths(found, found.select("origin", "node")).collect()}
    assert set(got) == set(want)
    for (origin, node), path in got.items():
        assert path[0] == origin and path[-1] == node and len(path) == want[origin, node] + 1 and all(p in pairs for p in zip(path, path[1:]))
    assert paths(found, nodes(spark).selectExpr("node as origin", "node")).count() == 0


def test_kinds_blocks_and_caps(spark):
    graph = Graph(edges(spark, [("a", "b", "x"), ("b", "c", "x"), ("a", "d", "y"), ("c", "e", "x"), ("a", "b", "x")]))
    assert depths(reach(graph, nodes(spark, "a"), 9, kinds=["x"])) == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "e"): 3}
    assert ("a", "c") not in depths(reach(graph, nodes(spark, "a"), 9, blocked=nodes(spark, "b")))
    assert set(depths(reach(graph, nodes(spark, "a"), 9, fan_out=1))) == {("a", "a"), ("a", "b"), ("a", "c"), ("a", "e")}
    assert max(depths(reach(graph, nodes(spark, "a"), 9, max_nodes=2)).values()) == 1
    assert [r.node for r in first_nodes(reach(graph, nodes(spark, "a"), 9), 3).collect()] == ["a", "b", "d"]


def test_path_and_expansion(spark):
    graph = Graph(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")]))
    found = reach(graph, nodes(spark, "a"), 5)
    assert path_to(found, "c") == ["a", "b", "c"] and path_to(found, "zz") == []
    met = [(r.level, r.src, r.dst) for r in expand(graph, nodes(spark, "a"), 2).collect()]
    assert sorted(met) == [(1, "a", "b"), (1, "a", "b"), (2, "b", "c")]
    back = reach(Graph.reversed(edges(spark, [("a", "b"), ("b", "c")])), nodes(spark, "c"), 5)
    assert depths(back) == {("c", "c"): 0, ("c", "b"): 1, ("c", "a"): 2}


def test_all_customers_equal_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    made = {
        "customer": ([(k, rnd.choice(["BUILDING", "MACHINERY"]), rnd.choice([9950.0, 12.5, -3.0])) for k in range(25)], "c_custkey int, c_mktsegment string, c_acctbal double"),
        "orders": ([(k, rnd.randrange(20)) for k in range(50)], "o_orderkey int, o_custkey int"),
        "lineitem": ([(rnd.randrange(50), rnd.randrange(9), rnd.randrange(8)) for _ in range(110)], "l_orderkey int, l_partkey int, l_suppkey int"),
        "supplier": ([(k, k % 5) for k in range(8)], "s_suppkey int, s_nationkey int"),
        "nation": ([(k, k % 3) for k in range(5)], "n_nationkey int, n_regionkey int"),
        "region": ([(k,) for k in range(3)], "r_regionkey int"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = {name: r for name, (r, _) in made.items()}
    links = [(f"C:{c}", f"O:{o}", "ORDERED") for o, c in rows["orders"]] + [(f"O:{o}", f"S:{s}", "SUPPLIED") for o, _, s in rows["lineitem"]] + [(f"O:{o}", f"P:{p}", "PART") for o, p, _ in rows["lineitem"]]
    links += [(f"S:{s}", f"N:{n}", "IN") for s, n in rows["supplier"]] + [(f"N:{n}", f"R:{r}", "IN") for n, r in rows["nation"]]
    customers, building = [f"C:{k}" for k, *_ in rows["customer"]], [f"C:{k}" for k, segment, _ in rows["customer"] if segment == "BUILDING"]
    barred = [f"S:{s}" for s, n in rows["supplier"] if n == 3]
    run = lambda query: sorted(map(tuple, query(spark, str(tmp_path)).collect()))

    def met(steps):
        nearest = {}
        for c in customers:
            for n, d in brute(links, c, steps).items():
                nearest[n] = min(d, nearest.get(n, d))
        return nearest

    assert run(graph_plans.g_slice_forward_all) == sorted(met(4).items())
    assert run(graph_plans.g_query_depth_all) == sorted(Counter(met(2).values()).items())
    assert run(graph_plans.g_reachability_len_all) == sorted((c, n, d) for c in customers for n, d in brute([x for x in links if x[2] != "PART"], c, 5).items() if n[0] == "R")
    assert run(graph_plans.g_taint_reach_all) == sorted((c, n) for c in customers for n in brute(links, c, 5, barred) if n[0] == "R")
    assert run(graph_plans.g_taint_reach) == sorted((c, n) for c in building for n in brute(links, c, 5, barred) if n[0] == "R")
    one = [(1, *x) for x in links if x[0] in customers]
    ends = {dst for _, _, dst, _ in one}
    assert run(graph_plans.g_callgraph_edges_all) == sorted(one + [(2, *x) for x in links if x[0] in ends])


def test_empty_graph_and_nulls(spark):
    graph = Graph(edges(spark, [(None, "b"), ("a", None)]))
    assert depths(reach(graph, nodes(spark, "a", None), 3)) == {("a", "a"): 0}


def test_windows_and_names(spark):
    rows = spark.createDataFrame([(1, 1, "d"), (1, 2, "u"), (1, 3, "d"), (1, 4, "u"), (2, 5, "u")], "g int, id int, t string")
    assert {(r.id, r.def_id) for r in last_before(rows, ["g"], ["id"], F.col("t") == "d", "id").where("t = 'u'").collect()} == {(2, 1), (4, 3), (5, None)}
    assert {(r.src, r.dst) for r in consecutive(rows, ["g"], ["id"], "id").collect()} == {(1, 2), (2, 3), (3, 4)}
    symbols = spark.createDataFrame([("f", 9), ("f", 3)], "name string, target int")
    uses = spark.createDataFrame([("f",), ("g",)], "name string")
    assert {(r.name, r.target) for r in resolved_names(uses, symbols, ["name"], "target", "target").collect()} == {("f", 3), ("g", None)}


SOURCE = b"""import os
def f(x):
    y = x + 1
    return g(y)
class A:
    def g(self):
        return f(2)
os.getcwd()
"""


def test_python_front_end(spark):
    parsed = spark.createDataFrame(
        [(1, "a.py", bytearray(SOURCE), 1), (2, "b.py", bytearray(b"def broken("), 1), (3, "c.py", None, 1), (4, "d.go", bytearray(b"x"), 1), (5, "e.py", bytearray(b"f(3)\ng()\n"), 1)],
        "file_id bigint, path string, source binary, parsed_at int",
    )
    found = frontend.python_nodes(parsed).cache()
    assert {r.file_id for r in found.select("file_id").distinct().collect()} == {1, 5}
    assert {(r.name, r.kind, r.start_line) for r in frontend.symbols(found).collect()} == {("f", "function", 2), ("A", "type", 5), ("g", "function", 6)}
    calls = {(r.file_id, r.name): (r.target_file, r.target_seq is not None) for r in frontend.resolved_calls(found).collect()}
    assert calls == {(1, "g"): (1, True), (1, "f"): (1, True), (1, "os.getcwd"): (None, False), (5, "f"): (1, True), (5, "g"): (1, True)}
    assert {r.name for r in frontend.def_use_edges(found).collect()} == {"y"}
    flow = frontend.flow_edges(found).where("file_id = 1").count()
    assert flow == 7  # eight statements in preorder
    tree = frontend.tree_edges(found).where("file_id = 1").count()
    assert tree == found.where("file_id = 1 and parent >= 0").count()


TAINTED = b"""a = input()
b = a + 1
c = escape(b)
eval(b)
eval(c)
d = wrap(
    other(a),
)
exec(d)
e = 2
eval(e)
"""


def test_taint(spark):
    nodes = frontend.python_nodes(spark.createDataFrame([(1, "a.py", bytearray(TAINTED), 1)], "file_id bigint, path string, source binary, parsed_at int")).cache()
    line = {f"1:{r.seq}": r.start_line for r in nodes.collect()}
    met = {line[r.sink] for r in frontend.taint(nodes, ["input"], ["eval", "exec"], ["escape"]).collect()}
    assert met == {4, 9}
    assert {line[r.sink] for r in frontend.taint(nodes, ["input"], ["eval", "exec"]).collect()} == {4, 5, 9}
    assert frontend.taint(nodes, ["nothing"], ["eval"]).count() == 0
    shown = {line[r.sink]: [line[n] for n in r.path] for r in frontend.taint_paths(nodes, ["input"], ["exec"]).collect()}
    assert list(shown) == [9] and shown[9][0] == 1 and shown[9][-1] == 9 and 7 in shown[9]


def test_starts_together_meet_each_node_once(spark):
    edges = spark.createDataFrame([("a", "c", "X"), ("b", "c", "X"), ("c", "d", "X"), ("b", "d", "X"), ("d", "a", "X")], "src string, dst string, kind string")
    starts = spark.createDataFrame([("a",), ("b",)], "node string")
    found = reach(Graph(edges), starts, 5, together=True).collect()
    assert sorted((r.origin, r.node, r.depth) for r in found) == [("*", "a", 0), ("*", "b", 0), ("*", "c", 1), ("*", "d", 1)]


def test_taint_over_many_assignments(spark, tmp_path):
    chain = "".join(f"    v{k + 1} = v{k}\n" for k in range(6))
    source = f"def f(p):\n    v0 = open(p)\n{chain}    return sorted(v6)\n"
    rows = spark.createDataFrame([(1, "a.py", "python", bytearray(source.encode()), 1)], "file_id bigint, path string, lang string, source binary, parsed_at int")
    rows.write.parquet(str(tmp_path / "parsed_files.parquet"))
    (found,) = graph_plans.g_python_taint(spark, str(tmp_path)).collect()
    assert found.depth > 12


FLOWING = b"""def get():
    return input()
class eval:
    pass
x = get()
y = x + 1
if y:
    run(x)
    for k in y:
        print(k)
else:
    os.system(y)
try:
    z.get()
except E:
    pass
"""


def test_branches_flows_and_roles(spark):
    nodes = frontend.nodes_of(spark.createDataFrame([("h", bytearray(FLOWING))], "file_id string, source binary")).cache()
    line = {r.seq: r.start_line for r in nodes.collect()}
    kind = {r.seq: r.kind for r in nodes.collect()}
    branches = {(line[r.src], line[r.dst], kind[r.dst]) for r in frontend.branch_edges(nodes).collect()}
    assert branches == {(7, 8, "expression_statement"), (7, 9, "for_statement"), (9, 10, "expression_statement"), (7, 12, "expression_statement"), (13, 14, "expression_statement"), (13, 15, "ExceptHandler"), (15, 16, "Pass")}
    flows = {(line[r.src], line[r.dst], r.name, r.via) for r in frontend.value_flow(nodes).collect()}
    assert {f for f in flows if f[3] == "rhs_call"} == {(5, 5, "x", "rhs_call")}
    assert {f for f in flows if f[3] == "arg"} == {(5, 8, "x", "arg"), (9, 10, "k", "arg"), (6, 12, "y", "arg")}
    assert {(r.name, r.role) for r in frontend.tagged_calls(nodes).collect()} == {("input", "source"), ("os.system", "sink")}
    assert {(r.name, r.kind) for r in frontend.tagged(frontend.symbols(nodes)).collect()} == {("get", "function"), ("eval", "sink")}
    whole = frontend.call_edges(frontend.resolved_calls(nodes)).collect()
    assert len(whole) == 2 and {r.kind for r in whole} == {"CFG_IP_CALL", "CFG_IP_RET"}
    assert len(frontend.call_edges(frontend.resolved_calls(nodes, last_name=True)).collect()) == 4  # z.get() too


def test_artifact_store(spark, tmp_path):
    from sparkloom.sources.artifact_store import ArtifactStore, file_outline, symbol_search

    def files(*rows):
        made = [(p, "python" if p.endswith("py") else "go", len(t), bytearray(t.encode()), t) for p, t in rows]
        return spark.createDataFrame(made, "path string, lang string, size bigint, source binary, blob_hash string")

    store = ArtifactStore(spark, str(tmp_path / "store"))
    one, two = "def load(x):\n    y = read(x)\n    return y\n", "def upload():\n    a.load(1)\n    load(2)\n"
    assert store.index_revision("r1", files(("a.py", one), ("b.py", one), ("c.go", "package c"), ("bad.py", "def ("))) == 2
    assert store.index_revision("r1", files(("a.py", one), ("b.py", one))) == 0
    assert store.index_revision("r2", files(("a.py", one), ("d.py", two))) == 1
    assert {(r.path, r.name) for r in store.at_rev("symbols", "r2").collect()} == {("a.py", "load"), ("d.py", "upload")}
    assert {r.path for r in store.at_rev("edges", "r1", ["DDG"]).collect()} == {"a.py", "b.py"}
    assert store.at_rev("edges", "r2", ["CFG_BRANCH"]).count() == 0
    assert sorted((r.n_symbols, r.n_calls) for r in store.counts().collect()) == [(1, 1), (1, 2)]
    symbols, calls = store.at_rev("symbols", "r2"), store.at_rev("calls", "r2")
    hits, sites = symbol_search(symbols, calls, "load")
    assert [(r.path, r.name) for r in hits.collect()] == [("a.py", "load")] and [(r.start_line, r.name) for r in sites.collect()] == [(2, "a.load"), (3, "load")]
    assert [r.name for r in symbol_search(symbols, calls, "LOAD")[0].collect()] == ["load", "upload"]
    assert symbol_search(symbols, calls, "load", "go")[0].count() == 0
    (row,) = file_outline(symbols, calls, limit=1).where("path = 'd.py'").collect()
    assert [s.name for s in row.symbols] == ["upload"] and [c.name for c in row.calls] == ["a.load"]


def test_running_values_by_ranges(spark):
    from sparkloom.operators.ranges import last_value_before, running_sum, sliding_count

    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "x", None]), k, rnd.randrange(40), rnd.choice(["d", "u", "u"])) for k in range(200)]
    frame = spark.createDataFrame(rows, "g string, id int, t int, kind string")
    at, order = F.floor(F.col("t") / 7), [F.col("t"), F.col("id")]
    sums = {r.id: r.s for r in running_sum(frame, ["g"], at, order, "t", "s").collect()}
    falling = {r.id: r.s for r in running_sum(frame, ["g"], at, [F.col("t").desc(), F.col("id").desc()], "t", "s", newest_first=True).collect()}
    recent = {r.id: r.n for r in sliding_count(frame, ["g"], at, order, F.col("kind") == "d", 4, "n", block=9).collect()}
    lasts = {r.id: r.d for r in last_value_before(frame, ["g"], at, order, F.when(F.col("kind") == "d", F.col("id")), "d").collect()}
    for g, k, t, _ in rows:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        before = [r for r in mine if (r[2], r[1]) < (t, k)]
        assert sums[k] == t + sum(r[2] for r in before) and falling[k] == sum(r[2] for r in mine) - sum(r[2] for r in before)
        assert recent[k] == sum(r[3] == "d" for r in [*before, next(r for r in mine if r[1] == k)][-4:])
        assert lasts[k] == next((r[1] for r in reversed(before) if r[3] == "d"), None)
