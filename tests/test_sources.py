from pyspark.sql import functions as F

from sparkloom.operators.import_specs import import_specs, resolved_specs
from sparkloom.operators.imports import dependency_edges, directory_map, resolved_imports, signatures
from sparkloom.operators.traverse import Graph, reach
from sparkloom.sources import lint
from sparkloom.sources.blob_store import BlobStore
from sparkloom.sources.scan import scan_tree


def write(root, **files):
    for name, text in files.items():
        at = root / name.replace("__", "/").replace("_dot_", ".")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_scan_and_store(spark, tmp_path):
    tree = tmp_path / "tree"
    write(tree, a__x_dot_py="x = 1\n", a__y_dot_go="package y\n", b__copy_dot_py="x = 1\n", b__note_dot_md="no", node_modules__z_dot_js="no", a__large_dot_py="#" * 300)
    files = scan_tree(spark, str(tree), max_bytes=200)
    assert {(r.path, r.lang, r.size) for r in files.collect()} == {("a/x.py", "python", 6), ("a/y.go", "go", 10), ("b/copy.py", "python", 6)}
    assert [r.path for r in scan_tree(spark, str(tree), ["go"]).collect()] == ["a/y.go"]
    store = BlobStore(spark, str(tmp_path / "store"))
    assert store.stats() == {"blobs": 0, "versions": 0}
    store.add_revision("r1", files)
    store.add_revision("r1", files)
    store.add_revision("r2", files.where("path = 'a/x.py'"))
    assert store.stats() == {"blobs": 2, "versions": 4}
    assert {(r.path, bytes(r.source)) for r in store.at("r1").collect()} == {("a/x.py", b"x = 1\n"), ("b/copy.py", b"x = 1\n"), ("a/y.go", b"package y\n")}


RUFF = '[{"filename": "/r/a.py", "message": "m", "code": "E501", "location": {"row": 3, "column": 1}}, {"filename": "/other/b.py", "message": "n", "code": "W1", "location": {"row": 1, "column": 1}}]'
OUTPUTS = [
    ("ruff", RUFF), ("ruff", '{"filename": "b.py", "message": "i", "code": "I001", "location": {"row": 1, "column": 1}}\n{"filename": "c.py", "message": "u", "code": "UP006", "location": {"row": 2, "column": 1}}'), ("ruff", "not json"), ("ruff", None),
    ("biome", '{"diagnostics": [{"severity": "error", "category": "lint/x", "message": "b", "location": {"path": "a.ts", "line": 0}}, {"severity": "warning", "category": "w", "message": "w", "location": {"path": "a.ts", "line": 4}}]}'),
    ("go_vet", "# pkg\n./a.go:12:3: Printf format %d has arg of wrong type\nb.go:4: unused result\n"), ("pmd", '{"files": [{"filename": "/r/A.java", "violations": [{"beginline": 5, "description": "d", "rule": "R", "priority": 3}]}]}'), ("unknown", "x"),
]


def test_lint_findings(spark):
    found = lint.all_findings(spark.createDataFrame(OUTPUTS, "tool string, output string"), "/r").cache()
    got = {(r.tool, r.file, r.line, r.severity, r.code) for r in found.collect()}
    assert got == {
        ("ruff", "a.py", 3, "error", "E501"), ("ruff", "b.py", 1, "warning", "I001"), ("ruff", "c.py", 2, "info", "UP006"), ("biome", "a.ts", 1, "error", "lint/x"),
        ("go_vet", "a.go", 12, "error", "printf"), ("go_vet", "b.go", 4, "error", "unused"), ("pmd", "A.java", 5, "warning", "R"),
    }
    risk = lint.as_risks(found.where("tool = 'pmd'")).first()
    assert (risk.description, risk.line_number.start, risk.confidence) == ("[R] d", 5, 0.8)


def test_imports_and_dependencies(spark):
    made = [
        (1, "r/a/m.py", "import b.c\nimport os\nfrom n import x"), (2, "r/b/c.py", "import z"), (3, "r/a/n.py", ""), (4, "r/w/p.ts", 'import { q } from "../w/q";'), (5, "r/w/q.tsx", "export function q() {}"),
        (6, "r/J.java", "import org.x.K;"), (7, "r/src/org/x/K.java", "public class K {}"), (8, "r/g.rb", 'require_relative "./h"'), (9, "r/h.rb", "def h\nend"), (10, "s/b/c.py", ""),
    ]
    texts = spark.createDataFrame(made, "file_id bigint, path string, text string")
    files = texts.select("file_id", "path", F.substring_index("path", "/", 1).alias("repo_name"))
    resolved = resolved_imports(texts, files).cache()
    assert {(r.file_id, r.module): r.target_id for r in resolved.collect()} == {(1, "b.c"): 2, (1, "os"): -1, (1, "n"): 3, (2, "z"): -1, (4, "../w/q"): 5, (6, "org.x.K"): 7, (8, "./h"): 9}
    start = spark.createDataFrame([("1",)], "node string")
    assert {r.node for r in reach(Graph(dependency_edges(resolved)), start, 5).collect()} == {"1", "2", "3"}
    assert {(r.name, r.signature) for r in signatures(texts).collect()} == {("q", "export function q() {}"), ("K", "public class K {}"), ("h", "def h")}
    assert {(r.directory, r.n_files) for r in directory_map(files).where("repo_name = 's'").collect()} == {("s", 1), ("s/b", 1)}


def test_imports_of_whole_texts(spark):
    made = [
        (1, "r/a/b/m.py", '"""\nimport no\n"""\nimport os, c.d as e\nfrom . import s\nfrom ..x import (\n  y,  # z\n  t)\nfrom p import q'), (2, "r/a/b/s.py", ""), (3, "r/a/x.py", ""), (4, "r/p/q.py", ""), (5, "r/c/d/__init__.py", ""),
        (6, "r/old.py", "print 1\nimport { v } from './v'\nimport c.d, os; from .p import q, \\\n  w\n"), (7, "r/p/w/__init__.py", ""),
        (8, "r/k/l/m/n/f.ts", 'import {\n  A,\n} from "../../../../g";\nexport * from "./h";\nconst z = require("u"), v = require("w");\nimport "./side";'), (9, "r/g.ts", ""), (10, "r/k/l/m/n/h/index.ts", ""),
        (11, "r/cmd/m.go", 'package m\n\nimport "fmt"\nimport (\n\t"os" // "no"\n\tx "github.com/o/r/pkg/x"\n\t_ `pkg/y`\n)\n\nvar s = "no"\n'), (12, "r/pkg/x/a.go", "package x"), (13, "r/pkg/x/b.go", "package x"), (14, "r/pkg/y/c.go", ""), (15, "s/pkg/y/c.go", ""), (16, "r/pkg/x/z/d.go", ""),
        (17, "r/J.java", "import org.x.*;\nimport static org.x.K.run;\nimport org.x.K;"), (18, "r/src/org/x/K.java", ""), (19, "r/src/org/x/L.java", ""), (20, "r/g.rb", 'require("./h")'), (21, "r/h.rb", None), (23, "r/js.go", "import { v } from './v'\nimport { w } from \"w\""), (22, "r/t.ts", 'import a from "../../g"'),
    ]
    texts = spark.createDataFrame(made, "file_id bigint, path string, text string")
    files = texts.select("file_id", "path", F.substring_index("path", "/", 1).alias("repo_name"))
    found = import_specs(texts).cache()
    got = {(r.file_id, r.line_no, r.module) for r in found.collect()}
    assert got == {
        (1, 4, "os"), (1, 4, "c.d"), (1, 5, "."), (1, 6, "..x"), (1, 9, "p"), (6, 3, "c.d"), (6, 3, "os"), (6, 3, ".p"), (8, 1, "../../../../g"), (8, 4, "./h"), (8, 5, "u"), (8, 5, "w"), (8, 6, "./side"),
        (11, 3, "fmt"), (11, 5, "os"), (11, 6, "github.com/o/r/pkg/x"), (11, 7, "pkg/y"), (17, 1, "org.x.*"), (17, 2, "org.x.K.run"), (17, 3, "org.x.K"), (20, 1, "./h"), (22, 1, "../../g"),
    }
    targets = {(r.file_id, r.module, r.name, r.target_id) for r in resolved_specs(found, files).collect()}
    assert {t for t in targets if t[3] >= 0} == {
        (1, "c.d", None, 5), (1, ".", "s", 2), (1, "..x", None, 3), (1, "p", "q", 4), (6, "c.d", None, 5), (6, ".p", "q", 4), (6, ".p", "w", 7), (8, "../../../../g", None, 9), (8, "./h", None, 10),
        (11, "github.com/o/r/pkg/x", None, 12), (11, "github.com/o/r/pkg/x", None, 13), (11, "pkg/y", None, 14), (17, "org.x.*", None, 18), (17, "org.x.*", None, 19), (17, "org.x.K.run", None, 18), (17, "org.x.K", None, 18), (20, "./h", None, 21),
    }
    assert {(f, m) for f, _, m in got} == {(f, m) for f, m, _, _ in targets}


def test_shared_folder(spark, tmp_path, monkeypatch):
    """Intermediates are deleted by release; off one machine a folder must be named."""
    import pytest

    from sparkloom.sources import shared

    kept = shared.written(spark.range(5), "x")
    name = shared.bucketed(spark.range(5), "y", ["id"], 2)
    assert kept.count() == 5 and spark.table(name).count() == 5
    folder = shared.shared_dir(spark).removeprefix("file://")
    import os

    assert os.path.isdir(folder)
    shared.release(spark)
    assert not os.path.exists(folder) and not spark.catalog.tableExists(name)

    class Elsewhere:
        master, getCheckpointDir = "spark://h:7077", staticmethod(lambda: None)

    class Session:
        sparkContext = Elsewhere

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session)


def test_scan_of_given_paths_and_texts(spark, tmp_path):
    from sparkloom.sources.scan import load_texts, read_texts

    tree = tmp_path / "tree"
    write(tree, a__x_dot_py="x = 1\n", a__y_dot_py="y\n", _dot_mypy_cache__z_dot_py="no", d_dot_diff="diff --git a b\n")
    wanted = spark.createDataFrame([("a/x.py",), (".mypy_cache/z.py",), ("gone.py",)], "path string")
    assert [r.path for r in scan_tree(spark, str(tree), paths=wanted).collect()] == ["a/x.py"]
    assert [r.text for r in load_texts(spark, str(tree / "d.diff")).collect()] == ["diff --git a b\n"]
    rows = spark.createDataFrame([("a", "1\n2\n3\n"), ("b", "1\n2"), ("c", ""), ("d", None)], "path string, text string")
    assert {r.path: (r.content, r.line_count) for r in read_texts(rows, 2).collect()} == {"a": ("1\n2\n\n... (truncated, 1 more lines)", 3), "b": ("1\n2", 2), "c": ("", 0)}
    assert {r.path: r.line_count for r in read_texts(rows).collect()} == {"a": 3, "b": 2, "c": 0}


def test_checkers_and_objects_in_output(spark):
    files = spark.createDataFrame([("a.py",), ("b.TSX",), ("c.rb",), ("d.java",)], "path string")
    assert {(r.path, r.checker) for r in lint.checkers_of(files).collect()} == {("a.py", "ruff"), ("b.TSX", "biome"), ("d.java", "pmd")}
    outputs = [
        ("ruff", '[{"filename": "a.py", "message": "m", "code": {"name": "W9"}, "location": {"row": 3, "column": 1}}]'),
        ("biome", '{"diagnostics": [{"severity": "error", "category": "c", "message": {"text": "said"}, "location": {"path": "a.ts", "line": 0}}]}'),
    ]
    found = lint.all_findings(spark.createDataFrame(outputs, "tool string, output string"), "/r").cache()
    assert {(r.file, r.code, r.severity, r.message) for r in found.collect()} == {("a.py", "W9", "warning", "m"), ("a.ts", "c", "error", "said")}
    assert [r.file for r in lint.requested(found, files).collect()] == ["a.py"]


def test_lookups(spark):
    from sparkloom.operators import store

    revisions = spark.createDataFrame([("r1", None, 1.0, "x"), ("r2", "r1", 2.0, "x"), ("r3", "r2", 3.0, "x"), ("q", None, 1.0, "y")], "rev string, base_rev string, created_at double, repo_name string")
    versions = spark.createDataFrame([("r1", 1, "h1"), ("r2", 1, "h2"), ("r2", 2, "h0")], "rev string, file_id bigint, hash string")
    files = spark.createDataFrame([(1, "x/Ab.py"), (2, "x/c.py")], "file_id bigint, path string")
    assert {(r.rev, r.used) for r in store.required_revs(revisions, revisions, versions).collect()} == {("r1", "r1"), ("r2", "r2"), ("r3", "r2"), ("q", None)}
    symbols = spark.createDataFrame([(1, 5, "g"), (1, 2, "f"), (9, 1, "z")], "file_id bigint, line_no int, name string")
    assert {(r.path, r.n_symbols, r.hash) for r in store.repo_map_files(versions.where("rev = 'r2'"), files, symbols).collect()} == {("x/Ab.py", 2, "h2"), ("x/c.py", 0, "h0")}
    assert [(r.path, r.name) for r in store.repo_map_symbols(symbols, files, 1).collect()] == [("x/Ab.py", "f")]
    assert {(r.path, r.hash) for r in store.greatest_content(versions, files).collect()} == {("x/Ab.py", "h2"), ("x/c.py", "h0")}
    assert [r.path for r in store.paths_containing(files, "aB").collect()] == ["x/Ab.py"]
    assert {(r.path, r.file_id) for r in store.file_ids(spark.createDataFrame([("x/c.py",), ("no",), (None,)], "path string"), files).collect()} == {("x/c.py", 2), ("no", None), (None, None)}
    assert {(r.rev, r.name) for r in store.symbol_locations(symbols, versions.where("rev = 'r1'"), files).collect()} == {("r1", "f"), ("r1", "g")}


def test_exports_of_modules():
    from sparkloom.operators.exports import exports_of

    names = lambda lang, text: {n for n, *_ in exports_of(lang, text)}
    assert names("python", "import os.path, re as r\nx, (y, *z) = 1, (2, 3)\ntry:\n    a = 1\nexcept E:\n    b = 2\ndef f():\n    inner = 1\nif x:\n    class C: pass\n__all__ = ['lazy']\n") == {"os", "r", "x", "y", "z", "a", "b", "f", "C", "__all__"}
    assert "lazy" in names("python", "__all__ = ['lazy']\ndef __getattr__(n): ...\n") and names("python", "def (") == set()
    assert set(exports_of("typescript", "export default function go() {}\nexport const a = 1;\nexport { b, c as d };\nexport { e as f } from './m';\nexport * from './n';\nexport * as q from './o';\nconst hidden = 1;\n")) == {
        ("default", None, None), ("a", None, None), ("b", None, None), ("d", None, None), ("f", "./m", "e"), ("*", "./n", "*"), ("q", None, None),
    }
    assert names("go", "package x\nfunc Open() {}\nfunc shut() {}\ntype T struct{}\n") == {"Open", "T"}
    assert names("java", "public final class A {\n  static class B {}\n}\n") == {"A", "B"} and names("ruby", "class A\n  def self.f\n  end\nend\n") == {"A", "f"}


def test_checked_imports(spark):
    from sparkloom.operators import exports

    made = [
        (1, "r/a.py", "from b import f, g\nfrom p import m, lost\n"), (2, "r/b.py", "def f(): pass\n"), (3, "r/p/__init__.py", ""), (4, "r/p/m.py", ""),
        (5, "r/w/i.ts", "import d, { x, y, z } from './m';"), (6, "r/w/m.ts", "export * from './n';\nexport { q as y } from './n';\nexport default 1;\n"), (7, "r/w/n.ts", "export const x = 1, q = 2;\nexport * from './m';\nexport const q = 3;\n"),
        (8, "r/J.java", "import org.K;\nimport org.L;\n"), (9, "r/src/org/K.java", "public class K {}"), (10, "r/src/org/L.java", "class Other {}"), (11, "r/g.rb", "require_relative 'big_thing'"), (12, "r/big_thing.rb", "class BigThing\nend"),
        (13, "r/m.go", 'package m\nimport "r/u"\n'), (14, "r/u/u.go", "package u\nfunc Open() {}\nfunc shut() {}\n"), (15, "r/u/v.go", "package u\ntype T int\n"),
    ]
    texts = spark.createDataFrame(made, "file_id bigint, path string, text string")
    files = texts.select("file_id", "path", F.substring_index("path", "/", 1).alias("repo_name"))
    specs = import_specs(texts).cache()
    resolved = resolved_specs(specs, files).cache()
    offered = exports.module_exports(texts, files).cache()
    got = {(r.file_id, r.name): (r.target_id, r.is_exported) for r in exports.checked_names(exports.name_rows(specs, resolved, texts, files), offered).collect()}
    assert got == {
        (1, "f"): (2, True), (1, "g"): (2, False), (1, "m"): (3, True), (1, "lost"): (3, False), (5, "default"): (6, True), (5, "x"): (6, True), (5, "y"): (6, True), (5, "z"): (6, False),
        (8, "K"): (9, True), (8, "L"): (10, False), (11, "BigThing"): (12, True),
    }
    assert [(r.file_id, r.n_names) for r in exports.go_exports(specs, resolved, offered).collect()] == [(13, 2)]
    assert exports.module_exports(texts.where("false"), files).count() == 0
