"""Overrides by declaration, siblings, affected tests, and import rules of project files."""

from pyspark.sql import functions as F

from strataloom.build import build
from strataloom.graph import Graph
from strataloom.operators import impact, resolve
from strataloom.sources import manifests
from strataloom.sources.repo import skipped, walk


def test_the_first_declared_parent_counts(spark):
    names = "id string, name string, file string, kind string, seq long, enclosing string, is_override boolean"
    symbols = spark.createDataFrame([("A", "A", "a.py", "class", 1, None, False), ("A.m", "m", "a.py", "method", 2, "A", False), ("Z", "Z", "z.py", "class", 3, None, False), ("Z.m", "m", "z.py", "method", 4, "Z", False), ("C", "C", "c.py", "class", 5, None, False), ("C.m", "m", "c.py", "method", 6, "C", True)], names)
    pending = spark.createDataFrame([("c.py", "C", "Z", 1), ("c.py", "C", "A", 2)], "file string, name string, base string, place long")
    edges = resolve.extends(pending, symbols).where("kind = 'EXTENDS'")
    over, missing = resolve.overrides(symbols, resolve.contains(symbols), edges)
    assert [tuple(r) for r in over.collect()] == [("C.m", "Z.m")] and missing.count() == 0


def test_a_self_override_is_skipped(spark):
    symbols = spark.createDataFrame([("C", "C", "class", 1, False), ("C.m", "m", "method", 2, True)], "id string, name string, kind string, seq long, is_override boolean")
    one = spark.createDataFrame([("C", "C.m")], "src string, dst string")
    over, missing = resolve.overrides(symbols, one, spark.createDataFrame([("C", "C")], "src string, dst string"))
    assert over.count() == 0 and missing.count() == 0


def graph(spark):
    symbols = [
        ("K", "Cart", "src/cart.py", "class", 1, 9), ("t", "total", "src/cart.py", "method", 2, 3), ("s", "send", "src/cart.py", "method", 4, 5), ("h", "http", "src/net.py", "function", 1, 2),
        ("d", "deep", "src/deep.py", "function", 1, 2), ("e", "deeper", "src/deeper.py", "function", 1, 2), ("x", "test_x", "tests/test_x.py", "function", 1, 2), ("y", "test_y", "tests/test_y.py", "function", 1, 2),
        ("j", "Maker", "m/src/main/java/org/p/Maker.java", "class", 1, 2), ("q", "lonely", "src/q9.py", "function", 1, 2),
    ]
    edges = [("CONTAINS", "K", "t", -1), ("CONTAINS", "K", "s", -1), ("CALLS", "s", "h", 5), ("CALLS", "t", "d", 3), ("CALLS", "d", "e", 1), ("TESTED_BY", "e", "x", -1), ("IMPORTS", "tests/test_i.py", "src/cart.py", 1)]
    files = [(p, "python") for p in ("src/cart.py", "src/net.py", "src/deep.py", "src/deeper.py", "tests/test_x.py", "tests/test_y.py", "tests/test_i.py", "tests/test_cart_more.py", "m/src/test/java/org/p/OtherTest.java", "m/src/test/java/org/z/FarTest.java", "m/src/main/java/org/p/Maker.java", "src/q9.py")]
    return Graph.from_rows(spark, symbols, edges, files)


def names(spark, *seeds):
    return spark.createDataFrame([(x,) for x in seeds], "seed string")


def test_siblings(spark):
    got = [tuple(r) for r in impact.siblings(graph(spark), names(spark, "total")).collect()]
    assert sorted(got) == [("total", "src/deep.py", 2, "callee"), ("total", "src/net.py", 2, "callee")]
    files = spark.createDataFrame([("total", "src/deep.py", 1, "callee")], "seed string, path string, depth int, reason string")
    assert {(r.path, r.depth) for r in impact.with_siblings(graph(spark), files, names(spark, "total")).collect()} == {("src/deep.py", 1), ("src/net.py", 2)}


def test_affected_tests_by_each_signal(spark):
    g = graph(spark)
    commits = spark.createDataFrame([(f"c{i}", i, "m", False, x) for i in range(2) for x in ("src/net.py", "tests/test_y.py")] + [("c9", 9, "m", False, x) for x in ("src/net.py", "tests/test_x.py")], "sha string, n long, subject string, is_merge boolean, path string").withColumn("ts", F.timestamp_seconds("n"))
    texts = spark.createDataFrame([("tests/test_y.py", "call lonely()"), ("tests/test_x.py", "total lonely_one"), ("src/q9.py", "lonely")], "path string, text string")
    got = {(r.seed, r.path): r.reason for r in impact.affected_tests(g, names(spark, "total", "http", "Maker", "lonely", "test_x"), 3, commits, texts).collect()}
    assert got == {
        ("total", "tests/test_x.py"): "edge", ("total", "tests/test_i.py"): "convention", ("total", "tests/test_cart_more.py"): "convention", ("http", "tests/test_y.py"): "convention",
        ("Maker", "m/src/test/java/org/p/OtherTest.java"): "convention", ("lonely", "tests/test_y.py"): "convention", ("test_x", "tests/test_x.py"): "edge",
    }
    assert {r.path for r in impact.affected_tests(g, names(spark, "total"), 1).collect()} == {"tests/test_i.py", "tests/test_cart_more.py"}
    assert impact.affected_tests(g, names(spark), 3).count() == 0


def test_affected_tests_hold_no_pairs_of_seeds_and_symbols(spark, monkeypatch):
    n, sizes, plain = 30, [], impact.written

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(impact, "written", counted)
    ids = [("hub", "hub", "h.py")] + [(f"{x}{i}", f"{x}{i}", f"{x}.py") for x in "ab" for i in range(n)] + [("t", "t", "tests/test_it.py")]
    calls = [(f"a{i}", "hub") for i in range(n)] + [("hub", f"b{i}") for i in range(n)]
    g = Graph.from_rows(spark, [(*x, "function", 1, 2) for x in ids], [("CALLS", a, b, 1) for a, b in calls] + [("TESTED_BY", f"b{i}", "t", 1) for i in range(n)])
    got = {(r.seed, r.path) for r in impact.affected_tests(g, names(spark, *(f"a{i}" for i in range(n))), 2).where("reason = 'edge'").collect()}
    assert got == {(f"a{i}", "tests/test_it.py") for i in range(n)}
    assert max(sizes) <= 2 * n + 1
    assert impact.affected_tests(g, names(spark, "a1"), 1).count() == 0


FILES = {
    "svc/go.mod": "module example.org/svc\n", "svc/util/a.go": "package util\nfunc Help() {\n}\n", "svc/util/a_test.go": "package util\n", "other/util/a.go": "package util\n",
    "svc/main.go": 'package main\nimport "example.org/svc/util"\nfunc main() {\n  Help()\n}\n',
    "composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/", "App\\\\Deep\\\\": ["lib/deep/"]}}}', "src/Model/User.php": "<?php\nclass User {\n}\n", "lib/deep/Thing.php": "<?php\nclass Thing {\n}\n",
    "src/Run.php": "<?php\nuse App\\Model\\User;\nuse App\\Deep\\Thing;\nclass Run {\n}\n",
    "web/tsconfig.json": '{ // alias\n "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["app/*"], "@one": ["app/one.ts"],}}}', "web/app/one.ts": "export function one() {\n}\n", "web/app/two.ts": "export function two() {\n}\n",
    "web/main.ts": "import { two } from '@app/two';\nimport { one } from '@one';\nimport { pick } from '@org/tools/pick';\nimport x from 'react';\n",
    "tools/package.json": '{"name": "@org/tools"}', "tools/pick.ts": "export function pick() {\n}\n",
    "gem/lib/deep/part.rb": "class Part\nend\n", "bin/run.rb": "require 'deep/part'\n",
}


def test_imports_by_project_files(spark):
    every = spark.createDataFrame([(k, v) for k, v in FILES.items()], "path string, text string")
    lang = {"go": "go", "php": "php", "ts": "typescript", "rb": "ruby"}
    files = spark.createDataFrame([(k, lang[k.rpartition(".")[2]], v) for k, v in FILES.items() if k.rpartition(".")[2] in lang], "path string, lang string, text string")
    g = build(files, every)
    assert {(r.src, r.dst) for r in g.kind("IMPORTS").collect()} == {
        ("svc/main.go", "svc/util/a.go"), ("src/Run.php", "src/Model/User.php"), ("src/Run.php", "lib/deep/Thing.php"), ("web/main.ts", "web/app/two.ts"), ("web/main.ts", "web/app/one.ts"),
        ("web/main.ts", "tools/pick.ts"), ("bin/run.rb", "gem/lib/deep/part.rb"),
    }
    assert {(r.src, r.dst) for r in build(files).kind("IMPORTS").collect()} == {("bin/run.rb", "gem/lib/deep/part.rb")}


def test_scopes_of_projects(spark):
    texts = spark.createDataFrame([("a/package.json", '{"name": "a", "dependencies": {"b": "1"}}'), ("b/package.json", '{"name": "b"}'), ("c/Cargo.toml", '[package]\nname = "c"\n')], "path string, text string")
    scopes, deps = manifests.scopes(texts, spark.createDataFrame([("a/x.ts",), ("b/y.ts",), ("c/z.rs",), ("d.py",)], "path string"))
    assert {tuple(r) for r in scopes.collect()} == {("a/x.ts", "a"), ("b/y.ts", "b"), ("c/z.rs", "c")} and {tuple(r) for r in deps.collect()} == {("a", "b")}


def test_a_walk_survives_other_bytes_and_reads_exclusions(spark, tmp_path):
    for path, content in {"ok.py": b"x = 1\n", "latin.py": b"# caf\xe9\ndef f():\n    pass\n", "gone.py": b"y = 1\n", "id_rsa": b"k", "node_modules/m.js": b"function no() {}", "e/empty.py": b"", ".git/info/exclude": b"gone.py\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    got = {r.path: r.text for r in walk(spark, str(tmp_path)).collect()}
    assert got == {"ok.py": "x = 1\n", "latin.py": "# caf\ufffd\ndef f():\n    pass\n", "e/empty.py": ""}
    assert [tuple(r) for r in skipped(spark, str(tmp_path)).collect()] == [("id_rsa", "secret")]
    assert build(walk(spark, str(tmp_path))).internal().where("name = 'f'").count() == 1
