"""Text relations, extraction, the whole build, the store, and streams."""

import pytest
from pyspark.sql import functions as F

from strataloom.build import build
from strataloom.errors import IndexNotReady, StaleIndex
from strataloom.operators import hubs, importers, liveness, onehop
from strataloom.sources import text
from strataloom.sources.repo import extract, walk
from strataloom.sources.store import Store
from strataloom.streaming import debounce


def texts(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_diff_paths(spark):
    diff = "--- a/x.py\t2024\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n--- /dev/null\n+++ b/new.py\n--- a/gone.py\n+++ /dev/null\n"
    rows = text.diff_paths(spark.createDataFrame([("k", diff)], "key string, diff string")).orderBy("place").collect()
    assert [r.path for r in rows] == ["x.py", "new.py", "gone.py"]


def test_routes(spark):
    rows = [
        ("r.go", 'r.GET("/a", h.List)\nr.POST("/b", Create)\n'), ("urls.py", 'path("x/", views.show),\n'), ("config/routes.rb", '  get "/u" => "users#index"\n'),
        ("m.rs", '.route("/c", get(handler))\n'), ("c.ts", "@Controller('/cats')\nclass C {\n  @Get('/all')\n  async findAll(x) {\n"),
    ]
    got = {(r.method, r.route, r.handler) for r in text.routes(texts(spark, rows)).collect()}
    assert got == {("GET", "/a", "List"), ("POST", "/b", "Create"), ("ANY", "x/", "show"), ("GET", "/u", "index"), ("GET", "/c", "handler"), ("GET", "/cats/all", "findAll")}
    assert text.routes(texts(spark, rows), "show").count() == 1


def test_config_mentions_and_manifests(spark):
    rows = [("config/a.yaml", "x: handler\ny: handlers\n"), (".github/b.yml", "handler"), ("src/a.py", "handler")]
    assert [(r.path, r.line_no) for r in text.config_mentions(texts(spark, rows), "handler").collect()] == [("config/a.yaml", 1)]
    deps = text.manifest_deps(texts(spark, [("package.json", '{ // c\n "dependencies": {"a": "1", "b": "http://x",} }'), ("Cargo.toml", '[package]\nname = "q"\n[dependencies]\nserde = "1"\ntokio = { version = "1" }\n[dev-dependencies]\nz = "1"\n'), ("A.csproj", '<ProjectReference Include="..\\B\\B.csproj" />')]))
    assert {(r.path, r.dep) for r in deps.collect()} == {("package.json", "a"), ("package.json", "b"), ("Cargo.toml", "serde"), ("Cargo.toml", "tokio"), ("A.csproj", "B")}


def test_entry_facts(spark):
    rows = [("urls.py", "path('x/', views.show)"), ("pyproject.toml", '[project.scripts]\nrun = "pkg.cli:start"\n[tool]\nx = "a:b"\n'), ("pkg/__init__.py", "__all__ = ['A',\n  'B']\n"), ("ffi/Cargo.toml", '[lib]\ncrate-type = ["rlib", "cdylib"]\n'), ("lib/Cargo.toml", "[lib]\n")]
    got = {k: sorted(tuple(r) for r in v.collect()) for k, v in text.entry_facts(texts(spark, rows)).items()}
    assert got == {"handlers": [("show",)], "scripts": [("start",)], "exported": [("pkg/__init__.py", "A"), ("pkg/__init__.py", "B")], "c_libraries": [("ffi",)]}


def test_git_log(spark):
    log = "commit aaaaaaa1 1700000000 bbbbbbb1\tfix: crash\n\nsrc/a.py\nsrc/b.py\ncommit bbbbbbb2 1700000100 ccccccc1 ddddddd1\tmerge\n\nsrc/a.py\n"
    rows = text.git_log(spark.createDataFrame([("r", log)], "key string, log string")).orderBy("ts", "path").collect()
    assert [(r.sha, r.subject, r.is_merge, r.path) for r in rows] == [("aaaaaaa1", "fix: crash", False, "src/a.py"), ("aaaaaaa1", "fix: crash", False, "src/b.py"), ("bbbbbbb2", "merge", True, "src/a.py")]


TREE = {
    "pkg/__init__.py": "",
    "pkg/base.py": "class Base:\n    def run(self):\n        return helper()\n\ndef helper() -> int:\n    return 1\n",
    "pkg/child.py": "from .base import Base, helper as h\n\nclass Child(Base):\n    @override\n    def run(self, x: int = 2):\n        return h()\n\ndef unused():\n    pass\n",
    "tests/test_child.py": "from pkg.child import Child\n\ndef test_run():\n    Child()\n    helper()\n",
    "bad.py": "def broken(:\n",
    "web/a.ts": "import { b as c } from './b';\nexport class A extends B {\n  go(x: number) {\n    c(x);\n  }\n}\n",
    "web/b.ts": "export interface B {\n}\nexport function b(x) {\n  return x;\n}\n",
    "web/index.ts": "export * from './b';\n",
    "node_modules/x.js": "function no() {}\n",
    ".env": "SECRET=1",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for path, content in TREE.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(content)
    return str(top)


@pytest.fixture(scope="module")
def built(spark, tree):
    return build(walk(spark, tree))


def test_walk_skips(spark, tree):
    assert {r.path for r in walk(spark, tree).collect()} == {x for x in TREE if not x.startswith(("node_modules", ".env"))}


def test_extraction(spark, tree):
    rows = extract(walk(spark, tree)).collect()
    assert {r.path for r in rows if r.row == "file" and not r.ok} == {"bad.py"}
    run = next(r for r in rows if r.row == "symbol" and r.name == "run" and r.path == "pkg/child.py")
    assert (run.kind, run.arity, run.enclosing, run.is_override, run.params[1].default_value) == ("method", 2, "Child", True, "2")
    go = next(r for r in rows if r.row == "symbol" and r.name == "go")
    assert (go.kind, go.enclosing) == ("method", "A")


def test_build_edges(spark, built):
    names = {r.id: r.name for r in built.symbols.collect()}
    edges = {(r.kind, names.get(r.src, r.src), names.get(r.dst, r.dst)) for r in built.edges.collect()}
    for e in [
        ("CALLS", "run", "helper"), ("CALLS", "go", "b"), ("EXTENDS", "Child", "Base"), ("EXTENDS", "A", "B"), ("IMPLEMENTS", "A", "B"), ("OVERRIDES", "run", "run"), ("CONTAINS", "Child", "run"),
        ("IMPORTS", "pkg/child.py", "pkg/base.py"), ("IMPORTS", "web/a.ts", "web/b.ts"), ("IMPORTS", "web/index.ts", "web/b.ts"), ("IMPORTS_NAMED", "pkg/child.py", "Base"), ("TESTED_BY", "Child", "test_run"), ("CALLS_HEURISTIC", "test_run", "helper"),
    ]:
        assert e in edges, e
    for inner, outer in (("CALLS_HEURISTIC", "CALLS"), ("IMPLEMENTS", "EXTENDS")):
        assert built.subset_violations(inner, outer).count() == 0
    assert "unused" in [r.symbol for r in liveness.dead_code(built, "pkg").collect()] and "helper" not in [r.symbol for r in liveness.dead_code(built, "pkg").collect()]
    assert {r.caller for r in onehop.callers(built, "helper").collect()} >= {"run", "test_run"}
    assert "helper" in [r.name for r in hubs.top(built, 3).collect()]
    imports = built.kind("IMPORTS").select("src", "dst", "re_export")
    assert "web/index.ts" in {r.path for r in importers.importers(imports, "web/b.ts").collect()}


def test_store_generations_and_staleness(spark, built, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(IndexNotReady):
        store.load()
    hashes = walk(spark, tree).select("path", F.sha2("text", 256).alias("hash"))
    assert store.commit(built, hashes)["generation"] == 1
    assert store.load().edges.count() == built.edges.count()
    store.check_fresh(hashes)
    changed = hashes.withColumn("hash", F.when(F.col("path") == "pkg/base.py", "x").otherwise(F.col("hash")))
    with pytest.raises(StaleIndex) as e:
        store.check_fresh(changed)
    assert e.value.dirty == ["pkg/base.py"] and e.value.code == -32010
    store.check_fresh(changed, allow_stale=True)
    assert store.commit(built, hashes)["generation"] == 2
    assert [r.state for r in Store.catalog(spark, [store.folder, str(tmp_path / "none")]).collect()] == ["complete", "none"]


def test_edge_kinds_prune_directories(spark, built, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit(built)
    plan = store.load().kind("CALLS")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_debounce_sessions(spark):
    at = ["00:00.000", "00:00.400", "00:00.800", "00:05.000"]
    rows = spark.createDataFrame([(f"2024-01-01 00:{x}", ".git/HEAD") for x in at], "ts string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = debounce.sessions(debounce.watched(rows)).orderBy("fired_at").collect()
    assert [r.n for r in got] == [3, 1] and got[0].fired_at.microsecond == 300_000
    assert [r.dirty for r in debounce.sessions(rows, cap=2).orderBy("fired_at").collect()] == [True, False]


def test_rebuild_machine():
    assert debounce.rebuilds([100, 250, 1000], []) == [100, 1000]
    assert debounce.rebuilds([100], [(50, 3000)]) == [4100]


def test_sessions_on_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.createDataFrame([("2024-01-01 00:00:00.0", "r", ".git/index"), ("2024-01-01 00:00:00.3", "r", ".git/index"), ("2024-01-01 00:01:00.0", "r", ".git/index")], "ts string, repo string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(folder)
    stream = debounce.with_watermark(spark.readStream.schema(rows.schema).parquet(folder), "1 second")
    q = debounce.sessions(stream, keys=("repo",)).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.sql("select * from bursts").collect()] == [2]


def test_state_machine_on_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.createDataFrame([("2024-01-01 00:00:00.0", "r"), ("2024-01-01 00:00:00.3", "r"), ("2024-01-01 00:01:00.0", "r")], "ts string, repo string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(folder)
    stream = debounce.with_watermark(spark.readStream.schema(rows.schema).parquet(folder), "1 second")
    q = debounce.debounced_stream(stream).writeStream.format("memory").queryName("fires").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from fires order by fired_ms").collect()
    assert got[0].n == 2 and got[0].fired_ms % 1000 == 800
