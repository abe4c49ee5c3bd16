"""Operators on small hand-made graphs, against what the shapes imply or a plain model."""

import itertools
import os
from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.errors import IndexNotReady, InvalidParams
from strataloom.functions import predicates as p
from strataloom.graph import Graph
from strataloom.operators import architecture, bridges, catalog, context, evaluate, history, hubs, impact, importers, liveness, onehop, resolve, search
from strataloom.plans import catalogue, projections


def graph(spark, calls, extra=(), kinds=None, files=None):
    """Functions by name in m.py, or in files[name]; edges are (caller, callee) or (kind, src, dst)."""
    names = sorted({x for e in calls for x in e} | {x for _, a, b in extra for x in (a, b)} | set(files or {}))
    symbols = [(n, n.split("@")[0], (files or {}).get(n, "m.py"), (kinds or {}).get(n, "function"), i + 1, i + 3) for i, n in enumerate(names)]
    edges = [("CALLS", a, b, i) for i, (a, b) in enumerate(calls)] + [(k, a, b, -1) for k, a, b in extra]
    return Graph.from_rows(spark, symbols, edges)


def test_hot_ranks_above_warm_and_cold_is_absent(spark):
    g = graph(spark, [("a", "hot"), ("b", "hot"), ("c", "hot"), ("a", "warm")], files={"cold": "m.py"})
    names = [r.name for r in hubs.top(g).collect()]
    assert names[0] == "hot" and names.index("hot") < names.index("warm") and "cold" not in names


def test_guessed_calls_take_degrees_off(spark):
    g = graph(spark, [("a", "x"), ("b", "x")], [("CALLS_HEURISTIC", "a", "x")])
    assert {r.name: r.in_degree for r in hubs.degrees(g).collect()}["x"] == 1
    assert {r.name: r.in_degree for r in hubs.degrees(g, "all").collect()}["x"] == 2
    with pytest.raises(InvalidParams):
        hubs.top(g, 0)


def test_rank_of_target(spark):
    g = graph(spark, [("a", "x"), ("b", "x"), ("c", "y")])
    assert hubs.rank_of(g, "x").first()["rank"] == 1 and hubs.rank_of(g, "nobody").count() == 0


def test_star_center_is_the_bridge(spark):
    g = graph(spark, [(f"leaf{i}", "bridge") for i in range(6)])
    rows = bridges.top(g).collect()
    # All 15 pairs of leaves pass the center; halved twice by the surface's formula.
    assert [r.name for r in rows] == ["bridge"] and rows[0].betweenness == pytest.approx(0.5)


def test_ring_is_capped_and_empty_graph_is_empty(spark):
    g = graph(spark, [(f"f{i:02}", f"f{(i + 1) % 15:02}") for i in range(15)])
    assert bridges.top(g, 3).count() == 3
    assert bridges.top(graph(spark, [], files={"x": "a.py"})).count() == 0


def brandes(nodes, adj):
    """Betweenness by counting shortest paths of each pair."""
    dist, paths = {}, {}
    for s in nodes:
        dist[s], paths[s], q = {s: 0}, {s: 1}, deque([s])
        while q:
            u = q.popleft()
            for v in adj[u]:
                if v not in dist[s]:
                    dist[s][v], paths[s][v] = dist[s][u] + 1, 0
                    q.append(v)
                if dist[s][v] == dist[s][u] + 1:
                    paths[s][v] += paths[s][u]
    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        for v in nodes:
            if v not in (s, t) and t in dist[s] and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                out[v] += paths[s][v] * paths[v][t] / paths[s][t]
    n = len(nodes)
    return {v: b / 2 / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, b in out.items()}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=20))
def test_betweenness_equals_path_counts(spark, pairs):
    g = graph(spark, [(f"n{a}", f"n{b}") for a, b in pairs])
    nodes = sorted({f"n{x}" for e in pairs for x in e})
    adj = {v: set() for v in nodes}
    for a, b in pairs:
        adj[f"n{a}"].add(f"n{b}")
        adj[f"n{b}"].add(f"n{a}")
    for shared in (10**6, 0):
        got = {r.name: r.betweenness for r in bridges.betweenness(g, most_shared=shared).collect()}
        assert got == pytest.approx(brandes(nodes, adj), abs=1e-8)


def test_sampled_betweenness_is_scaled(spark):
    g = graph(spark, [(f"leaf{i:02}", "hub") for i in range(20)])
    for shared in (10**6, 0):
        rows = {r.name: r.betweenness for r in bridges.betweenness(g, most_exact=10, sample=7, most_shared=shared).collect()}
        assert rows["hub"] > 0.3 and rows["leaf03"] == 0


def test_joined_betweenness_has_no_last_level(spark, monkeypatch):
    for bound in ("MOST_LEVELS", "FOLD_LEVELS"):
        monkeypatch.setattr(bridges, bound, 2, raising=False)
    g = graph(spark, [(f"n{i}", f"n{i + 1}") for i in range(7)])
    shared, joins = ({r.name: r.betweenness for r in bridges.betweenness(g, most_exact=1, sample=1, most_shared=m).collect()} for m in (10**6, 0))
    assert joins == pytest.approx(shared, abs=1e-8) and joins["n5"] > 0 and joins["n6"] > 0


def test_every_node_of_a_large_graph_is_a_source(spark):
    g = graph(spark, [(f"leaf{i}", "hub") for i in range(5200)])
    assert [(r.name, r.betweenness) for r in bridges.top(g).collect()] == [("hub", 0.5)]


def test_arrays_count_paths_through_hubs_and_chunks(monkeypatch):
    monkeypatch.setattr(bridges, "HUB_DEGREE", 5)
    monkeypatch.setattr(bridges, "CHUNK_ROWS", 3)
    pairs = [(0, i) for i in range(1, 9)] + [(1, 2), (3, 4), (8, 9), (9, 10), (10, 11), (4, 5), (12, 13), (13, 14)]
    adj = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in range(15)}
    order = sorted(adj, key=lambda v: -len(adj[v]))
    start = np.cumsum([0] + [len(adj[v]) for v in order])
    ends = np.array([order.index(w) for v in order for w in adj[v]], np.int32)
    got = sum(bridges.dependencies(start, ends, np.arange(lo, lo + 5)) for lo in (0, 5, 10)) / 2 / (14 * 13)
    want = brandes(order, adj)
    assert dict(zip(order, got)) == pytest.approx(want, abs=1e-9)


def test_bridges_are_ordered_by_what_is_shown(spark):
    g = graph(spark, [(f"n{i}", f"n{i + 1}") for i in range(4)])
    assert [r.name for r in bridges.top(g).collect()] == ["n2", "n1", "n3"]
    assert [(r.name, r.betweenness) for r in bridges.top(g, digits=1).collect()] == [("n1", 0.3), ("n2", 0.3), ("n3", 0.3)]


def test_compact_callers_of_names_with_several_symbols(spark):
    g = Graph.from_rows(spark, [("a", "a", "m.py", "function", 1, 2), ("f1", "f", "m.py", "function", 3, 4), ("f2", "f", "m.py", "function", 5, 6), ("h", "h", "m.py", "function", 7, 8)],
                        [("CALLS", "a", "f1", 4), ("CALLS", "a", "f2", 4), ("CALLS", "a", "f2", 2), ("CALLS", "a", "h", 3), ("CALLS", "a", "h", 1), ("REFERENCES", "a", "h", 1)])
    want = {("f", "a", "m.py", "call", "2,4", 3, 1.0), ("h", "a", "m.py", "call", "1,3", 2, 1.0), ("h", "a", "m.py", "reference", "1", 1, 1.0)}
    assert {tuple(r) for r in onehop.callers_compact(g).collect()} == want == {tuple(r) for r in onehop.compact(onehop.callers(g)).collect()}
    assert {tuple(r) for r in onehop.callers_compact(g, "f", "m.py").collect()} == {("f", "a", "m.py", "call", "2,4", 3, 1.0)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_edges_move_once_for_each_end(spark):
    g = projections.commerce(spark, "/root/testdata/sf0.001", "CALLS", "REFERENCES", "EXTENDS")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (onehop.callers(g), onehop.callees(g)):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            # Of lines, orders and symbols as ever; of edges one for each end, none to make them distinct or to meet names.
            assert "hashpartitioning(kind" not in plan and "hashpartitioning(dst_name" not in plan and "hashpartitioning(src_name" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not any("lineitem" in x for x in g.plus("OVERRIDES", g.kind("EXTENDS")).kind("OVERRIDES", "IMPORTS").inputFiles())


def test_chain_depth_is_doubled(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(14)] + [("x", "y"), ("y", "x"), ("n3", "z")]
    depth = liveness.chain_depth(spark.createDataFrame(pairs, "src string, dst string"))
    assert {r.id: r.depth for r in depth.collect()} == {f"n{i}": min(10, 14 - i) for i in range(14)} | {"x": 10, "y": 10}
    assert depth._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1
    assert {r.depth for r in liveness.chain_depth(spark.createDataFrame(pairs, "src string, dst string"), 1).collect()} == {1}


def test_co_change_moves_a_pair_once(spark):
    rows = [("a", 1, "p"), ("a", 1, "q"), ("a", 1, "r"), ("b", 2, "p"), ("b", 2, "q"), ("b", 3, "p"), ("c", 4, "p"), (None, 5, "p"), (None, 5, "q"), ("d", 6, "q"), ("d", 6, None)]
    commits = spark.createDataFrame(rows, "sha string, n long, path string").select("sha", F.timestamp_seconds("n").alias("ts"), F.lit(False).alias("is_merge"), "path")
    pairs = history.co_change(commits)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    # b's p stands twice, at two times, as it does for both.
    assert {tuple(r) for r in pairs.collect()} == {("p", "q", 3), ("q", "p", 3), ("p", "r", 1), ("r", "p", 1), ("q", "r", 1), ("r", "q", 1)}
    # Only the last two of p count for p: at 5 and 4 there is nothing else, and q's last two are at 6 and 5.
    assert {tuple(r) for r in history.co_change(commits, 2).collect()} == {("r", "p", 1), ("r", "q", 1)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_sections_read_the_lines_twice(spark):
    plan = catalogue._sections(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 2


def test_polymorphic_callers(spark):
    g = graph(spark, [("a", "f@1"), ("b", "f@2"), ("c", "one")], files={"f@1": "x.py", "f@2": "y.py"})
    assert onehop.callers(g, "f").count() == 0
    assert {r.caller: r.confidence for r in onehop.callers(g, "f", "x.py").collect()} == {"a": 1.0, "b": 0.6}
    assert [r.confidence for r in onehop.callers(g, "one").collect()] == [1.0]
    assert {r.candidate for r in onehop.ambiguous(g, "f").collect()} == {"x.py::f", "y.py::f"}
    assert onehop.callers(g, "x' OR 1=1").count() == 0


def test_suggestions(spark):
    g = graph(spark, [("render", "reader"), ("writer", "render")])
    wanted = spark.createDataFrame([("rendr",)], "wanted string")
    assert [r.name for r in onehop.suggest(g, wanted).orderBy("rank").collect()][0] == "render"


def test_search_modes(spark):
    g = graph(spark, [("a", "parseFile"), ("b", "parseFile"), ("a", "Parser")])
    assert [r.name for r in search.search(g, "parse", "contains").collect()] == ["parseFile", "Parser"]
    assert search.search(g, "parseFile", "exact").first().score == 1.1
    assert search.search(g, "parsefile", "fuzzy").first().name == "parseFile"
    with pytest.raises(InvalidParams):
        search.search(g, "x", "odd")
    with pytest.raises(IndexNotReady):
        search.search(Graph(g.files, g.symbols.limit(0), g.edges), "x")


def test_reexports_two_and_three_hops(spark):
    rows = [("foo", "bar", True), ("baz", "foo", False), ("m2", "dst", True), ("m1", "m2", True), ("src", "m1", False)]
    imports = spark.createDataFrame(rows, "src string, dst string, re_export boolean")
    got = {(r.target, r.path): (r.depth, r.via) for r in importers.importers(imports).collect()}
    assert got["bar", "baz"] == (2, "foo") and got["dst", "src"] == (3, "m2") and ("foo", "bar") not in got


def test_override_rescue_over_three_levels(spark):
    kinds = dict.fromkeys(["base", "mid", "leaf", "lost", "main"], "method")
    g = graph(spark, [("main", "base")], [("OVERRIDES", "mid", "base"), ("OVERRIDES", "leaf", "mid"), ("OVERRIDES", "other", "lost")], kinds)
    assert {r.symbol for r in liveness.dead_code(g).collect()} == {"lost", "other"}


def test_override_rescue_has_no_last_level(spark, monkeypatch):
    for bound in ("MOST_ROUNDS", "FOLD_ROUNDS"):
        monkeypatch.setattr(liveness, bound, 2, raising=False)
    names = [f"m{i}" for i in range(7)]
    chain = [("OVERRIDES", b, a) for a, b in itertools.pairwise(names)] + [("OVERRIDES", "x", "y"), ("OVERRIDES", "y", "x")]
    g = graph(spark, [("main", "m0")], chain, kinds=dict.fromkeys([*names, "x", "y"], "method"))
    assert sorted(r.symbol for r in liveness.dead_code(g).collect()) == ["x", "y"]


def test_override_of_an_external_parent_is_live(spark):
    g = Graph.from_rows(spark, [("c", "c", "m.py", "method", 1, 2), ("e", "e", "<external>", "external", 0, 0)], [("OVERRIDES", "c", "e", -1)])
    assert liveness.dead_code(g).count() == 0


def test_entry_points_live(spark):
    names = ["main", "test_x", "__init__", "dead"]
    g = Graph.from_rows(spark, [(n, n, "m.py", "function", i, i) for i, n in enumerate(names)] + [("GET", "GET", "app/api/route.ts", "function", 1, 1), ("t", "t", "tests/t.py", "function", 1, 1)], [])
    assert [r.symbol for r in liveness.dead_code(g).collect()] == ["dead", "test_x"]
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert [r.symbol for r in liveness.dead_code(g, handlers=one([("dead",)], "name string"), scripts=one([("test_x",)], "name string")).collect()] == []
    assert [r.symbol for r in liveness.dead_code(g, exported=one([("__init__.py", "dead"), ("other/__init__.py", "test_x")], "file string, name string")).collect()] == ["test_x"]
    assert liveness.dead_code(g, c_libraries=one([("",)], "dir string")).count() == 0


def test_chain_depth(spark):
    rows = spark.createDataFrame([(f"m{i}", f"m{i - 1}") for i in range(1, 15)], "src string, dst string")
    got = {r.id: r.depth for r in liveness.chain_depth(rows).collect()}
    assert got["m1"] == 1 and got["m9"] == 9 and got["m14"] == 10


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=15))
def test_reach_equals_plain_search(spark, pairs):
    g = graph(spark, [(f"n{a}", f"n{b}") for a, b in pairs])
    adj = {}
    for a, b in pairs:
        adj.setdefault(f"n{a}", set()).add(f"n{b}")
        adj.setdefault(f"n{b}", set()).add(f"n{a}")
    seed = f"n{pairs[0][0]}"
    dist, q = {seed: 0}, deque([seed])
    while q:
        u = q.popleft()
        for v in adj[u] if dist[u] < 3 else ():
            if v not in dist:
                dist[v] = dist[u] + 1
                q.append(v)
    got = {r.name: r.depth for r in impact.reach(g, spark.createDataFrame([(seed,)], "seed string"), 3).collect()}
    assert got == dist


def test_visited_cap_keeps_the_nearest(spark):
    g = graph(spark, [(f"c{i}", "x") for i in range(9)] + [("y", "c0")])
    rows = impact.reach(g, spark.createDataFrame([("x",)], "seed string"), 3, 5).collect()
    assert len(rows) == 5 and {r.depth for r in rows} == {0, 1}


def test_guessed_only_lowers_confidence(spark):
    files = {"f@1": "x.py", "f@2": "y.py", "a": "a.py", "b": "b.py"}
    g = graph(spark, [("a", "f@1"), ("b", "f@1")], [("CALLS_HEURISTIC", "a", "f@1")], files=files)
    reached = impact.reach(g, spark.createDataFrame([("f",)], "seed string"), 1)
    got = {r.path: (r.relation, r.confidence) for r in impact.explain(g, impact.impacted_files(g, reached)).collect()}
    assert got["a.py"] == ("name_guess", 0.6) and got["b.py"] == ("called_by_seed_directly", 1.0) and got["x.py"] == ("shares_function_name", 0.6)


def test_text_filter(spark):
    files = spark.createDataFrame([("f", "a.py", 0), ("f", "b.py", 1), ("f", "c.py", 1)], "seed string, path string, depth int")
    reached = spark.createDataFrame([("f", "f"), ("f", "g")], "seed string, name string")
    texts = spark.createDataFrame([("b.py", "x = g(1)"), ("c.py", "fg gf f_")], "path string, text string")
    assert {r.path for r in impact.text_filter(files, reached, texts).collect()} == {"a.py", "b.py"}


@pytest.mark.parametrize(("tests", "breaks", "files", "score", "level"), [(0, 0, 0, 0.0, "low"), (0, 10, 0, 0.4, "medium"), (0, 10, 20, 0.7, "high"), (10, 10, 40, 0.3, "low"), (20, 10, 0, 0.0, "low")])
def test_impact_risk_bounds(spark, tests, breaks, files, score, level):
    c = F.lit
    value = F.round(impact.impact_risk(c(tests), c(breaks), c(files), c(0), c(3), c(0), c(0)), 6)
    row = spark.range(1).select(value.alias("s"), impact.risk_level(value).alias("l")).first()
    assert (row.s, row.l) == (pytest.approx(score), level)


def test_risk_score_without_signal_or_callers(spark):
    c = F.lit
    row = spark.range(1).select(impact.risk_score(c(0), c(0), c(0), c(0), c(0)).alias("none"), impact.risk_score(c(0), c(0), c(1), c(0), c(0)).alias("fresh")).first()
    assert row.none == 0 and row.fresh == pytest.approx(0.2 + 0.015)
    reasons = spark.range(1).select(impact.risk_reasons(c(1.0), c(0.1), c(1.0), c(1.0)).alias("r")).first().r
    assert reasons == ["low test coverage", "deep transitive propagation", "public API or config exposure"]


def test_validate():
    with pytest.raises(InvalidParams):
        impact.validate(None, [], "")
    impact.validate("f", None, None)


def test_longest_prefix_and_names(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z.py",), ("ab/c.py",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",), ("",)], "root string")
    assert {r.path: r.root for r in architecture.owners(paths, roots).collect()} == {"a/b/c.py": "a/b", "a/x.py": "a", "z.py": "", "ab/c.py": ""}
    named = architecture.names(spark.createDataFrame([("x/core",), ("y/core",), ("",), ("lib",)], "root string"))
    assert {r.root: r.module for r in named.collect()} == {"x/core": "x/core", "y/core": "y/core", "": "(root)", "lib": "lib"}
    found = architecture.discover(spark.createDataFrame([("x/Cargo.toml",), ("x/package.json",), ("vendor/y/go.mod",), ("App.csproj",)], "path string"), ["vendor"])
    assert {r.root: r.conventions for r in found.collect()} == {"x": "cargo,npm", "": "csproj"}


def test_architecture_edges(spark):
    files = {"a": "m/a.py", "b": "n/b.py", "c": "n/c.py"}
    g = graph(spark, [("a", "b"), ("a", "c"), ("b", "c")], [("EXTENDS", "b", "a"), ("IMPORTS", "m/a.py", "n/b.py"), ("IMPORTS_NAMED", "m/a.py", "b")], files=files)
    g = Graph(g.files, g.symbols.where("id not like '%/%'"), g.edges)
    got = {(r.from_module, r.to_module, r.kind): r.weight for r in architecture.edges(g, spark.createDataFrame([("m",), ("n",)], "root string")).collect()}
    assert got == {("m", "n", "calls"): 2, ("n", "m", "extends"): 1, ("m", "n", "imports"): 1}


def test_history(spark):
    rows = [(f"c{i}", f"2024-01-{i + 1:02}", "fix crash" if i % 2 else "prefix", False, x) for i in range(4) for x in ("a", "b")] + [("m", "2024-02-01", "merge", True, "a"), ("m", "2024-02-01", "merge", True, "z")]
    commits = spark.createDataFrame(rows, "sha string, ts string, subject string, is_merge boolean, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.target, r.path, r.commits) for r in history.co_change(commits).orderBy("target").collect()] == [("a", "b", 4), ("b", "a", 4)]
    assert history.co_change(commits, most_files=1).count() == 0
    row = history.churn(commits).where("path = 'a'").first()
    assert (row.commits, row.bugs, row.churn, row.bug_share) == (4, 2, 0.2, 0.5)
    freq = spark.createDataFrame([(f"p{i}", n) for i, n in enumerate([1, 1, 2, 12])], "path string, commits long")
    assert history.upper_median(freq).first().median == 2
    assert {r.path: r.multiplier for r in history.hub_penalty(freq).collect()}["p3"] == 0.5


def test_resolution_tiers_and_ties(spark):
    symbols = spark.createDataFrame([("1", "f", "a/x.py", "function", 1), ("2", "g", "a/x.py", "function", 2), ("3", "g", "a/y.py", "function", 3), ("4", "h", "b/z.py", "function", 4), ("5", "h", "a/w.py", "function", 5), ("6", "k", "c/1.py", "function", 6), ("7", "k", "d/2.py", "function", 7)], "id string, name string, file string, kind string, seq long")
    pending = spark.createDataFrame([("a/x.py", "f", "g", 1), ("a/x.py", "f", "h", 2), ("a/x.py", "f", "print", 3), ("a/x.py", "f", "k", 4), ("a/x.py", "f", "alias", 5), ("a/x.py", "nobody", "g", 6), ("a/x.py", "f", "g", 1)], "file string, caller string, callee string, line long")
    imports = resolve.import_map(spark.createDataFrame([("a/x.py", "a/y.py", [("alias", "g")], 1), ("a/x.py", "b/z.py", [("alias", "h")], 2)], "file string, target_file string, names array<struct<local: string, original: string>>, line long"))
    got = {r.line: (r.dst, r.tier) for r in resolve.resolve_calls(pending, symbols, imports).collect()}
    assert got == {1: ("2", 1), 2: ("5", 3), 3: ("__external__::print", 4), 4: ("6", 3), 5: ("3", 2)}
    scopes = spark.createDataFrame([("a/x.py", "A"), ("c/1.py", "C"), ("d/2.py", "D")], "file string, scope string")
    deps = spark.createDataFrame([("A", "D")], "scope string, dep string")
    assert {r.line: r.dst for r in resolve.resolve_calls(pending, symbols, imports, scopes, deps).collect()}[4] == "7"


def test_inheritance(spark):
    symbols = spark.createDataFrame([("A", "A", "a.py", "interface", 1, None, False), ("A.m", "m", "a.py", "method", 2, "A", False), ("B", "B", "b.py", "class", 3, None, False), ("B.m", "m", "b.py", "method", 4, "B", True), ("B.q", "q", "b.py", "method", 5, "B", True)], "id string, name string, file string, kind string, seq long, enclosing string, is_override boolean")
    edges = resolve.extends(spark.createDataFrame([("b.py", "B", "A"), ("b.py", "B", "B"), ("b.py", "B", "Nope")], "file string, name string, base string"), symbols)
    assert {tuple(r) for r in edges.collect()} == {("EXTENDS", "B", "A"), ("IMPLEMENTS", "B", "A")}
    over, missing = resolve.overrides(symbols, resolve.contains(symbols), edges.where("kind = 'EXTENDS'").select("src", "dst"))
    assert [tuple(r) for r in over.collect()] == [("B.m", "A.m")] and [r.id for r in missing.collect()] == ["B.q"]


def test_references_and_decorators(spark):
    symbols = spark.createDataFrame([("1", "f", "a.py", 1), ("2", "T", "b.py", 2), ("3", "route", "lib.py", 3)], "id string, name string, file string, seq long")
    pending = spark.createDataFrame([("a.py", "f", "T", 1, "map_value"), ("a.py", "f", "T", 1, "fn_arg"), ("a.py", None, "T", 2, "type_position"), ("a.py", None, "T", 3, "fn_arg"), ("a.py", "f", "f", 4, "fn_arg")], "file string, enclosing string, name string, line long, ref_kind string")
    assert sorted(tuple(r) for r in resolve.references(pending, symbols).collect()) == [("MODULE_TYPED", "a.py", "2", 2, "type_position"), ("REFERENCES", "1", "2", 1, "fn_arg")]
    marks = spark.createDataFrame([("a.py", "1", "app.route", "'/x'"), ("a.py", "1", "unknown", "")], "file string, symbol string, decorator string, args string")
    assert [tuple(r) for r in resolve.decorates(marks, symbols).collect()] == [("3", "1", "'/x'")]


def test_budget_fold_closes_a_section_and_goes_on(spark):
    items = spark.createDataFrame([("k", 0, 0, "a", 50), ("k", 0, 1, "b", 60), ("k", 0, 2, "c", 1), ("k", 1, 0, "d", 40), ("k", 2, 0, "e", 20)], "key string, section int, place int, id string, tokens long")
    row = context.pack_sections(items, 100).first()
    assert (row.used, row.taken) == (90, "a,d")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40)), max_size=12))
def test_budget_fold_equals_a_loop(spark, items):
    rows = sorted((s, i, f"i{i}", t) for i, (s, t) in enumerate(items))
    used, closed, taken = 0, None, []
    for s, _, name, t in rows:
        if closed == s:
            continue
        if used + t > 60:
            closed = s
        else:
            used += t
            taken.append(name)
    if rows:
        got = context.pack_sections(spark.createDataFrame([("k", *r) for r in rows], "key string, section int, place int, id string, tokens long"), 60).first()
        assert (got.used, got.taken) == (used, ",".join(taken))


def test_minimal_context_takes_the_seed_first(spark):
    g = graph(spark, [("a", "f"), ("f", "b")], [("TESTED_BY", "f", "t")], files={"f": "f.py", "t": "tests/test_f.py"})
    texts = spark.createDataFrame([("f.py", "l1\nl2\nl3\nl4\nl5\nl6\n" * 3), ("m.py", "x\n" * 20), ("tests/test_f.py", "def t(): pass\n")], "path string, text string")
    rows = context.minimal_context(g, texts, "f").collect()
    assert {r.section for r in rows} == {0, 1, 2, 3} and all(r.taken for r in rows)
    assert [r.id for r in context.minimal_context(g, texts, "f", budget=8).where("taken and section = 0").collect()] == ["f"]


def test_evaluation_conventions(spark):
    s = "task string, item string"
    tasks = spark.createDataFrame([("both",), ("none",), ("empty",), ("half",)], "task string")
    expected = spark.createDataFrame([("both", "x"), ("none", "x"), ("half", "x"), ("half", "y")], s)
    actual = spark.createDataFrame([("both", "x"), ("half", "x"), ("half", "z")], s)
    got = {r.task: (r.precision, r.recall, r.f) for r in evaluate.prf(expected, actual, tasks).collect()}
    assert got == {"both": (1, 1, 1), "none": (0, 0, 0), "empty": (0, 1, 1), "half": (0.5, 0.5, 0.5)}
    ranks = spark.createDataFrame([(1, 5), (2, 5), (3, 9)], "item long, v long")
    assert {r.item: r["rank"] for r in evaluate.average_ranks(ranks, "v").collect()} == {1: 1.5, 2: 1.5, 3: 3.0}


def test_change_set_and_rename(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "path string, hash string")
    assert {r.path: r.status for r in catalog.change_set(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "unchanged", "d": "added"}
    g = graph(spark, [("a", "f")], [("REFERENCES", "b", "f")])
    assert {(r.kind, r.confidence) for r in catalog.rename_sites(g, "f").collect()} == {("definition", 1.0), ("call", 0.9), ("reference", 0.7)}


def test_strict_subsets(spark):
    g = graph(spark, [("a", "b")], [("CALLS_HEURISTIC", "a", "b"), ("IMPLEMENTS", "x", "y")])
    assert g.subset_violations("CALLS_HEURISTIC", "CALLS").count() == 0
    assert g.subset_violations("IMPLEMENTS", "EXTENDS").count() == 1


PATHS = [
    ("test_a.py", True), ("a_test.py", True), ("a.py", False), ("x/tests/a.py", True), ("a_test.go", True), ("_test.go", False), ("tests/a.go", False), ("a_test.rs", True), ("b/spec/a.rs", True),
    ("a.test.ts", True), ("a.spec.jsx", True), ("a.ts", False), ("__tests__/a.mjs", True), ("FooTest.java", True), ("FooIT.java", True), ("Foo.java", False), ("src/commonTest/kotlin/A.kt", True), ("Test/kotlin/A.kt", False),
    ("ATests.cs", True), ("a_spec.rb", True), ("ATest.php", True), ("tests/readme.md", False),
]


def test_test_paths(spark):
    rows = spark.createDataFrame(PATHS, "path string, want boolean").select("path", "want", p.is_test_path(F.col("path")).alias("got"))
    assert [r.path for r in rows.where("got != want").collect()] == []


def test_other_predicates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(p.is_framework_routed(F.lit("app/x/page.tsx"))) and not one(p.is_framework_routed(F.lit("lib/page.tsx")))
    assert one(p.is_dunder(F.lit("__init__"))) and not one(p.is_dunder(F.lit("____")))
    assert one(p.is_config(F.lit("config/prod.yaml"))) and not one(p.is_config(F.lit(".github/x.yml"))) and one(p.is_config(F.lit(".env.local")))
    assert one(p.clean_path(F.lit("a/./b/../c"))) == "a/c"
    assert one(p.glob_matches(F.lit("packages/a"), "packages/*")) and not one(p.glob_matches(F.lit("packages/a/b"), "packages/*")) and one(p.glob_matches(F.lit("packages/a/b"), "packages/**"))
    assert one(p.identifiers(F.lit("foo_bar X y1-zz"))) == ["foo_bar", "foo", "bar", "y1", "zz"]
    assert one(p.lines(F.lit("a\nb\n"))) == ["a", "b"] and one(p.lines(F.lit(""))) == []
    assert one(p.camel_tail(F.lit("readFileSync"))) == "Sync"
    assert one(p.is_bug_subject(F.lit("Fixes #1"))) and not one(p.is_bug_subject(F.lit("prefix fixture")))
    assert one(p.string_has_token(F.lit('x = "call foo now"'), "foo")) and not one(p.string_has_token(F.lit('foo = "food"'), "foo"))
    assert one(p.shared_segments(F.lit("a/b/c.py"), F.lit("a/b/d.py"))) == 2
    params = F.array(F.struct(F.lit("a").alias("name"), F.lit("int").alias("type"), F.lit("1").alias("default_value")))
    assert one(p.signature(F.lit("f"), F.array(F.lit("async")), params, F.lit("str"))) == "async f(a: int = 1) -> str"
    assert one(p.common_prefix(F.lit("abcd"), F.lit("abX"))) == 2 and one(p.common_prefix(F.lit("a"), F.lit(""))) == 0


IGNORED = [
    ("build/x.py", ["build/"], True), ("build", ["build/"], False), ("a/build/x.py", ["build/"], True), ("a/x.log", ["*.log"], True), ("x.py", ["/x.py"], True), ("a/x.py", ["/x.py"], False),
    ("a/b/x.py", ["a/**/x.py"], True), ("a/x.py", ["a/**/x.py"], True), ("doc/a/b.md", ["doc/*.md"], False), ("keep.log", ["*.log", "!keep.log"], False), ("a1.py", ["a?.py"], True), ("a.py", ["# a.py", ""], False),
]


@pytest.mark.parametrize(("path", "lines", "want"), IGNORED)
def test_ignore_files(spark, path, lines, want):
    assert spark.range(1).select(p.git_ignored(F.lit(path), lines).alias("x")).first().x == want


def test_baselines_and_siblings(spark):
    texts = spark.createDataFrame([("a", "foo foo"), ("b", "foo food"), ("c", "none")], "path string, text string")
    assert [(r.path, r.hits) for r in evaluate.grep_ranking(texts, "foo").collect()] == [("a", 2), ("b", 1)]
    assert [r["rank"] for r in evaluate.random_ranking(texts, 1).collect()] == [1, 2, 3]
    paths = spark.createDataFrame([("t/FileReaderTest.java",), ("t/FileWriterTest.java",), ("t/OtherTest.java",), ("src/File.java",)], "path string")
    assert [r.path for r in context.sibling_tests(paths, "FileReader").collect()] == ["t/FileReaderTest.java", "t/FileWriterTest.java", "t/OtherTest.java"]
