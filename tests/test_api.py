"""The tool surface over a small graph with texts and commits."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom.api import Session, to_json, to_markdown
from strataloom.errors import InvalidParams, SymbolNotFound
from strataloom.graph import Graph


@pytest.fixture(scope="module")
def session(spark):
    symbols = [
        ("C", "Cart", "src/cart.py", "class", 1, 40), ("total", "total", "src/cart.py", "method", 2, 9), ("tax", "tax", "src/tax.py", "function", 1, 3), ("show", "show", "src/views.py", "function", 1, 4),
        ("t", "test_total", "tests/test_cart.py", "function", 1, 2), ("h1", "helper", "src/a.py", "function", 1, 2), ("h2", "helper", "src/b.py", "function", 1, 2),
    ]
    edges = [("CONTAINS", "C", "total", -1), ("CALLS", "total", "tax", 3), ("CALLS", "show", "total", 2), ("CALLS", "t", "total", 1), ("TESTED_BY", "total", "t", -1), ("IMPORTS", "src/views.py", "src/cart.py", 1)]
    texts = [("src/cart.py", "def total(): tax()"), ("src/tax.py", "def tax(): total"), ("src/views.py", "def show(): total()"), ("src/urls.py", "path('sum/', views.total)"), ("conf/app.yaml", "handler: total\n"), ("tests/test_cart.py", "total")]
    commits = [(f"c{i}", f"2024-01-{i + 1:02} 00:00:00", "fix bug" if i % 2 else "work", False, "src/cart.py") for i in range(4)]
    return Session(
        Graph.from_rows(spark, symbols, edges), spark.createDataFrame(texts, "path string, text string"),
        spark.createDataFrame(commits, "sha string, ts string, subject string, is_merge boolean, path string").withColumn("ts", F.col("ts").cast("timestamp")),
    )


def test_one_hop(session):
    assert [r["caller"] for r in session.callers("total")["rows"]] == ["show", "test_total"]
    assert [r["callee"] for r in session.callees("total")["rows"]] == ["tax"]
    assert len(session.callers("helper")["disambiguation"]["candidates"]) == 2
    assert "total" in session.callers("totl")["suggestions"]
    assert [r["path"] for r in session.importers("src/cart.py")["rows"]] == ["src/views.py"]
    assert session.file_summary("src/cart.py")["symbols"] == "Cart,total" and session.file_summary("none")["n_symbols"] == 0


def test_seeds(session):
    assert session.seed("Cart::total") == session.seed("Cart.total") == {"name": "total", "file": "src/cart.py"}
    assert session.seed("self.tax") == {"name": "tax", "file": None}
    with pytest.raises(SymbolNotFound) as e:
        session.seed("Cart.nope")
    assert e.value.suggestions
    with pytest.raises(InvalidParams):
        session.seed("a.b;c")


def test_impact(session):
    got = session.impact("total")
    assert {(r["path"], r["depth"]) for r in got["impacted_files"]["rows"]} == {("src/cart.py", 0), ("src/views.py", 1), ("tests/test_cart.py", 1), ("src/tax.py", 1)}
    assert [r["path"] for r in got["affected_tests"]["rows"]] == ["tests/test_cart.py"]
    assert got["affected_routes"]["rows"] == [{"method": "ANY", "route": "sum/", "source_file": "src/urls.py"}]
    assert got["affected_configs"]["rows"] == [{"path": "conf/app.yaml", "line": 1}]
    assert got["risk"]["score"] == pytest.approx(0.4 * 0.5 + 0.3 * 4 / 20 + 0.15 / 3 + 0.15)
    by_diff = session.impact(diff="--- a/src/tax.py\n+++ b/src/tax.py\n")
    assert {r["path"] for r in by_diff["impacted_files"]["rows"]} >= {"src/tax.py", "src/cart.py"}
    assert "disambiguation" in session.impact("helper")
    with pytest.raises(InvalidParams):
        session.impact()


def test_risk(session):
    got = session.risk("total")
    assert (got["commits"], got["bugs"], got["override_chain_depth"]) == (4, 2, 0)
    assert got["score"] == pytest.approx(0.4 * 0.5 + 0.3 * 4 / 20 + 0.15 * 0.2 + 0.15 * 0.5)
    several = session.risk(changed_files=["src/cart.py", "src/b.py"])
    assert several["file"] == "src/cart.py" and set(several["per_file"]) == {"src/cart.py", "src/b.py"}
    with pytest.raises(SymbolNotFound):
        session.risk("nobody")


def test_structure(session):
    assert session.hubs(3, "total")["target"][0]["rank"] == 1
    assert session.bridges()["bridges"][0]["name"] == "total"
    # Types count as used by their calls only, so a class that nothing calls is listed.
    assert {r["symbol"] for r in session.dead_code("src/")["rows"]} == {"Cart", "show", "helper"}
    renamed = session.rename_safety("total", "sum_all")
    assert {r["kind"] for r in renamed["sites"]} == {"definition", "call"} and not renamed["replacement_exists"]
    with pytest.raises(InvalidParams):
        session.rename_safety("a b", "c")
    assert session.minimal_context("Cart.total")["tokens"] > 0
    assert session.architecture()["modules"] == []


def test_rendering(session):
    answer = session.symbols("tot", "contains")
    assert json.loads(to_json(answer))["rows"][0]["name"] == "total"
    assert to_markdown([{"a": "x|y", "b": 1}]).splitlines()[2] == "| x\\|y | 1 |" and to_markdown([]) == ""


def test_data_endpoints(session, spark):
    got = session.symbol_detail("total")
    assert (got["caller_count"], got["callee_count"], got["importer_count"], got["tested"], got["loc"]) == (2, 1, 1, True, 8)
    with pytest.raises(SymbolNotFound):
        session.symbol_detail("nobody")
    assert {n["id"] for n in session.ego("total")["nodes"]} == {"total", "C", "tax", "show", "t"}
    assert session.file("src/cart.py")["imported_by"] == ["src/views.py"]
    assert session.counts()["health"]["tested"] == 1
    rooted = Session(session.g, session.texts.union(spark.createDataFrame([("src/pyproject.toml", "")], "path string, text string")))
    assert session.layers() == {"layers": []} and rooted.layers() == {"layers": [{"name": "src", "symbol_count": 6}]}
    assert rooted.layer_symbols("src", 1, 2)["has_more"] and len(rooted.layer_symbols("src", 5)["rows"]) == 1
    with pytest.raises(InvalidParams):
        rooted.layer_symbols("none")
