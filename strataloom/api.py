"""The tool surface: one request, one answer of plain lists and dicts, capped where the surface caps.

Every answer is at most a few hundred rows, so collecting it is bounded; what leads to it stays in DataFrames.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import InvalidParams, SymbolNotFound
from .functions import predicates as p
from .graph import Graph
from .operators import architecture, bridges, catalog, context, history, hubs, impact, importers, liveness, onehop, search
from .sources import text
from .tables import written

# Scope markers that a qualified name may start with.
ROOTS = ("crate", "self", "super", "this", "cls")
PAGE = 50


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def to_json(answer: dict) -> str:
    return json.dumps(answer, sort_keys=True, default=str)


def to_markdown(rows: list[dict]) -> str:
    """Rows as a table."""
    if not rows:
        return ""
    names = list(rows[0])
    say = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(say(r[n]) for n in names) + " |" for r in rows)])


class Session:
    """Questions about one graph, its texts (path, text) and its commits (sha, ts, subject, is_merge, path)."""

    def __init__(self, g: Graph, texts: DataFrame | None = None, commits: DataFrame | None = None):
        self.g, self.texts, self.commits = g, texts, commits
        self.spark = g.symbols.sparkSession

    # One hop

    def suggestions(self, symbol: str) -> list[str]:
        asked = self.spark.createDataFrame([(symbol,)], "wanted string")
        return [r.name for r in onehop.suggest(self.g, asked).orderBy("rank").collect()]

    def _ambiguity(self, symbol: str, file: str | None) -> dict | None:
        """The ambiguity answer of an unhinted name that several files define."""
        if file is not None:
            return None
        candidates = _rows(onehop.ambiguous(self.g, symbol).orderBy("file", "line").limit(PAGE))
        return {"reason": "ambiguous", "candidates": candidates} if candidates else None

    def callers(self, symbol: str, file: str | None = None, include_uncertain: bool = False) -> dict:
        return self._one_hop(symbol, file, include_uncertain, onehop.callers, ["caller_file", "caller", "call_site_line", "kind"])

    def callees(self, symbol: str, file: str | None = None, include_uncertain: bool = False) -> dict:
        return self._one_hop(symbol, file, include_uncertain, onehop.callees, ["callee_file", "callee", "call_site_line", "kind"])

    def _one_hop(self, symbol, file, include_uncertain, find, order) -> dict:
        unclear = self._ambiguity(symbol, file)
        if unclear:
            return {"rows": [], "disambiguation": unclear}
        rows = find(self.g, symbol, file)
        rows = _rows((rows if include_uncertain else rows.where("confidence = 1.0")).orderBy(*order))
        known = bool(rows) or not self.g.internal().where(F.col("name") == symbol).limit(1).isEmpty()
        return {"rows": rows} if known else {"rows": [], "suggestions": self.suggestions(symbol)}

    def importers(self, path: str) -> dict:
        edges = self.g.kind("IMPORTS").select("src", "dst", "re_export")
        return {"rows": _rows(importers.importers(edges, path).orderBy("path"))}

    def symbols(self, pattern: str, mode: str = "exact") -> dict:
        return {"rows": _rows(search.search(self.g, pattern, mode))}

    def file_summary(self, path: str) -> dict:
        rows = _rows(onehop.file_summary(self.g, path))
        return rows[0] if rows else {"file": path, "n_symbols": 0, "symbols": "", "imports": ""}

    def large_functions(self, **options) -> dict:
        return {"rows": _rows(search.large_functions(self.g, **options))}

    # Structure

    def hubs(self, top_n: int = 10, symbol: str | None = None, file: str | None = None, edge_types: str = "default") -> dict:
        out = {"hubs": _rows(hubs.top(self.g, top_n, edge_types))}
        return out | ({"target": _rows(hubs.rank_of(self.g, symbol, file, edge_types))} if symbol else {})

    def bridges(self, top_n: int = 10) -> dict:
        return {"bridges": _rows(bridges.top(self.g, top_n))}

    def architecture(self, max_modules: int | None = None) -> dict:
        search.ready(self.g)
        paths = self.texts.select("path") if self.texts is not None else self.g.files.select("path")
        roots = written(architecture.discover(paths.union(self.g.files.select("path")).distinct()))
        found = architecture.modules(self.g, roots, max_modules)
        kept = found if max_modules is not None else None
        edges = architecture.edges(self.g, roots, kept).orderBy("from_module", "to_module", "kind")
        return {"modules": _rows(found), "edges": _rows(edges)}

    def layers(self) -> dict:
        """Modules by their number of symbols, the largest first."""
        found = self.architecture()["modules"]
        return {"layers": sorted(({"name": m["module"], "symbol_count": m["symbol_count"]} for m in found), key=lambda m: (-m["symbol_count"], m["name"]))}

    def layer_symbols(self, layer: str, offset: int = 0, limit: int = PAGE) -> dict:
        """A page of the symbols of one module, by file, line and name."""
        root = next((m["root"] for m in self.architecture()["modules"] if m["module"] == layer), None)
        if root is None:
            raise InvalidParams(f"no such layer: {layer}")
        paths = self.texts.select("path") if self.texts is not None else self.g.files.select("path")
        roots = architecture.discover(paths.union(self.g.files.select("path")).distinct())
        own = architecture.owners(self.g.files.select("path"), roots).where(F.col("root") == root)
        rows = self.g.internal().join(own.select(F.col("path").alias("file")), "file", "left_semi").select("id", "name", "kind", "file", "line")
        return self._page(rows, ["file", "line", "name", "id"], offset, limit)

    def _page(self, rows: DataFrame, order: list[str], offset: int, limit: int) -> dict:
        shown, total, more = search.page(rows, order, offset, limit)
        return {"rows": _rows(shown), "total": total, "has_more": more}

    def symbol_detail(self, name: str) -> dict:
        """The first definition of a name with its signature, its counts and whether a test covers it."""
        s = self.g.internal().where(F.col("name") == name)
        found = _rows(s.withColumn("signature", p.signature(F.col("name"), F.col("modifiers"), F.col("params"), F.col("return_type"))).orderBy("file", "line", "id").limit(1))
        if not found:
            raise SymbolNotFound(f"no symbol {name}", self.suggestions(name))
        at = found[0]
        callers, callees = onehop.callers(self.g, name).count(), onehop.callees(self.g, name).count()
        reverse = importers.importers(self.g.kind("IMPORTS").select("src", "dst", "re_export"), at["file"]).count()
        tested = not self.g.kind("TESTED_BY").join(s.select(F.col("id").alias("src")), "src", "left_semi").limit(1).isEmpty()
        return at | {"loc": at["line_end"] - at["line"] + 1, "caller_count": callers, "callee_count": callees, "importer_count": reverse, "tested": tested}

    def ego(self, symbol_id: str) -> dict:
        """A symbol's neighbours and the calls among them."""
        nodes, edges = catalog.ego(self.g, symbol_id)
        return {"nodes": _rows(nodes), "edges": _rows(edges)}

    def file(self, path: str) -> dict:
        """A file's summary and the files that import it."""
        return self.file_summary(path) | {"imported_by": [r["path"] for r in self.importers(path)["rows"] if r["depth"] == 1]}

    def counts(self) -> dict:
        return {"counts": _rows(catalog.counts(self.g).orderBy("what", "kind")), "health": _rows(catalog.health(self.g))[0]}

    def dead_code(self, scope: str | None = None) -> dict:
        facts = text.entry_facts(self.texts) if self.texts is not None else {}
        return {"rows": _rows(liveness.dead_code(self.g, scope, **facts))}

    def rename_safety(self, target: str, replacement: str, file: str | None = None) -> dict:
        for name in (target, replacement):
            if not name or not all(c.isascii() and (c.isalnum() or c in "_$.") for c in name):
                raise InvalidParams(f"not an identifier: {name}")
        search.ready(self.g)
        sites = _rows(catalog.rename_sites(self.g, target, file).orderBy("file", "line", "kind"))
        if not sites:
            raise SymbolNotFound(f"no symbol {target}", self.suggestions(target))
        blockers = _rows(catalog.rename_blockers(text.file_lines(self.texts), target).orderBy("path", "line_no").limit(PAGE)) if self.texts is not None else []
        clash = not self.g.internal().where(F.col("name") == replacement).limit(1).isEmpty()
        return {"sites": sites, "blockers": blockers, "replacement_exists": clash}

    def minimal_context(self, symbol: str, file: str | None = None, budget: int = 2000) -> dict:
        if self.texts is None:
            raise InvalidParams("texts are needed")
        seed = self.seed(symbol, file)
        rows = _rows(context.minimal_context(self.g, self.texts, seed["name"], seed["file"], budget).orderBy("section", "file", "line", "id"))
        return {"sections": [r for r in rows if r["taken"]], "tokens": sum(r["tokens"] for r in rows if r["taken"]), "truncated": any(not r["taken"] for r in rows)}

    # Impact and risk

    def seed(self, symbol: str, file: str | None = None) -> dict:
        """{name, file} of a seed: a bare name, or A::b and A.b, whose member b of A says the file.

        Scope markers before the last part are dropped. A qualified name that no class contains falls back to the bare name
        in the hinted file; else it is SymbolNotFound.
        """
        split = max(symbol.rfind("::"), symbol.rfind("."))
        if split < 0:
            return {"name": symbol, "file": file}
        outer, name = symbol[:split], symbol[split:].lstrip(":.")
        if outer in ROOTS:
            return {"name": name, "file": file}
        if not name.replace("_", "a").replace("$", "a").isalnum() or not outer.replace("_", "a").replace("$", "a").isalnum():
            raise InvalidParams(f"can't read {symbol}")
        ends = self.g.ends("CONTAINS").where((F.col("src_name") == outer) & (F.col("dst_name") == name))
        found = ends.orderBy("dst_file", "dst_line").limit(1).collect()
        if found:
            return {"name": name, "file": found[0].dst_file}
        if file is not None and not self.g.internal().where((F.col("name") == name) & (F.col("file") == file)).limit(1).isEmpty():
            return {"name": name, "file": file}
        raise SymbolNotFound(f"no member {name} of {outer}", self.suggestions(name))

    def impact(self, symbol: str | None = None, changed_files: list[str] | None = None, diff: str | None = None, file: str | None = None, max_depth: int = 3) -> dict:
        """Impacted files, break points, tests, routes, configs and the risk of changing a symbol or files.

        Sections hold at most 50 rows, and say how many there were. Of several files, each impacted file stands at its least
        depth.
        """
        impact.validate(symbol, changed_files, diff)
        g = self.g
        if symbol:
            if not any(x in symbol for x in (".", "::")):
                unclear = self._ambiguity(symbol, file)
                if unclear:
                    return {"disambiguation": unclear}
            at = self.seed(symbol, file)
            seeds, file = self.spark.createDataFrame([(at["name"],)], "seed string"), at["file"]
        else:
            paths = changed_files or [r.path for r in text.diff_paths(self.spark.createDataFrame([("d", diff)], "key string, diff string")).orderBy("place").collect()]
            if not paths:
                raise InvalidParams("the diff names no path")
            seeds = g.internal().join(self.spark.createDataFrame([(x,) for x in paths], "file string"), "file", "left_semi").select(F.col("name").alias("seed")).distinct()
        seeds = written(seeds)
        reached = written(impact.reach(g, seeds, max_depth))
        files = impact.with_siblings(g, impact.impacted_files(g, reached), seeds)
        if self.texts is not None:
            files = impact.text_filter(files, reached, self.texts)
        files = written(impact.explain(g, files, file))
        merged = files.groupBy("path").agg(F.min(F.struct("depth", "reason", "relation", "confidence")).alias("b")).select("path", "b.*")
        into = onehop.break_points(g).join(seeds.withColumnRenamed("seed", "target"), "target", "left_semi")
        tests = impact.affected_tests(g, seeds, commits=self.commits, texts=self.texts).groupBy("path").agg(F.max("reason").alias("reason"))
        out = {
            "impacted_files": self._section(merged, ["depth", "path"]), "break_points": self._section(into, ["file", "line", "target"]), "affected_tests": self._section(tests, ["path"]),
            "affected_routes": self._section(*self._routes(seeds)), "affected_configs": self._section(*self._configs(seeds)),
        }
        shown = {k: len(v["rows"]) for k, v in out.items()}
        depth = max([r["depth"] for r in out["impacted_files"]["rows"]], default=0)
        c = F.lit
        score = impact.impact_risk(c(shown["affected_tests"]), c(shown["break_points"]), c(shown["impacted_files"]), c(depth), c(max_depth), c(shown["affected_routes"]), c(shown["affected_configs"]))
        row = self.spark.range(1).select(F.round(score, 6).alias("score"), impact.risk_level(F.round(score, 6)).alias("level")).first()
        vendored = merged.where(p.vendored_warning(F.col("path"))).limit(1).isEmpty()
        meta = {"max_depth": max_depth, "transitive_completeness": depth, "vendored": not vendored}
        return out | {"risk": row.asDict(), "meta": meta}

    def _section(self, rows: DataFrame | None, order: list[str]) -> dict:
        if rows is None:
            return {"rows": [], "total_available": 0, "truncated": False}
        rows = written(rows)
        total = rows.count()
        return {"rows": _rows(rows.orderBy(*order).limit(impact.SECTION_CAP)), "total_available": total, "truncated": total > impact.SECTION_CAP}

    def _routes(self, seeds: DataFrame) -> tuple[DataFrame | None, list[str]]:
        if self.texts is None:
            return None, []
        found = text.routes(self.texts).join(seeds.withColumnRenamed("seed", "handler"), "handler", "left_semi")
        return found.select("method", "route", F.col("path").alias("source_file")).distinct(), ["route", "method", "source_file"]

    def _configs(self, seeds: DataFrame) -> tuple[DataFrame | None, list[str]]:
        """Lines of configuration files that have a seed or its file's stem: words meet names by equality."""
        if self.texts is None:
            return None, []
        homes = seeds.join(self.g.internal().select(F.col("name").alias("seed"), "file"), "seed").select(p.stem(F.col("file")).alias("word"))
        names = seeds.select(F.col("seed").alias("word")).union(homes).where(F.length("word") > 2).distinct()
        lines = text.file_lines(self.texts.where(p.is_config(F.col("path"))))
        words = lines.select("path", "line_no", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_]+"))).alias("word"))
        return words.join(names, "word", "left_semi").select("path", F.col("line_no").alias("line")).distinct(), ["path", "line"]

    def risk(self, symbol: str | None = None, changed_files: list[str] | None = None, file: str | None = None, anchor: str | None = None) -> dict:
        """Score, level, chain depth; of several files the largest score, with each file's own."""
        if not symbol and not changed_files:
            raise InvalidParams("one of symbol and changed_files is needed")
        if symbol:
            got = self.impact(symbol, file=file)
            if "disambiguation" in got:
                return got
            rows = got["impacted_files"]["rows"]
            if not rows and not got["break_points"]["rows"]:
                raise SymbolNotFound(f"no symbol {symbol}", self.suggestions(symbol))
            home = rows[0]["path"] if rows else got["break_points"]["rows"][0]["file"]
            name = self.seed(symbol, file)["name"]
            depth = liveness.chain_depth(self.g.kind("OVERRIDES")).join(self.g.internal().where(F.col("name") == name).select("id"), "id", "left_semi").agg(F.max("depth")).first()[0]
            return self._score(got, home, anchor) | {"override_chain_depth": depth or 0}
        per_file = {x: self._score(self.impact(changed_files=[x]), x, anchor) for x in changed_files}
        worst = max(per_file, key=lambda x: (per_file[x]["score"], x))
        return per_file[worst] | {"file": worst, "per_file": {x: v["score"] for x, v in per_file.items()}}

    def _score(self, got: dict, home: str, anchor: str | None) -> dict:
        commits = bugs = 0
        if self.commits is not None:
            row = history.churn(self.commits, anchor).where(F.col("path") == home).first()
            commits, bugs = (row.commits, row.bugs) if row else (0, 0)
        n = [F.lit(len(got[k]["rows"])) for k in ("affected_tests", "break_points", "impacted_files")]
        score = F.round(impact.risk_score(*n, F.lit(commits), F.lit(bugs)), 6)
        return self.spark.range(1).select(score.alias("score"), impact.risk_level(score).alias("level")).first().asDict() | {"commits": commits, "bugs": bugs}
