"""Totals, health tallies, change sets, ego graphs, rename sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.predicates import has_token, string_has_token
from ..graph import Graph


def counts(g: Graph) -> DataFrame:
    """(what, kind, n): files by language, symbols and edges by kind."""
    files = g.files.groupBy(F.coalesce("lang", F.lit("")).alias("kind")).agg(F.count("*").alias("n")).select(F.lit("file").alias("what"), "kind", "n")
    symbols = g.symbols.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("symbol").alias("what"), "kind", "n")
    edges = g.edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n")
    return files.unionByName(symbols).unionByName(edges)


def health(g: Graph, hub_degree: int = 10) -> DataFrame:
    """One row: hubs (degree of hub_degree or more over calls and guessed calls, externals too), dead (no incoming call or
    reference, any kind), tested (production symbols with a test). Looser than hubs.top and dead_code, hence the names."""
    ends = g.kind("CALLS", "CALLS_HEURISTIC").select(F.explode(F.array("src", "dst")).alias("id"))
    busy = ends.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= hub_degree).agg(F.count("*").alias("loose_hubs"))
    into = g.kind("CALLS", "REFERENCES").select(F.col("dst").alias("id")).distinct()
    dead = g.internal().where(F.col("kind").isin("function", "method", "class", "interface")).join(into, "id", "left_anti").agg(F.count("*").alias("loose_dead"))
    tested = g.kind("TESTED_BY").agg(F.countDistinct("src").alias("tested"))
    return busy.crossJoin(F.broadcast(dead)).crossJoin(F.broadcast(tested))


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, modified, unchanged or deleted, from (path, hash) before and after; null equals null."""
    a, b = old.select("path", F.col("hash").alias("old"), F.lit(True).alias("was")), new.select("path", F.col("hash").alias("new"), F.lit(True).alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def ego(g: Graph, center: str, most_nodes: int = 5000, most_edges: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, name, file, kind), edges (kind, src, dst)): a symbol's neighbours by any edge and the calls among them."""
    around = g.edges.where((F.col("src") == center) | (F.col("dst") == center))
    ids = around.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = g.symbols.join(ids, "id", "left_semi").select("id", "name", "file", "kind").orderBy(F.col("id") != center, "id").limit(most_nodes)
    inner = g.kind("CALLS").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, inner.select("kind", "src", "dst").distinct().orderBy("src", "dst").limit(most_edges)


def rename_sites(g: Graph, target: str, file: str | None = None) -> DataFrame:
    """(file, line, kind, confidence, symbol): definitions (1.0), calls (0.9), references (0.7), imports by name (0.9, line 0).

    With definitions in several files, uses of the ones outside the hinted file are polymorphic, at 0.6.
    """
    defs = g.internal().where(F.col("name") == target)
    several = F.lit(defs.select("file").distinct().limit(2).count() > 1)
    here = defs if file is None else defs.where(F.col("file") == file)
    own = here.select("file", "line", F.lit("definition").alias("kind"), F.lit(1.0).alias("confidence"), F.col("name").alias("symbol"))
    uses = g.ends("CALLS", "REFERENCES", dst=defs, first="dst")
    sure = F.when(F.col("edge") == "CALLS", 0.9).otherwise(0.7)
    other = several & (F.lit(file is None) | (F.col("dst_file") != F.lit(file or "")))
    uses = uses.select(F.col("src_file").alias("file"), "line", F.when(F.col("edge") == "CALLS", "call").otherwise("reference").alias("kind"), F.when(other, 0.6).otherwise(sure).alias("confidence"), F.col("src_name").alias("symbol"))
    named = g.kind("IMPORTS_NAMED").join(defs.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("file"), F.lit(0).cast("long").alias("line"), F.lit("import").alias("kind"), F.lit(0.9).alias("confidence"), F.lit(target).alias("symbol"))
    whole = g.kind("IMPORTS").where(F.array_contains("imported_names", target)).select(F.col("src").alias("file"), F.lit(0).cast("long").alias("line"), F.lit("import").alias("kind"), F.lit(0.9).alias("confidence"), F.lit(target).alias("symbol"))
    every = own.union(uses).union(named).union(whole)
    return every.groupBy("file", "line", "kind", "symbol").agg(F.max("confidence").alias("confidence")).select("file", "line", "kind", "confidence", "symbol")


def rename_blockers(lines: DataFrame, target: str) -> DataFrame:
    """(path, line_no): lines whose string literals have the target; renaming can't see through them."""
    return lines.where(has_token(F.col("text"), target) & string_has_token(F.col("text"), target)).select("path", "line_no")


def language_stats(parsed: DataFrame, most_failed: float = 0.3) -> DataFrame:
    """(lang, files, failed, share, alert) from (lang, ok): whether too many files of a language failed to parse."""
    rows = parsed.groupBy("lang").agg(F.count("*").alias("files"), F.count_if(~F.col("ok")).alias("failed"))
    share = F.col("failed") / F.col("files")
    return rows.select("lang", "files", "failed", F.round(share, 6).alias("share"), (share > most_failed).alias("alert"))


def file_facts(texts: DataFrame) -> DataFrame:
    """(path, lang, size, loc, hash, is_generated, is_vendored, is_test) of (path, text)."""
    t = F.col("text")
    return texts.select(
        "path", p.language(F.col("path")).alias("lang"), F.octet_length(t).cast("long").alias("size"), F.regexp_count(t, F.lit("\n")).cast("long").alias("loc"), F.sha2(t, 256).alias("hash"),
        p.is_generated(F.col("path")).alias("is_generated"), p.is_vendored(F.col("path")).alias("is_vendored"), p.is_test_path(F.col("path")).alias("is_test"),
    )
