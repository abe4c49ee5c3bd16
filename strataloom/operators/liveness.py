"""Dead code: no caller, no live parent method, no entry point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..graph import Graph
from ..operators.search import ready
from ..tables import written

KINDS = ("function", "method", "class", "interface")
#: Rounds after which the ids found so far become one table, so that plans stay small.
FOLD_ROUNDS = 20


def used_nodes(g: Graph) -> DataFrame:
    """(name, file) that a call, a reference or a module-level type use points to."""
    into = g.kind("CALLS", "REFERENCES", "MODULE_TYPED").select(F.col("dst").alias("id")).distinct()
    return into.join(g.symbols.select("id", "name", "file"), "id").select("name", "file").distinct()


def unused(g: Graph, scope: str | None = None) -> DataFrame:
    """Symbols of the four kinds, under a path prefix, whose (name, file) nothing uses."""
    s = g.internal().where(F.col("kind").isin(*KINDS))
    s = s.where(F.col("file").startswith(scope)) if scope else s
    return s.join(used_nodes(g), ["name", "file"], "left_anti")


def override_live(g: Graph, dead: DataFrame) -> DataFrame:
    """Ids of dead methods that a chain of overrides ties to a live or external parent, or whose parent is unknown.

    Each round adds the dead children of live methods. The loop stops when a round adds none; live ids are never added
    again, so that cycles end too. What each round carries is ids only.
    """
    dead = written(dead.select("id", "has_unresolved_override"))
    dead_ids = dead.select("id")
    chains = g.kind("OVERRIDES").select(F.col("src").alias("child"), F.col("dst").alias("parent")).distinct()
    waiting = written(chains.join(dead_ids.withColumnRenamed("id", "child"), "child", "left_semi"))
    front = written(waiting.join(dead_ids.withColumnRenamed("id", "parent"), "parent", "left_anti").select(F.col("child").alias("id")).distinct())
    live = front
    rounds = 0
    while not front.isEmpty():
        front = written(waiting.join(front.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("child").alias("id")).distinct().join(live, "id", "left_anti"))
        live = live.union(front)
        rounds += 1
        if rounds % FOLD_ROUNDS == 0:
            live = written(live)
    unresolved = dead.where("has_unresolved_override").select("id")
    return live.union(unresolved).distinct()


def entry_points(rows: DataFrame) -> DataFrame:
    """Rows of symbols that something outside the graph starts: main, tests, Python dunders, routed and static files."""
    file, name = F.col("file"), F.col("name")
    is_entry = name.isin("main", "__main__") | p.is_test_path(file) | (file.rlike(r"\.pyi?$") & p.is_dunder(name)) | p.is_framework_routed(file) | file.rlike(r"(^|/)static/")
    return rows.where(is_entry)


def dead_code(g: Graph, scope: str | None = None, handlers: DataFrame | None = None, exported: DataFrame | None = None, scripts: DataFrame | None = None, c_libraries: DataFrame | None = None) -> DataFrame:
    """(symbol, file, kind, line, confidence) of dead symbols, by file and symbol.

    What else counts as an entry: handlers (name) of routes, scripts (name) that a project declares, exported (file, name) in a
    package's __all__ for symbols of that package, and all symbols under c_libraries (dir), crates that export to C.
    sources.text.entry_facts() reads the four from texts.
    """
    dead = written(unused(ready(g), scope))
    dead = dead.join(override_live(g, dead), "id", "left_anti")
    dead = dead.join(entry_points(dead).select("id"), "id", "left_anti")
    for names in (handlers, scripts):
        if names is not None:
            dead = dead.join(names.select("name"), "name", "left_anti")
    if exported is not None:
        here = exported.select(p.dirname(F.col("file")).alias("package"), "name")
        dead = dead.withColumn("package", p.dirname(F.col("file"))).join(here, ["package", "name"], "left_anti")
    if c_libraries is not None:
        from .architecture import owners

        inside = owners(dead.select(F.col("file").alias("path")), c_libraries.select(F.col("dir").alias("root"))).where("root is not null")
        dead = dead.join(inside.select(F.col("path").alias("file")), "file", "left_anti")
    return dead.select(F.col("name").alias("symbol"), "file", "kind", "line", F.lit(0.85).alias("confidence")).orderBy("file", "symbol", "line")


def chain_depth(overrides: DataFrame, most: int = 10) -> DataFrame:
    """(id, depth): how many parents a method has above it, by its first parent each step, at most `most`."""
    # Steps are doubled: the way of two steps is the way of one, twice. Each way is a table of one row for each method.
    way = written(overrides.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("here")).withColumn("depth", F.lit(1)))

    def then(a: DataFrame, b: DataFrame) -> DataFrame:
        more = b.select(F.col("id").alias("at"), F.col("here").alias("end"), F.col("depth").alias("more"))
        return a.join(more, F.col("here") == F.col("at"), "left").select("id", F.col("end").alias("here"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))

    out = None
    while True:
        if most % 2:
            out = way if out is None else written(then(out, way))
        most //= 2
        if not most:
            return out.select("id", "depth")
        way = written(then(way, way))
