"""From pending rows to edges: calls in four tiers, references, imports, inheritance, overrides, decorators, tests.

Where several definitions fit, the earliest in the index order wins; that order is the column `seq`. Candidates are looked
up for each distinct (file, name), not for each use, so a name used a million times costs one lookup in each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p

CLASS_LIKE = ("class", "interface", "struct", "trait", "enum")


def first_in_file(symbols: DataFrame) -> DataFrame:
    """(file, name, id) of the first definition of each name in each file."""
    return symbols.groupBy("file", "name").agg(F.min_by("id", "seq").alias("id"))


def import_map(imports: DataFrame) -> DataFrame:
    """(file, local, target_file, original) from imports (file, target_file, names: [(local, original)], line); first wins."""
    rows = imports.select("file", "target_file", "line", F.posexplode("names").alias("place", "n"))
    best = rows.groupBy("file", F.col("n.local").alias("local")).agg(F.min_by(F.struct("target_file", F.col("n.original").alias("original")), F.struct("line", "place", "target_file")).alias("b"))
    return best.select("file", "local", "b.target_file", "b.original")


def scope_of(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(file, scope) by the longest root; files outside all roots have no row."""
    from .architecture import owners

    return owners(files.select(F.col("file").alias("path")), roots).where("root is not null").select(F.col("path").alias("file"), F.col("root").alias("scope"))


def allowed(candidates: DataFrame, scopes: DataFrame | None, deps: DataFrame | None) -> DataFrame:
    """Candidates (file, target_file, ...) in the caller's scope or a direct dependency of it; unknown scopes allow all."""
    if scopes is None:
        return candidates
    rows = candidates.join(scopes, "file", "left").join(scopes.select(F.col("file").alias("target_file"), F.col("scope").alias("target_scope")), "target_file", "left")
    rows = rows.join(deps.select("scope", F.col("dep").alias("target_scope"), F.lit(True).alias("direct")).distinct(), ["scope", "target_scope"], "left")
    ok = F.col("scope").isNull() | F.col("target_scope").isNull() | (F.col("scope") == F.col("target_scope")) | F.coalesce("direct", F.lit(False))
    return rows.where(ok).drop("scope", "target_scope", "direct")


def proximal(wanted: DataFrame, symbols: DataFrame, scopes: DataFrame | None = None, deps: DataFrame | None = None) -> DataFrame:
    """(file, name, id): for each wanted (file, name), the definition whose path shares most leading segments.

    Equal shares go to the earliest. Definitions of a name in one file are one candidate, its first.
    """
    firsts = symbols.groupBy(F.col("file").alias("target_file"), "name").agg(F.min(F.struct("seq", "id")).alias("at"))
    rows = allowed(wanted.select("file", "name").distinct().join(firsts, "name"), scopes, deps)
    share = p.shared_segments(F.col("file"), F.col("target_file"))
    return rows.groupBy("file", "name").agg(F.min_by("at.id", F.struct(-share, F.col("at.seq"))).alias("id"))


def resolve_calls(pending: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, scopes: DataFrame | None = None, deps: DataFrame | None = None) -> DataFrame:
    """(src, dst, line, tier) from pending calls (file, caller, callee, line); symbols has id, name, file, seq.

    Tiers: 1 the same file, 2 the file's import map, 3 the nearest definition anywhere (heuristic), 4 an external node. A
    caller that its file doesn't define drops the call. Equal (src, dst, line) stand once.
    """
    symbols = symbols.where("kind != 'external'") if "kind" in symbols.columns else symbols
    own = first_in_file(symbols)
    uses = pending.select("file", F.col("callee").alias("name")).distinct()
    t1 = uses.join(own.withColumnRenamed("id", "id1"), ["file", "name"], "left")
    if imports is not None:
        via = imports.join(own.select(F.col("file").alias("target_file"), F.col("name").alias("original"), F.col("id").alias("id2")), ["target_file", "original"])
        t1 = t1.join(via.select("file", F.col("local").alias("name"), "id2"), ["file", "name"], "left")
    else:
        t1 = t1.withColumn("id2", F.lit(None).cast("string"))
    missing = t1.where("id1 is null and id2 is null")
    t3 = proximal(missing, symbols, scopes, deps).withColumnRenamed("id", "id3")
    found = t1.join(t3, ["file", "name"], "left")
    external = F.concat(F.lit("__external__::"), F.col("name"))
    found = found.select("file", F.col("name").alias("callee"), F.coalesce("id1", "id2", "id3", external).alias("dst"), F.when(F.col("id1").isNotNull(), 1).when(F.col("id2").isNotNull(), 2).when(F.col("id3").isNotNull(), 3).otherwise(4).alias("tier"))
    callers = own.select("file", F.col("name").alias("caller"), F.col("id").alias("src"))
    return pending.join(callers, ["file", "caller"]).join(found, ["file", "callee"]).groupBy("src", "dst", "line").agg(F.min("tier").alias("tier"))


def tested_by(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst): production symbol and the test that calls it, for calls (src, dst) from a test path to another."""
    end = lambda tag: symbols.select(F.col("id").alias(tag), F.col("file").alias(f"{tag}_file"), F.col("kind").alias(f"{tag}_kind"))
    rows = calls.select("src", "dst").distinct().join(end("src"), "src").join(end("dst"), "dst")
    rows = rows.where((F.col("dst_kind") != "external") & p.is_test_path(F.col("src_file")) & ~p.is_test_path(F.col("dst_file")))
    return rows.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def references(pending: DataFrame, symbols: DataFrame, scopes: DataFrame | None = None, deps: DataFrame | None = None) -> DataFrame:
    """(kind, src, dst, line, ref_kind) from pending references (file, enclosing, name, line, ref_kind).

    Without an enclosing symbol only type positions stand, as MODULE_TYPED from the file. With one, the target is the same
    file's or the nearest, self-references go, and one row stands for each (src, dst, line), of the least ref_kind.
    """
    own = first_in_file(symbols)
    uses = pending.select("file", "name").distinct().join(own.withColumnRenamed("id", "id1"), ["file", "name"], "left")
    near = proximal(uses.where("id1 is null"), symbols, scopes, deps).withColumnRenamed("id", "id3")
    targets = uses.join(near, ["file", "name"], "left").select("file", "name", F.coalesce("id1", "id3").alias("dst")).where("dst is not null")
    rows = pending.join(targets, ["file", "name"])
    module = rows.where("enclosing is null and ref_kind = 'type_position'").select(F.lit("MODULE_TYPED").alias("kind"), F.col("file").alias("src"), "dst", "line", "ref_kind")
    inner = rows.where("enclosing is not null").join(own.select("file", F.col("name").alias("enclosing"), F.col("id").alias("src")), ["file", "enclosing"]).where("src != dst")
    inner = inner.groupBy("src", "dst", "line").agg(F.min("ref_kind").alias("ref_kind")).select(F.lit("REFERENCES").alias("kind"), "src", "dst", "line", "ref_kind")
    return inner.unionByName(module)


def import_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, line, imported_names, re_export): one row for each pair of files, the first statement's."""
    best = resolved.groupBy("src", "dst").agg(F.min_by(F.struct("line", "imported_names", "re_export"), F.struct("line", "imported_names")).alias("b"))
    return best.select("src", "dst", "b.line", "b.imported_names", "b.re_export")


def named_imports(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, line, alias, is_type_only) from resolved imports with names [(local, original)]; alias '' if unchanged."""
    rows = resolved.select("src", F.col("dst").alias("file"), "line", "is_type_only", F.explode("names").alias("n"))
    rows = rows.withColumn("original", F.col("n.original")).join(first_in_file(symbols).select("file", F.col("name").alias("original"), "id"), ["file", "original"])
    alias = F.when(F.col("n.local") != F.col("original"), F.col("n.local")).otherwise("")
    return rows.where("src != file").select("src", F.col("id").alias("dst"), "line", alias.alias("alias"), "is_type_only").distinct()


def extends(pending: DataFrame, symbols: DataFrame, scopes: DataFrame | None = None, deps: DataFrame | None = None) -> DataFrame:
    """(kind, src, dst): EXTENDS, and IMPLEMENTS beside it where the base is an interface or trait, from (file, name, base).

    If pending says the `place` of each declaration, the rows have that of the first.
    """
    ordered = "place" in pending.columns
    pending = pending if ordered else pending.withColumn("place", F.lit(0))
    classes = symbols.where(F.col("kind").isin(*CLASS_LIKE))
    local = classes.groupBy("file", "name").agg(F.min(F.struct("seq", "id", "kind")).alias("at"))
    anywhere = classes.groupBy("name").agg(F.min(F.struct("seq", "id", "kind", "file")).alias("any"))
    rows = pending.join(local, ["file", "name"], "left").join(anywhere.select("name", F.col("any.id").alias("any_id")), "name", "left")
    rows = rows.select("file", F.coalesce("at.id", "any_id").alias("src"), "base", "place").where("src is not null")
    rows = rows.join(anywhere.select(F.col("name").alias("base"), F.col("any.id").alias("dst"), F.col("any.kind").alias("base_kind"), F.col("any.file").alias("target_file")), "base")
    rows = allowed(rows, scopes, deps).where("src != dst").groupBy("src", "dst", "base_kind").agg(F.min("place").alias("place"))
    kinds = F.when(F.col("base_kind").isin("interface", "trait"), F.array(F.lit("EXTENDS"), F.lit("IMPLEMENTS"))).otherwise(F.array(F.lit("EXTENDS")))
    return rows.select(F.explode(kinds).alias("kind"), "src", "dst", *(["place"] if ordered else []))


def contains(symbols: DataFrame) -> DataFrame:
    """(src, dst): class and member, from symbols with `enclosing`, the name of a class in the same file."""
    classes = first_in_file(symbols.where(F.col("kind").isin(*CLASS_LIKE))).select("file", F.col("name").alias("enclosing"), F.col("id").alias("src"))
    return symbols.select("file", "enclosing", F.col("id").alias("dst")).join(classes, ["file", "enclosing"]).where("src != dst").select("src", "dst").distinct()


def overrides(symbols: DataFrame, members: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, dst), (id)): override edges, and the override methods whose parent method isn't there.

    members is CONTAINS (src, dst), parents is EXTENDS (src, dst); only a class's first parent counts, by `place` if parents
    has one. A method that would override itself has no edge, and isn't among the unresolved.
    """
    first = parents.groupBy("src").agg(F.min_by("dst", F.struct("place", "dst") if "place" in parents.columns else F.col("dst")).alias("parent"))
    members = members.groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")
    mine = symbols.where("is_override").select("id", "name").join(members.select(F.col("src").alias("class"), F.col("dst").alias("id")), "id", "left").join(first.select(F.col("src").alias("class"), "parent"), "class", "left")
    theirs = members.join(symbols.select(F.col("id").alias("dst"), "name", "seq"), "dst").groupBy(F.col("src").alias("parent"), "name").agg(F.min_by("dst", "seq").alias("dst"))
    rows = mine.join(theirs, ["parent", "name"], "left")
    found = rows.where("dst is not null").select(F.col("id").alias("src"), "dst").distinct()
    return found.where("src != dst"), symbols.where("is_override").select("id").join(found.select(F.col("src").alias("id")), "id", "left_anti")


def decorates(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, decorator_args): decorator and decorated, from (file, symbol id, decorator, args).

    A dotted decorator is looked up whole in its file, then by its last part there, then by its last part anywhere, then
    whole anywhere.
    """
    own = first_in_file(symbols)
    anywhere = symbols.groupBy("name").agg(F.min_by("id", "seq").alias("id"))
    last = F.substring_index("decorator", ".", -1)
    rows = pending.withColumn("last", last)
    for i, (by, where) in enumerate((("decorator", own), ("last", own), ("last", anywhere), ("decorator", anywhere)), 1):
        keys = ["file", by] if "file" in where.columns else [by]
        rows = rows.join(where.withColumnsRenamed({"name": by, "id": f"d{i}"}), keys, "left")
    return rows.select(F.coalesce("d1", "d2", "d3", "d4").alias("src"), F.col("symbol").alias("dst"), F.col("args").alias("decorator_args")).where("src is not null and src != dst").distinct()


def probe_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(key, path): for each key the first of its ordered candidates (array) that is a file."""
    rows = wanted.select("key", F.posexplode("candidates").alias("place", "path")).join(files.select("path").distinct(), "path", "left_semi")
    return rows.groupBy("key").agg(F.min_by("path", "place").alias("path"))


def python_candidates(module):
    """Paths a dotted Python module can stand for."""
    base = F.replace(module, F.lit("."), F.lit("/"))
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))


def script_candidates(base):
    """Paths a relative TypeScript or JavaScript import can stand for."""
    ends = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    return F.array(base, *(F.concat(base, F.lit(e)) for e in ends))
