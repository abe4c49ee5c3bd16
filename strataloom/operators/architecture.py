"""Modules: which owns a file, how many symbols each has, how strongly they depend on each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..graph import Graph

# File names that mark a module's root, and the convention each stands for.
MARKERS = {
    "Cargo.toml": "cargo", "package.json": "npm", "go.mod": "go", "pyproject.toml": "python", "__init__.py": "python-package",
    "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "composer.json": "composer",
}


def discover(paths: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """(root, conventions): directories with a marker file (or a .csproj), less those under an excluded prefix."""
    name = p.basename(F.col("path"))
    mark = F.when(name.endswith(".csproj"), "csproj")
    for file, convention in MARKERS.items():
        mark = F.when(name == file, convention).otherwise(mark)
    rows = paths.withColumn("convention", mark).where("convention is not null").select(p.dirname(F.col("path")).alias("root"), "convention")
    for x in excluded:
        rows = rows.where(~((F.col("root") == x) | F.col("root").startswith(x.rstrip("/") + "/")))
    return rows.groupBy("root").agg(F.array_join(F.sort_array(F.collect_set("convention")), ",").alias("conventions"))


def owners(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the longest root that is the path itself or a directory above it; '' owns all, null if none does.

    Each path meets its own prefixes by equality, as many as it has segments, and the longest stays.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = paths.select("path").distinct().select("path", F.explode(prefixes).alias("root")).join(roots.select("root").distinct(), "root")
    best = rows.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").distinct().join(best, "path", "left")


def names(roots: DataFrame) -> DataFrame:
    """(root, module): the last segment, (root) for '', the full root where last segments collide."""
    base = F.when(F.col("root") == "", "(root)").otherwise(p.basename(F.col("root")))
    rows = roots.select("root").distinct().withColumn("base", base)
    shared = rows.groupBy("base").agg(F.count("*").alias("n"))
    return rows.join(shared, "base").select("root", F.when((F.col("n") > 1) & (F.col("root") != ""), F.col("root")).otherwise(F.col("base")).alias("module"))


def modules(g: Graph, roots: DataFrame, max_modules: int | None = None) -> DataFrame:
    """(module, root, files, symbol_count), by name, or the max_modules with most symbols. A module without files stays."""
    own = owners(g.files.select("path"), roots)
    counts = own.join(g.internal().groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n")), "path", "left")
    counts = counts.groupBy("root").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbol_count"))
    rows = names(roots).join(counts, "root", "left").fillna(0, ["files", "symbol_count"]).select("module", "root", "files", "symbol_count")
    return rows.orderBy("module") if max_modules is None else rows.orderBy(F.desc("symbol_count"), "module").limit(max_modules)


def edges(g: Graph, roots: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(from_module, to_module, kind, weight) between different modules; with `kept` (module), between those only.

    Calls and references weigh one each, extends too; imports weigh their distinct file pairs. Symbol edges are added up by
    pair of files before files become modules.
    """
    kind = F.when(F.col("kind") == "EXTENDS", "extends").otherwise("calls")
    file_of = lambda end: g.symbols.select(F.col("id").alias(end), F.col("file").alias(f"{end}_file"))
    by_symbol = g.kind("CALLS", "REFERENCES", "EXTENDS").join(file_of("src"), "src").join(file_of("dst"), "dst")
    by_file = by_symbol.groupBy("src_file", "dst_file", kind.alias("edge")).agg(F.count("*").alias("n"))
    named = g.kind("IMPORTS_NAMED").join(file_of("dst"), "dst").select(F.col("src").alias("src_file"), "dst_file")
    imports = g.kind("IMPORTS").select(F.col("src").alias("src_file"), F.col("dst").alias("dst_file")).union(named).distinct()
    every = by_file.unionByName(imports.select("src_file", "dst_file", F.lit("imports").alias("edge"), F.lit(1).cast("long").alias("n")))
    own = owners(g.files.select("path"), roots).join(names(roots), "root").select("path", "module")
    rows = every.join(own.withColumnsRenamed({"path": "src_file", "module": "from_module"}), "src_file").join(own.withColumnsRenamed({"path": "dst_file", "module": "to_module"}), "dst_file")
    rows = rows.where("from_module != to_module").groupBy("from_module", "to_module", F.col("edge").alias("kind")).agg(F.sum("n").alias("weight"))
    if kept is not None:
        rows = rows.join(kept.select(F.col("module").alias("from_module")), "from_module", "left_semi").join(kept.select(F.col("module").alias("to_module")), "to_module", "left_semi")
    return rows.select("from_module", "to_module", "kind", "weight")


def public_api(texts: DataFrame, most: int = 10) -> DataFrame:
    """(path, names): the names of a one-line __all__, at most `most`."""
    body = F.regexp_extract("text", r"(?m)^__all__\s*=\s*[\[(]([^\n\])]*)[\])]", 1)
    found = F.regexp_extract_all(body, F.lit(r"""["']([A-Za-z0-9_]+)["']"""), F.lit(1))
    return texts.select("path", F.slice(found, 1, most).alias("names")).where(F.size("names") > 0)
