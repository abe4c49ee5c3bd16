"""From a source tree to a graph: one extraction pass, then resolution joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import predicates as p
from .graph import EDGES, Graph, conform
from .operators import resolve
from .sources import manifests
from .sources.repo import extract
from .tables import written


def _by_rules(imports: DataFrame, have: DataFrame, rules: DataFrame) -> DataFrame:
    """(src, dst, line, names, aux) of imports that a project file's rule ties to a file."""
    rows = manifests.targets(imports.select("path", "target", "line", "lang"), rules).join(imports.select("path", "target", "line", "lang", "names", "aux"), ["path", "target", "line"])
    base = F.col("base")
    script = F.concat(resolve.script_candidates(base), resolve.script_candidates(F.concat_ws("/", F.when(base != "", base), F.lit("src/index"))))
    candidates = F.when(F.col("lang") == "php", F.array(F.concat(base, F.lit(".php")))).when(F.col("lang").isin("typescript", "javascript"), script)
    tried = rows.withColumn("candidates", candidates).where("candidates is not null").withColumn("key", F.struct("path", "target", "line", "base"))
    plain = tried.join(resolve.probe_paths(tried.select("key", "candidates").distinct(), have).withColumnRenamed("path", "dst"), "key")
    # A Go import names a folder; its least file that is no test stands for it.
    folders = have.where(F.col("path").endswith(".go") & ~p.is_test_path(F.col("path"))).groupBy(p.dirname(F.col("path")).alias("base")).agg(F.min("path").alias("dst"))
    go = rows.where("lang = 'go'").join(folders, "base")
    return plain.select(F.col("path").alias("src"), "dst", "line", "names", "aux").union(go.select(F.col("path").alias("src"), "dst", "line", "names", "aux"))


def build(files: DataFrame, projects: DataFrame | None = None) -> Graph:
    """The graph of source files (path, lang, text); projects (path, text) are project files such as go.mod or package.json.

    Project files say what aliases, packages, namespaces and module paths in imports stand for, and which projects may use
    which: with them a name is looked up only in the file's own project and its direct dependencies. The extracted rows are written once, since each kind of edge reads them. Symbols stand in the order of path and place;
    that order settles all ties.
    """
    rows = written(extract(files))
    seq = F.struct(F.col("path"), F.col("seq"))
    symbols = rows.where("row = 'symbol'").select(
        F.concat(F.col("path"), F.lit("::"), F.col("name"), F.lit(":"), F.col("line").cast("string")).alias("id"), "name", F.col("path").alias("file"), "kind", "line", "line_end",
        F.concat_ws("::", "path", "enclosing", "name").alias("qualified_name"), "return_type", "arity", "is_async", "is_override", "params", "modifiers", "enclosing", seq.alias("seq"),
    )
    symbols = symbols.dropDuplicates(["id"])
    have = files.select("path").distinct()
    module = F.col("target")
    here = p.dirname(F.col("path"))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    up = F.array_join(F.slice(F.split(here, "/"), 1, F.greatest(F.size(F.split(here, "/")) - dots + 1, F.lit(0))), "/")
    rest = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.concat_ws("/", F.when(up != "", up), F.when(rest != "", rest))
    python = F.when(dots > 0, F.array(F.concat(relative, F.lit(".py")), F.concat(relative, F.lit("/__init__.py")))).otherwise(resolve.python_candidates(module))
    script = resolve.script_candidates(p.clean_path(F.concat_ws("/", F.when(here != "", here), module)))
    ruby = F.array(F.concat(p.clean_path(F.concat_ws("/", F.when(here != "", here), module)), F.lit(".rb")), F.concat(F.lit("lib/"), module, F.lit(".rb")))
    php = F.array(F.concat(F.replace(module, F.lit("\\"), F.lit("/")), F.lit(".php")), F.concat(F.lit("src/"), F.replace(module, F.lit("\\"), F.lit("/")), F.lit(".php")))
    lang = F.col("lang")
    candidates = F.when(lang == "python", python).when(lang.isin("typescript", "javascript") & module.startswith("."), script).when(lang == "ruby", ruby).when(lang == "php", php)
    imports = rows.where("row = 'import'").select("path", "line", "names", "aux", F.struct("path", "target", "line").alias("key"), candidates.alias("candidates"))
    resolved = imports.where("candidates is not null").join(resolve.probe_paths(imports.where("candidates is not null").select("key", "candidates").distinct(), have).withColumnRenamed("path", "dst"), "key").select(F.col("path").alias("src"), "dst", "line", "names", "aux")
    if projects is not None:
        resolved = resolved.union(_by_rules(rows.where("row = 'import'"), have, manifests.rules(projects)))
    # Ruby also looks below every lib folder.
    below = have.select(F.regexp_extract("path", r"(?:^|/)lib/(.+)\.rb$", 1).alias("target"), F.col("path").alias("dst")).where("target != ''").groupBy("target").agg(F.min("dst").alias("dst"))
    gems = rows.where("row = 'import' and lang = 'ruby'").join(below, "target").select(F.col("path").alias("src"), "dst", "line", "names", "aux")
    resolved = resolved.union(gems.join(resolved.select("src", "line"), ["src", "line"], "left_anti").select("src", "dst", "line", "names", "aux")).where("src != dst")
    resolved = written(resolved.withColumn("imported_names", F.transform("names", lambda n: n["original"])).withColumn("re_export", F.col("aux") == "re_export").withColumn("is_type_only", F.col("aux") == "type"))

    pending = lambda kind: rows.where(F.col("row") == kind)
    scopes, deps = manifests.scopes(projects, files) if projects is not None else (None, None)
    imap = resolve.import_map(resolved.select(F.col("src").alias("file"), F.col("dst").alias("target_file"), "names", "line"))
    calls = written(resolve.resolve_calls(pending("call").select(F.col("path").alias("file"), F.col("enclosing").alias("caller"), F.col("name").alias("callee"), "line"), symbols, imap, scopes, deps))
    external = calls.where("tier = 4").select(F.col("dst").alias("id")).distinct().select("id", F.substring_index("id", "::", -1).alias("name"), F.lit("<external>").alias("file"), F.lit("external").alias("kind"), F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("line_end"))
    refs = resolve.references(pending("ref").select(F.col("path").alias("file"), "enclosing", "name", "line", F.col("aux").alias("ref_kind")), symbols, scopes, deps)
    bases = resolve.extends(pending("extends").select(F.col("path").alias("file"), "name", F.col("target").alias("base"), F.struct("path", F.col("seq").cast("long")).alias("place")), symbols, scopes, deps)
    bases = written(bases)
    members = resolve.contains(symbols)
    over, unresolved = resolve.overrides(symbols, members, bases.where("kind = 'EXTENDS'"))
    own = resolve.first_in_file(symbols)
    marks = pending("decorator").select(F.col("path").alias("file"), "name", F.col("target").alias("decorator"), F.col("aux").alias("args")).join(own, ["file", "name"]).select("file", F.col("id").alias("symbol"), "decorator", "args")
    every = symbols.unionByName(external, allowMissingColumns=True)
    symbols = symbols.join(unresolved.withColumn("has_unresolved_override", F.lit(True)), "id", "left").fillna(False, ["has_unresolved_override"])

    def edges(kind: str, df: DataFrame) -> DataFrame:
        return conform(df.withColumn("kind", F.lit(kind)), EDGES)

    out = [
        edges("DEFINES", symbols.select(F.col("file").alias("src"), F.col("id").alias("dst"))), edges("CONTAINS", members), edges("CALLS", calls), edges("CALLS_HEURISTIC", calls.where("tier = 3")),
        conform(refs, EDGES), edges("IMPORTS", resolve.import_edges(resolved)), edges("IMPORTS_NAMED", resolve.named_imports(resolved, symbols)), conform(bases, EDGES), edges("OVERRIDES", over),
        edges("DECORATES", resolve.decorates(marks, symbols)), edges("TESTED_BY", resolve.tested_by(calls, every)),
    ]
    total = out[0]
    for e in out[1:]:
        total = total.unionByName(e)
    facts = files.select("path", "lang", F.octet_length("text").cast("long").alias("size"), F.unhex(F.sha2("text", 256)).alias("sha256"), F.regexp_count("text", F.lit("\n")).cast("long").alias("loc"), p.is_generated(F.col("path")).alias("is_generated"), p.is_vendored(F.col("path")).alias("is_vendored"))
    return Graph.of(facts, symbols.drop("enclosing", "seq").unionByName(external, allowMissingColumns=True).fillna({"arity": -1, "return_type": "", "qualified_name": ""}), written(total))
