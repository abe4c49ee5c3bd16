"""What project files say about imports and scopes: rules from an import's prefix to a folder, project roots, dependencies.

A rule is one row whatever its origin (a Go module, a PSR-4 namespace, a package of a workspace, an alias of a compiler's
settings), so that resolution is one join by equality on an import's own prefixes, longest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from .text import manifest_deps, strip_json_comments

NAMES = ("package.json", "tsconfig.json", "jsconfig.json", "composer.json", "go.mod", "Cargo.toml")
RULE = ["lang", "scope", "prefix", "target"]


def _under(folder: Column, path: Column) -> Column:
    return p.clean_path(F.concat_ws("/", F.when(folder != "", folder), path))


def rules(texts: DataFrame) -> DataFrame:
    """(lang, scope, prefix, target) from texts (path, text) of project files: an import that starts with prefix, in a file
    under scope, is the rest of it under target. Prefixes have slashes and none at their end. Broken JSON gives no rule."""
    here, name = p.dirname(F.col("path")), p.basename(F.col("path"))
    rows = texts.where(F.coalesce(name.isin(*NAMES), F.lit(False))).select(here.alias("here"), name.alias("name"), F.col("text"), strip_json_comments(F.col("text")).alias("json"))
    tidy = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"/*\**$", "")

    go = rows.where("name = 'go.mod'").select(F.lit("go").alias("lang"), F.col("here").alias("scope"), F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("prefix"), F.col("here").alias("target")).where("prefix != ''")
    psr4 = F.explode(F.from_json(F.get_json_object("json", "$.autoload.psr-4"), "map<string, string>"))
    php = rows.where("name = 'composer.json'").select("here", psr4.alias("key", "value"))
    php = php.select("here", "key", F.explode(F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))).alias("value"))
    php = php.select(F.lit("php").alias("lang"), F.col("here").alias("scope"), tidy(F.col("key")).alias("prefix"), _under(F.col("here"), tidy(F.col("value"))).alias("target"))
    packages = rows.where("name = 'package.json'").select(F.lit("script").alias("lang"), F.lit("").alias("scope"), F.get_json_object("json", "$.name").alias("prefix"), F.col("here").alias("target")).where("prefix is not null")
    options = F.from_json(F.get_json_object("json", "$.compilerOptions.paths"), "map<string, array<string>>")
    aliases = rows.where("name in ('tsconfig.json', 'jsconfig.json')").select("here", F.coalesce(F.get_json_object("json", "$.compilerOptions.baseUrl"), F.lit("")).alias("base"), F.explode(options).alias("key", "values"))
    aliases = aliases.select("here", "base", "key", F.explode("values").alias("value"))
    aliases = aliases.select(F.lit("script").alias("lang"), F.col("here").alias("scope"), tidy(F.col("key")).alias("prefix"), _under(_under(F.col("here"), F.col("base")), tidy(F.col("value"))).alias("target"))
    return go.union(php).union(packages).union(aliases).where("prefix != ''").distinct()


def targets(imports: DataFrame, found: DataFrame) -> DataFrame:
    """(path, target, line, base) for imports (path, target, line, lang): what each may stand for by the rule of the longest
    prefix, the nearest scope first."""
    kind = F.when(F.col("lang").isin("typescript", "javascript"), "script").otherwise(F.col("lang"))
    parts = F.split(F.replace("target", F.lit("\\"), F.lit("/")), "/")
    each = imports.select("path", "target", "line", kind.alias("lang"), parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    each = each.withColumn("prefix", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/")).withColumn("rest", F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), "/"))
    rows = each.join(found.withColumnRenamed("target", "folder"), ["lang", "prefix"]).where((F.col("scope") == "") | F.col("path").startswith(F.concat("scope", F.lit("/"))))
    base = F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), F.when(F.col("rest") != "", F.col("rest")))
    best = rows.groupBy("path", "target", "line").agg(F.max(F.struct("k", F.length("scope").alias("near"))).alias("best"))
    rows = rows.withColumn("base", base).join(best, ["path", "target", "line"]).where((F.col("k") == F.col("best.k")) & (F.length("scope") == F.col("best.near")))
    return rows.select("path", "target", "line", "base").distinct()


def scopes(texts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((file, scope), (scope, dep)): each file's nearest project folder, and the folders of the projects it depends on."""
    from ..operators.resolve import scope_of

    name = p.basename(F.col("path"))
    json_name = F.get_json_object(strip_json_comments(F.col("text")), "$.name")
    own = F.when(name.isin("package.json", "composer.json"), json_name).when(name == "Cargo.toml", F.nullif(F.regexp_extract("text", r"(?s)(?:^|\n)\[package\][^\[]*?\nname\s*=\s*\"([^\"]+)\"", 1), F.lit(""))).when(name.endswith(".csproj"), F.regexp_replace(name, r"\.csproj$", ""))
    named = texts.select(p.dirname(F.col("path")).alias("root"), own.alias("name")).where("name is not null").distinct()
    deps = manifest_deps(texts).select(p.dirname(F.col("path")).alias("scope"), F.col("dep").alias("name")).join(named, "name").select("scope", F.col("root").alias("dep")).distinct()
    return scope_of(files.select(F.col("path").alias("file")), named.select("root").distinct()), deps
