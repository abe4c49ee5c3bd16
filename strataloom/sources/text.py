"""Relations out of text: lines, diffs, routes, configuration mentions, links, commits of a git log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p


def file_lines(texts: DataFrame) -> DataFrame:
    """(path, line_no, text): the lines of (path, text), from 1."""
    return texts.select("path", F.posexplode(p.lines(F.col("text"))).alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text")


def diff_paths(diffs: DataFrame) -> DataFrame:
    """(key, place, path): the distinct paths that unified diffs (key, diff) name, in the order of their first header.

    Headers are lines of --- or +++; a/ or b/, what follows a tab, and /dev/null go.
    """
    rows = diffs.select("key", F.posexplode(p.lines(F.col("diff"))).alias("place", "line")).where(F.col("line").rlike(r"^(---|\+\+\+) "))
    path = F.trim(F.substring_index(F.substring(F.col("line"), 5, 1 << 20), "\t", 1))
    path = F.when(path.startswith("a/") | path.startswith("b/"), F.substring(path, 3, 1 << 20)).otherwise(path)
    rows = rows.select("key", "place", path.alias("path")).where("path != '' and path != '/dev/null'")
    return rows.groupBy("key", "path").agg(F.min("place").alias("place")).select("key", "place", "path")


# The shapes of route definitions by file extension. Groups: method, path, handler.
_QUOTED = r"""["']([^"']*)["']"""
ROUTES = {
    "go": r"\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\(\s*" + _QUOTED + r"\s*,.*?([A-Za-z_][A-Za-z0-9_]*)\s*\)?\s*$",
    "py": r"()path\(\s*r?" + _QUOTED + r"\s*,\s*(?:[A-Za-z_][A-Za-z0-9_]*\.)*([A-Za-z_][A-Za-z0-9_]*)",
    "rb": r"^\s*(get|post|put|patch|delete|head|options)\s+" + _QUOTED + r"""\s*=>\s*["'](?:[^"'#]*#)?([^"']*)["']""",
    "rs": r"\.route\(\s*()" + _QUOTED + r"\s*,\s*(?:get|post|put|delete|patch|head|options)\(\s*([A-Za-z_][A-Za-z0-9_]*)",
}
_RUST_VERB = r"\.route\(\s*[\"'][^\"']*[\"']\s*,\s*(get|post|put|delete|patch|head|options)\("
_NEST = r"^\s*@(Get|Post|Put|Delete|Patch|Head|Options)\(\s*(?:" + _QUOTED + r")?"
_NEST_METHOD = r"^\s*(?:(?:public|private|protected|async|static)\s+)*([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
_NEST_NOT = ["if", "for", "while", "switch", "return", "constructor"]


def routes(texts: DataFrame, handler: str | None = None) -> DataFrame:
    """(path, method, route, handler): routes in web frameworks' files, of one handler or all, each once for a file."""
    lines = file_lines(texts).withColumn("ext", p.extension(F.col("path")))
    found = None
    for ext, pattern in ROUTES.items():
        rows = lines.where((F.col("ext") == ext) & F.col("text").rlike(pattern))
        verb = {"py": F.lit("ANY"), "rs": F.upper(F.regexp_extract("text", _RUST_VERB, 1))}.get(ext, F.upper(F.regexp_extract("text", pattern, 1)))
        rows = rows.select("path", verb.alias("method"), F.regexp_extract("text", pattern, 2).alias("route"), F.regexp_extract("text", pattern, 3).alias("handler"))
        found = rows if found is None else found.union(rows)
    found = found.union(_nest(texts.where(p.extension(F.col("path")).isin("ts", "tsx")))).distinct()
    return found if handler is None else found.where(F.col("handler") == handler)


def _nest(texts: DataFrame) -> DataFrame:
    """Decorated controller methods: the first method name in the 8 lines after the decorator, under the controller's prefix."""
    prefix = F.regexp_extract("text", r"(?m)^\s*@Controller\(\s*" + _QUOTED, 1)
    rows = texts.select("path", prefix.alias("prefix"), p.lines(F.col("text")).alias("lines"))
    rows = rows.select("path", "prefix", "lines", F.posexplode("lines").alias("i", "text")).where(F.col("text").rlike(_NEST))
    after = F.transform(F.slice("lines", F.col("i") + 2, 8), lambda x: F.when(~F.regexp_extract(x, _NEST_METHOD, 1).isin(*_NEST_NOT), F.regexp_extract(x, _NEST_METHOD, 1)).otherwise(""))
    handler = F.coalesce(F.get(F.filter(after, lambda x: x != ""), F.lit(0)), F.lit(""))
    parts = F.filter(F.flatten(F.array(F.split("prefix", "/"), F.split(F.regexp_extract("text", _NEST, 2), "/"))), lambda x: x != "")
    return rows.select("path", F.upper(F.regexp_extract("text", _NEST, 1)).alias("method"), F.concat(F.lit("/"), F.array_join(parts, "/")).alias("route"), handler.alias("handler")).where("handler != ''")


def config_mentions(texts: DataFrame, symbol: str, stems: list[str] = ()) -> DataFrame:
    """(path, line_no, text): lines of configuration files that have the symbol or one of the stems as a whole word."""
    lines = file_lines(texts.where(p.is_config(F.col("path"))))
    hit = p.has_token(F.col("text"), symbol)
    for s in stems:
        hit = hit | p.has_token(F.col("text"), s)
    return lines.where(hit).select("path", "line_no", F.trim("text").alias("text"))


def grep_files(texts: DataFrame, pattern: str) -> DataFrame:
    """(path): files with a line that matches."""
    return texts.where(F.col("text").rlike("(?m)" + pattern)).select("path").distinct()


def git_log(logs: DataFrame) -> DataFrame:
    """(sha, ts, subject, is_merge, path) from `git log --name-only --format='commit %H %ct %P%x09%s'` texts (key, log)."""
    chunk = F.filter(F.split("log", r"(?m)^commit (?=[0-9a-f]{7,64} [0-9]+)"), lambda x: x != "")
    rows = logs.select(F.explode(chunk).alias("c"))
    head = r"^([0-9a-f]+) ([0-9]+) ?([0-9a-f ]*)\t([^\n]*)"
    names = F.filter(F.split(F.regexp_replace("c", r"^[^\n]*\n?", ""), "\n"), lambda x: F.trim(x) != "")
    return rows.select(
        F.regexp_extract("c", head, 1).alias("sha"), F.timestamp_seconds(F.regexp_extract("c", head, 2).cast("long")).alias("ts"), F.regexp_extract("c", head, 4).alias("subject"),
        (F.size(F.filter(F.split(F.regexp_extract("c", head, 3), " "), lambda x: x != "")) > 1).alias("is_merge"), F.explode(names).alias("path"),
    )


def strip_json_comments(text: Column) -> Column:
    """JSON without // and /* */ comments outside strings, and without commas before a closing bracket."""
    kept = F.regexp_replace(text, r"""("(?:[^"\\]|\\.)*")|//[^\n]*|(?s:/\*.*?\*/)""", "$1")
    return F.regexp_replace(kept, r""",(\s*[}\]])""", "$1")


def manifest_deps(texts: DataFrame) -> DataFrame:
    """(path, dep): dependency names in package.json, composer.json, Cargo.toml and .csproj texts (path, text)."""
    name = p.basename(F.col("path"))
    plain = strip_json_comments(F.col("text"))
    json_deps = F.map_keys(F.from_json(F.when(name == "composer.json", F.get_json_object(plain, "$.require")).otherwise(F.get_json_object(plain, "$.dependencies")), "map<string, string>"))
    section = F.regexp_extract("text", r"(?s)(?:^|\n)\[dependencies\]\s*\n(.*?)(?=\n\[|\z)", 1)
    toml = F.regexp_extract_all(section, F.lit(r"(?m)^\s*([A-Za-z0-9_-]+)\s*="), F.lit(1))
    projects = F.transform(F.regexp_extract_all("text", F.lit(r'<ProjectReference\s+Include="([^"]+)"'), F.lit(1)), lambda x: F.regexp_replace(p.basename(F.replace(x, F.lit("\\"), F.lit("/"))), r"\.csproj$", ""))
    deps = F.when(name.isin("package.json", "composer.json"), json_deps).when(name == "Cargo.toml", toml).when(name.endswith(".csproj"), projects)
    return texts.select("path", F.explode(deps).alias("dep"))


def entry_facts(texts: DataFrame) -> dict[str, DataFrame]:
    """What dead_code() takes as entries, from source and manifest texts (path, text): handlers, scripts, exported, c_libraries."""
    name = p.basename(F.col("path"))
    section = F.regexp_extract("text", r"(?s)(?:^|\n)\[project\.scripts\]\s*\n(.*?)(?=\n\[|\z)", 1)
    calls = F.regexp_extract_all(section, F.lit(r"""(?m)^[^=\n]+=\s*["'][^"':]+:([A-Za-z_][A-Za-z0-9_]*)["']"""), F.lit(1))
    scripts = texts.where(name == "pyproject.toml").select(F.explode(calls).alias("name")).distinct()
    body = F.regexp_extract("text", r"(?m)^__all__\s*(?:\+?=)\s*[\[(]([^\])]*)[\])]", 1)
    listed = F.regexp_extract_all(body, F.lit(r"""["']([A-Za-z0-9_]+)["']"""), F.lit(1))
    exported = texts.where(F.col("path").endswith(".py")).select(F.col("path").alias("file"), F.explode(listed).alias("name"))
    to_c = texts.where((name == "Cargo.toml") & F.col("text").rlike(r"""(?s)crate-type\s*=\s*\[[^\]]*["'](cdylib|staticlib)["']"""))
    return {"handlers": routes(texts).select(F.col("handler").alias("name")).distinct(), "scripts": scripts, "exported": exported, "c_libraries": to_c.select(p.dirname(F.col("path")).alias("dir"))}
