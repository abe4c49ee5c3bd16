"""What a change reaches: bounded search, explanation, tests, break points, risk, merging of several seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidParams
from ..functions import predicates as p
from ..graph import Graph
from ..tables import written

MOST_VISITED = 500
SECTION_CAP = 50
BLAST = 20.0
LEAST_COMMON = 2


def validate(symbol: str | None, changed_files: list[str] | None, diff: str | None) -> None:
    if not (symbol or changed_files or diff):
        raise InvalidParams("one of symbol, changed_files and diff is needed")


def reach(g: Graph, seeds: DataFrame, max_depth: int = 3, most_visited: int | None = MOST_VISITED) -> DataFrame:
    """(seed, name, depth, reason): names within max_depth of each seed name (seeds has a column `seed`), either way.

    reason is how the name was reached: seed, caller or callee; at one depth a caller wins. most_visited bounds the names
    kept for each seed, nearest first, then callers, then by name; None keeps all. Every step is a join of the frontier
    with the name pairs and an anti-join with what was seen; frontiers are written, and only max_depth, a small number, drives
    the loop.
    """
    rows = g.ends("CALLS", "REFERENCES").where((F.col("src_kind") != "external") & (F.col("dst_kind") != "external"))
    pairs = rows.select(F.col("src_name").alias("a"), F.col("dst_name").alias("b")).distinct()
    ways = pairs.select(F.col("b").alias("at"), F.col("a").alias("name"), F.lit("caller").alias("reason")).union(pairs.select(F.col("a").alias("at"), F.col("b").alias("name"), F.lit("callee").alias("reason")))
    ways = written(ways) if max_depth > 1 else ways
    seen = seeds.select("seed", F.col("seed").alias("name"), F.lit(0).alias("depth"), F.lit("seed").alias("reason")).distinct()
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.select("seed", F.col("name").alias("at")).join(ways, "at").groupBy("seed", "name").agg(F.max("reason").alias("has"), F.min("reason").alias("least"))
        step = step.select("seed", "name", F.lit(depth).alias("depth"), F.when(F.col("has") == "caller", "caller").otherwise(F.col("least")).alias("reason"))
        front = step.join(seen.select("seed", "name"), ["seed", "name"], "left_anti")
        front = written(front) if depth < max_depth else front
        seen = seen.unionByName(front)
    if most_visited is None:
        return seen
    order = Window.partitionBy("seed").orderBy("depth", F.when(F.col("reason") == "callee", 1).otherwise(0), "name")
    return seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_visited).drop("rank")


def impacted_files(g: Graph, reached: DataFrame) -> DataFrame:
    """(seed, path, depth, reason): the files that define reached names, each at its least depth."""
    rows = reached.join(g.internal().select("name", "file"), "name")
    first = F.min(F.struct("depth", F.when(F.col("reason") == "seed", 0).when(F.col("reason") == "caller", 1).otherwise(2).alias("o"), "reason"))
    best = rows.groupBy("seed", F.col("file").alias("path")).agg(first.alias("b"))
    return best.select("seed", "path", F.col("b.depth").alias("depth"), F.col("b.reason").alias("reason"))


def text_filter(files: DataFrame, reached: DataFrame, texts: DataFrame) -> DataFrame:
    """The impacted files at depth 0, and those whose text has a reached name as a whole identifier.

    texts (path, text) is split into identifiers, which meet the names by equality instead of a search for each name.
    """
    words = texts.select("path", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_]+"))).alias("name")).where("name != ''")
    hits = words.join(reached.select("seed", "name").distinct(), "name").select("seed", "path").distinct()
    near = files.where("depth > 0").join(hits, ["seed", "path"], "left_semi")
    return files.where("depth = 0").unionByName(near)


def guessed_only(g: Graph) -> DataFrame:
    """(seed, path, reason): files tied to a seed name by guessed calls alone."""
    rows = g.ends("CALLS", "CALLS_HEURISTIC", "REFERENCES")
    sides = []
    for seed, other, reason in (("dst", "src", "caller"), ("src", "dst", "callee")):
        r = rows.where(F.col(f"{other}_kind") != "external").groupBy(F.col(f"{seed}_name").alias("seed"), F.col(f"{other}_file").alias("path"))
        r = r.agg(*(F.count_if(F.col("edge") == k).alias(k) for k in ("CALLS", "CALLS_HEURISTIC", "REFERENCES")))
        sides.append(r.where("CALLS_HEURISTIC > 0 and CALLS <= CALLS_HEURISTIC and REFERENCES = 0").select("seed", "path", F.lit(reason).alias("reason")))
    return sides[0].union(sides[1])


def explain(g: Graph, files: DataFrame, file_hint: str | None = None) -> DataFrame:
    """files with `relation` and `confidence` to the seed.

    The labels of callers and callees at depth 1 read the wrong way round; they are part of the surface and stay.
    """
    defs = g.internal().groupBy(F.col("name").alias("seed")).agg(F.count("*").alias("defs"))
    rows = files.join(defs, "seed", "left").fillna(0, ["defs"])
    rows = rows.join(guessed_only(g).withColumn("guessed", F.lit(True)), ["seed", "path", "reason"], "left").fillna(False, ["guessed"])
    one = (F.col("depth") == 1) & F.col("reason").isin("caller", "callee")
    other = F.lit(False) if file_hint is None else one & (p.language(F.lit(file_hint)) != p.language(F.col("path")))
    hinted = F.lit(False) if file_hint is None else F.col("path") == file_hint
    cases = [
        (F.coalesce(other, F.lit(False)), "shares_function_name", 0.5),
        ((F.col("reason") == "seed") & ((F.col("defs") <= 1) | hinted | (F.col("depth") > 0)), "changed_directly", 1.0),
        (F.col("reason") == "seed", "shares_function_name", 0.6),
        (one & F.col("guessed") & (F.col("defs") > 1), "name_guess", 0.6),
        (one & (F.col("reason") == "caller"), "called_by_seed_directly", 1.0),
        (one & (F.col("reason") == "callee"), "calls_seed_directly", 1.0),
        ((F.col("depth") == 2) & (F.col("reason") == "callee"), "sibling_in_same_class", 0.7),
        (F.col("reason") == "co_change", "co_changes_with_seed", 0.5),
    ]
    relation, confidence = F.lit("shared_dependency"), F.lit(0.4)
    for test, label, weight in reversed(cases):
        relation, confidence = F.when(test, label).otherwise(relation), F.when(test, weight).otherwise(confidence)
    return rows.select("seed", "path", "depth", "reason", relation.alias("relation"), confidence.alias("confidence"))


def siblings(g: Graph, seeds: DataFrame) -> DataFrame:
    """(seed, path, depth, reason): files that methods of the seed's own class call; at depth 2, as callees."""
    of = g.kind("CONTAINS").select(F.col("src").alias("class"), F.col("dst").alias("id"))
    own = seeds.select("seed").distinct().join(g.internal().select(F.col("name").alias("seed"), "id"), "seed")
    classes = own.join(of, "id").select("seed", "class").distinct()
    others = classes.join(of, "class").select("seed", F.col("id").alias("src")).distinct()
    called = others.join(g.kind("CALLS").select("src", "dst").distinct(), "src").select("seed", F.col("dst").alias("id")).distinct()
    return called.join(g.internal().select("id", F.col("file").alias("path")), "id").select("seed", "path").distinct().withColumn("depth", F.lit(2)).withColumn("reason", F.lit("callee"))


def with_siblings(g: Graph, files: DataFrame, seeds: DataFrame) -> DataFrame:
    """files with those that only siblings reach."""
    more = siblings(g, seeds).join(files.select("seed", "path"), ["seed", "path"], "left_anti")
    return files.select("seed", "path", "depth", "reason").unionByName(more)


def _mirrors(path: Column) -> Column:
    """The test folder of the same package, for a path below src/main/java or src/main/kotlin."""
    return F.regexp_replace(F.regexp_extract(path, r"^((?:.*?/)?src/main/(?:java|kotlin)/.+)/[^/]*$", 1), r"^((?:.*?/)?)src/main/", "$1src/test/")


def _mentions(tests: DataFrame, words: DataFrame) -> DataFrame:
    """(seed, path): test paths that contain a word of (seed, word).

    The parts of a path that are as long as some word meet the words by equality. Lengths are few: names and stems.
    """
    lengths = [r.n for r in words.select(F.length("word").alias("n")).distinct().collect()]

    def parts_of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length("path") - n + 1), lambda i: F.substring("path", i, F.lit(n)))
        return F.when(F.length("path") >= n, cut).otherwise(F.array().cast("array<string>"))

    parts = F.concat(*map(parts_of, lengths)) if lengths else None
    if parts is None:
        return words.select("seed", F.lit("").alias("path")).limit(0)
    return tests.select("path", F.explode(F.array_distinct(parts)).alias("word")).join(words, "word").select("seed", "path").distinct()


def affected_tests(g: Graph, seeds: DataFrame, depth: int = 3, commits: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(seed, path, reason) of test files tied to each seed name; of two reasons `edge` wins over `convention`.

    By edge: tests of what the seed's calls reach within depth hops, and the seed's own file if it is a test. By convention:
    test files that import the seed's file, whose path has the seed's name or its file's stem in it, that lie in the mirrored
    test folder of a JVM package, or that changed in two or more commits with the seed's file (commits). Only where nothing
    else is found: test files whose text has the seed as a word (texts).
    """
    calls = written(g.kind("CALLS").select(F.col("src").alias("id"), "dst").distinct())
    at = written(seeds.select("seed").distinct().join(g.internal().select(F.col("name").alias("seed"), "id"), "seed"))
    # Ids within so many hops of any seed, then the test files of each, carried back hop by hop: no pairs of seeds and ids.
    near = [at.select("id").distinct()]
    for _ in range(depth):
        near.append(written(near[-1].union(calls.join(near[-1], "id", "left_semi").select(F.col("dst").alias("id"))).distinct()))
    tested = g.kind("TESTED_BY").select(F.col("src").alias("id"), F.col("dst").alias("test")).join(g.symbols.select(F.col("id").alias("test"), F.col("file").alias("path")), "test")
    tested = written(tested.select("id", "path").distinct().join(near[-1], "id", "left_semi"))
    found = tested
    for ids in reversed(near[:-1]):
        back = calls.join(ids, "id", "left_semi").join(found.withColumnRenamed("id", "dst"), "dst").select("id", "path")
        found = written(back.union(tested.join(ids, "id", "left_semi")).distinct())
    edge = at.join(found, "id").select("seed", "path").distinct()
    own = seeds.select("seed").distinct().join(g.internal().select(F.col("name").alias("seed"), F.col("file").alias("path")), "seed").distinct()
    edge = edge.union(own.where(p.is_test_path(F.col("path")))).distinct().withColumn("reason", F.lit("edge"))
    tests = g.files.where(p.is_test_path(F.col("path"))).select("path").distinct()
    home = own.withColumnRenamed("path", "dst")
    said = g.kind("IMPORTS").select(F.col("src").alias("path"), "dst").join(home, "dst").join(tests, "path", "left_semi").select("seed", "path")
    words = own.select("seed", F.explode(F.array("seed", p.stem(F.col("path")))).alias("word")).where("word != ''").distinct()
    said = said.union(_mentions(tests, words))
    mirrored = own.select("seed", _mirrors(F.col("path")).alias("folder")).where("folder != ''").distinct()
    above = tests.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))).alias("folder"))
    said = said.union(above.join(mirrored, "folder").select("seed", "path"))
    if commits is not None:
        from .history import co_change

        pairs = co_change(commits).where(F.col("commits") >= LEAST_COMMON).select(F.col("target").alias("dst"), "path")
        said = said.union(pairs.join(home, "dst").where(p.is_test_path(F.col("path"))).select("seed", "path"))
    rows = edge.union(said.distinct().withColumn("reason", F.lit("convention"))).groupBy("seed", "path").agg(F.max("reason").alias("reason"))
    if texts is None:
        return rows
    rows = written(rows)
    bare = seeds.select("seed").distinct().join(rows.select("seed"), "seed", "left_anti")
    tokens = texts.join(tests, "path", "left_semi").select("path", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_]+"))).alias("seed"))
    return rows.union(tokens.join(bare, "seed").select("seed", "path", F.lit("convention").alias("reason")))


def capped(rows: DataFrame, order: list, cap: int = SECTION_CAP, by: str = "seed") -> DataFrame:
    """The first `cap` rows of each seed in a section's order, with total_available and truncated."""
    total = Window.partitionBy(by)
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).withColumn("total_available", F.count("*").over(total))
    return ranked.where(F.col("place") <= cap).withColumn("truncated", F.col("total_available") > cap).drop("place")


def impact_risk(tests: Column, breaks: Column, files: Column, completeness: Column, max_depth: Column, routes: Column, configs: Column) -> Column:
    """The impact response's risk, from its sections' sizes: 0.4 test gap, 0.3 blast, 0.15 depth, 0.15 exposure."""
    gap = F.when(breaks == 0, 0.0).otherwise(F.greatest(F.least(1 - tests / breaks, F.lit(1.0)), F.lit(0.0)))
    depth = F.when(max_depth == 0, 0.0).otherwise(F.least(completeness / max_depth, F.lit(1.0)))
    exposure = F.when(routes > 0, 0.5).otherwise(0.0) + F.when(configs > 0, 0.5).otherwise(0.0)
    return F.least(0.4 * gap + 0.3 * F.least(files / BLAST, F.lit(1.0)) + 0.15 * depth + 0.15 * exposure, F.lit(1.0))


def risk_reasons(gap: Column, blast: Column, depth: Column, exposure: Column) -> Column:
    """Up to three reasons whose weighted part is 0.05 or more, the weightiest first."""
    parts = F.array(*(F.struct((-w * c).alias("part"), F.lit(i).alias("i"), F.lit(r).alias("reason")) for i, (w, c, r) in enumerate((
        (0.4, gap, "low test coverage"), (0.3, blast, "large blast radius"), (0.15, depth, "deep transitive propagation"), (0.15, exposure, "public API or config exposure")))))
    return F.transform(F.slice(F.sort_array(F.filter(parts, lambda x: x["part"] <= -0.05)), 1, 3), lambda x: x["reason"])


def risk_score(tests: Column, breaks: Column, files: Column, commits: Column, bugs: Column) -> Column:
    """The risk query's score: 0.4 test gap (0.5 without break points), 0.3 blast, 0.15 churn, 0.15 bug share."""
    gap = F.when(breaks == 0, 0.5).otherwise(F.greatest(F.least(1 - tests / breaks, F.lit(1.0)), F.lit(0.0)))
    bug = F.when(commits > 0, bugs / commits).otherwise(0.0)
    score = 0.4 * gap + 0.3 * F.least(files / BLAST, F.lit(1.0)) + 0.15 * F.least(commits / 20.0, F.lit(1.0)) + 0.15 * bug
    return F.when((files == 0) & (breaks == 0) & (commits == 0), 0.0).otherwise(F.least(score, F.lit(1.0)))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def merge_seeds(files: DataFrame) -> DataFrame:
    """(path, depth, reason, seeds): several seeds' impacted files as one list, each file at its least depth."""
    best = files.groupBy("path").agg(F.min(F.struct("depth", "reason")).alias("b"), F.countDistinct("seed").alias("seeds"))
    return best.select("path", F.col("b.depth").alias("depth"), F.col("b.reason").alias("reason"), "seeds")
