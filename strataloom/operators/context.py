"""Text for a token budget: snippets, the greedy fold over sections, the context of a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..graph import Graph


def snippet(texts: DataFrame, at: DataFrame, most_lines: int = 8) -> DataFrame:
    """(path, line, snippet): up to most_lines lines of each text from each line (1-based) of at (path, line)."""
    rows = at.join(texts.select("path", p.lines(F.col("text")).alias("lines")), "path")
    return rows.select("path", "line", F.array_join(F.slice("lines", F.greatest(F.col("line").cast("int"), F.lit(1)), most_lines), "\n").alias("snippet"))


def signature_of(text: Column, path: Column) -> Column:
    """The head of a definition: to the colon in Python, to the brace in brace languages, else the first line with text."""
    head = F.regexp_extract(text, r"(?s)^(.*?:)\s*(?:\n|$)", 1)
    brace = F.trim(F.substring_index(text, "{", 1))
    first = F.regexp_extract(text, r"(?m)^\s*(\S.*)$", 1)
    return F.when(p.extension(path) == "py", F.when(head != "", head).otherwise(first)).when(p.extension(path).isin("rb"), first).otherwise(brace)


def budget_fold(items: Column, budget: int) -> Column:
    """The items taken, from an array of (section, place, tokens, ...) in priority order.

    Items are taken while they fit; the first of a section that doesn't fit ends that section, and later sections may still
    fit theirs. So it is a fold, and no running sum can stand for it.
    """
    step = lambda a, x: F.when(a["closed"] == x["section"], a).when(a["used"] + x["tokens"] > budget, F.struct(a["used"].alias("used"), x["section"].alias("closed"), a["taken"].alias("taken"))).otherwise(F.struct((a["used"] + x["tokens"]).alias("used"), a["closed"].alias("closed"), F.concat(a["taken"], F.array(x["id"])).alias("taken")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).cast("int").alias("closed"), F.array().cast("array<string>").alias("taken"))
    return F.aggregate(items, start, step)


def pack_sections(items: DataFrame, budget: int, key: str = "key") -> DataFrame:
    """(key, used, taken) from items (key, section int, place, id string, tokens long): each key's greedy fill."""
    rows = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section", "place", "id", "tokens"))).alias("items"))
    done = budget_fold(F.transform("items", lambda x: F.struct(x["section"].cast("int").alias("section"), x["id"].alias("id"), x["tokens"].cast("long").alias("tokens"))), budget)
    return rows.select(key, done.alias("done")).select(key, F.col("done.used").alias("used"), F.array_join("done.taken", ",").alias("taken"))


def minimal_context(g: Graph, texts: DataFrame, symbol: str, file: str | None = None, budget: int = 2000) -> DataFrame:
    """(section, id, file, line, snippet, tokens, taken): the seed's body, up to 5 callers, 3 callees, 6 test files.

    Sections are in this order of priority; each item is a snippet of up to 8 lines at the place it names.
    """
    defs = g.internal().where(F.col("name") == symbol)
    defs = defs.where(F.col("file") == file) if file else defs
    ends = g.ends("CALLS", "REFERENCES")
    seed = defs.select(F.lit(0).alias("section"), F.col("id"), "file", "line").orderBy("file", "line").limit(1)
    into = ends.join(defs.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id"), F.col("src_file").alias("file")).agg(F.min("line").alias("line")).select(F.lit(1).alias("section"), "id", "file", "line").orderBy("file", "line", "id").limit(5)
    out = ends.join(defs.select(F.col("id").alias("src")), "src", "left_semi").where("dst_kind != 'external'").select(F.lit(2).alias("section"), F.col("dst").alias("id"), F.col("dst_file").alias("file"), F.col("dst_line").alias("line")).distinct().orderBy("file", "line", "id").limit(3)
    tests = g.kind("TESTED_BY").join(defs.select(F.col("id").alias("src")), "src", "left_semi").join(g.symbols.select(F.col("id").alias("dst"), "file", F.col("line").alias("at")), "dst").groupBy("file").agg(F.min("at").alias("line"))
    tests = tests.select(F.lit(3).alias("section"), F.col("file").alias("id"), "file", "line").orderBy("file").limit(6)
    places = seed.union(into).union(out).union(tests)
    shown = places.join(snippet(texts, places.select(F.col("file").alias("path"), "line").distinct()).withColumnRenamed("path", "file"), ["file", "line"], "left")
    shown = shown.withColumn("tokens", p.token_estimate(F.coalesce("snippet", F.lit("")))).withColumn("one", F.lit(1))
    done = pack_sections(shown.withColumn("place", F.struct("file", "line", "id")), budget, "one").select("one", F.split("taken", ",").alias("ids"))
    return shown.join(done, "one", "left").select("section", "id", "file", "line", "snippet", "tokens", F.coalesce(F.array_contains("ids", F.col("id")), F.lit(False)).alias("taken"))


def sibling_tests(paths: DataFrame, name: str, most: int = 6) -> DataFrame:
    """(path, tail, prefix): test files beside a name, by whether their stem has the name's last camel-case part, then by the
    length of the common prefix, then by path."""
    stem = p.stem(F.col("path"))
    tail = p.camel_tail(F.lit(name))
    rows = paths.where(p.is_test_path(F.col("path"))).select("path", F.when(tail != "", stem.contains(tail)).otherwise(False).alias("tail"), p.common_prefix(stem, F.lit(name)).alias("prefix"))
    return rows.orderBy(F.desc("tail"), F.desc("prefix"), "path").limit(most)
