"""The driver's tables as graphs, texts, commits and task tables. Each has a counterpart in SQL in oracles.py."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph
from ..operators import history


COMMERCE_KINDS = ("CALLS", "CALLS_HEURISTIC", "REFERENCES", "TESTED_BY", "EXTENDS", "IMPLEMENTS")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(tag: str, key: str):
    return F.concat(F.lit(tag), F.col(key).cast("string"))


def commerce(spark: SparkSession, d: str, *kinds: str) -> Graph:
    """Customers (functions) call suppliers (methods) and refer to parts (classes); a nation or brand is a file.

    With kinds, only those edges are made, as a stored graph would read only their directories.
    """
    nation = lambda c: F.concat(F.lit("nation/n"), F.col(c).cast("string"), F.lit(".py"))
    cust = table(spark, d, "customer").select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("name"), nation("c_nationkey").alias("file"), F.lit("function").alias("kind"), F.col("c_custkey").alias("line"), (F.col("c_custkey") + F.floor(F.abs("c_acctbal") / 100)).alias("line_end"))
    supp = table(spark, d, "supplier").select(_id("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), nation("s_nationkey").alias("file"), F.lit("method").alias("kind"), F.col("s_suppkey").alias("line"), (F.col("s_suppkey") + F.floor(F.abs("s_acctbal") / 100)).alias("line_end"))
    brand = F.concat(F.lit("brand/"), F.regexp_replace("p_brand", "#", ""), F.lit(".py"))
    part = table(spark, d, "part").select(_id("p", "p_partkey").alias("id"), F.col("p_name").alias("name"), brand.alias("file"), F.lit("class").alias("kind"), F.col("p_partkey").alias("line"), (F.col("p_partkey") + F.col("p_size")).alias("line_end"))
    symbols = cust.unionByName(supp).unionByName(part)
    files = symbols.select(F.col("file").alias("path"), F.lit("python").alias("lang")).distinct()
    make = lambda *only, by=None: _commerce_edges(spark, d, [k for k in COMMERCE_KINDS if k in only and (not kinds or k in kinds)], by)
    return Graph.of(files, symbols, make(*COMMERCE_KINDS), make)


def _commerce_edges(spark: SparkSession, d: str, wanted: list[str], by: str | None) -> DataFrame:
    """(kind, src, dst, line) of the wanted kinds of commerce(); with `by`, made distinct where that end's edges lie together."""
    # One pass over the joined lines: each makes its edges as an array, so the join runs once. Till they are distinct, kinds are
    # numbers, and so are the keys of an end that they don't lie together by; ids take more room.
    shapes = {
        "CALLS": ("c", "s", F.lit(True)), "CALLS_HEURISTIC": ("c", "s", F.col("returned")),
        "REFERENCES": ("c", "p", F.col("many")), "TESTED_BY": ("s", "c", F.col("urgent")),
    }
    shapes = {k: x for k, x in shapes.items() if k in wanted}
    id_of = lambda tag, end: _id(tag, tag) if by == end else F.col(tag)
    made = [F.when(when, F.struct(F.lit(n).cast("byte").alias("n"), id_of(a, "src").alias("src"), id_of(b, "dst").alias("dst"), F.col("line"))) for n, (a, b, when) in enumerate(shapes.values(), 1)]
    edges = []
    if made:
        # What the conditions need is made a flag before the join, so that it moves less.
        many = F.col("l_quantity") > 45
        lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s"), F.when(many, F.col("l_partkey")).alias("p"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("returned"), many.alias("many"))
        lines = lines.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent")), F.col("l_orderkey") == F.col("o_orderkey"))
        lines = lines.where(functools.reduce(lambda a, b: a | b, (when for _, _, when in shapes.values())))
        lines = lines.select(F.explode(F.array_compact(F.array(*made))).alias("e")).select("e.*")
        lines = (lines.repartition(by) if by else lines).distinct()
        tag = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in shapes.values())), F.col("n").cast("int"))
        text = lambda i, end: F.col(end) if by == end else F.concat(tag(i), F.col(end).cast("string")).alias(end)
        kind = F.element_at(F.array(*map(F.lit, shapes)), F.col("n").cast("int"))
        edges.append(lines.select(kind.alias("kind"), text(0, "src"), text(1, "dst"), F.col("line").cast("long").alias("line")))
    types = [k for k in ("EXTENDS", "IMPLEMENTS") if k in wanted]
    if types:
        first = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("base"))
        extends = table(spark, d, "part").join(first, ["p_brand", "p_type"]).where("p_partkey != base")
        extends = extends.select(_id("p", "p_partkey").alias("src"), _id("p", "base").alias("dst"), (F.col("p_size") > 25).alias("strong"))
        each = F.when(F.col("strong"), F.array(F.lit("EXTENDS"), F.lit("IMPLEMENTS"))).otherwise(F.array(F.lit("EXTENDS")))
        edges.append(extends.select(F.explode(each).alias("kind"), "src", "dst", F.lit(-1).cast("long").alias("line")).where(F.col("kind").isin(*types)))
    return functools.reduce(DataFrame.unionByName, edges) if edges else spark.createDataFrame([], "kind string, src string, dst string, line long")


def events(spark: SparkSession, d: str) -> Graph:
    """Users call the user of the day's next error; a tenth of the users share a file."""
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", "ts", "user_id")
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    calls = e.withColumn("next", F.lead("user_id").over(day)).where("next is not null and next != user_id")
    calls = calls.select(F.lit("CALLS").alias("kind"), _id("u", "user_id").alias("src"), _id("u", "next").alias("dst"), F.hour("ts").cast("long").alias("line")).distinct()
    users = table(spark, d, "events").select("user_id").distinct()
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    file = F.concat(F.lit("team/t"), F.expr("user_id % 10").cast("string"), F.lit(".py"))
    symbols = users.select(_id("u", "user_id").alias("id"), name.alias("name"), file.alias("file"), F.lit("function").alias("kind"), F.col("user_id").alias("line"), (F.col("user_id") + 1).alias("line_end"))
    return Graph.of(symbols.select(F.col("file").alias("path"), F.lit("python").alias("lang")).distinct(), symbols, calls)


def commits(spark: SparkSession, d: str) -> DataFrame:
    """(sha, ts, subject, is_merge, path): an order is a commit, its parts are its files."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderpriority", "o_orderstatus")
    subject = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("fix crash in part")).when(F.col("o_orderpriority") == "2-HIGH", F.lit("prefix fixture")).otherwise(F.lit("add feature"))
    # Many small partitions, which aren't merged: the join, and making rows distinct, need memory for a whole one.
    parts = max(history.LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey")
    rows = o.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(_id("o", "o_orderkey").alias("sha"), "ts", subject.alias("subject"), (F.col("o_orderstatus") == "P").alias("is_merge"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path")).distinct()


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): a document is a file in its source's directory."""
    path = F.concat_ws("/", F.col("source"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, path): the url without its scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", path.alias("path"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, re_export): a page imports each page name that it links to; http pages re-export."""
    hrefs = F.regexp_extract_all("html", F.lit(r'href="/([A-Za-z]+)"'), F.lit(1))
    rows = table(spark, d, "pages").select("page_id", "url", F.explode(hrefs).alias("dst"))
    src = F.regexp_extract("url", r"//([^/]*?)\.example", 1)
    return rows.select(src.alias("src"), F.lower("dst").alias("dst"), F.col("url").startswith("http:").alias("re_export")).distinct()
