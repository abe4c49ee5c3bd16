"""Degree ranking of symbols. A node is (name, file): definitions of one name in one file are one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidParams
from ..graph import Graph

BETWEEN_SYMBOLS = ("CALLS", "REFERENCES", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "CONTAINS", "DECORATES")
FROM_FILES = ("IMPORTS_NAMED", "MODULE_TYPED")


def degrees(g: Graph, edge_types: str = "default") -> DataFrame:
    """(name, file, in_degree, out_degree, total) of nodes with an edge; "default" takes off guessed calls, "all" doesn't.

    An edge adds one to each end's signed count, a guessed call takes one off again; counts never go under 0. Both ends
    come from one pass over the edges, added up map-side before the one shuffle by symbol.
    """
    if edge_types not in ("default", "all"):
        raise InvalidParams("edge_types is default or all")
    guessed = ("CALLS_HEURISTIC",) if edge_types == "default" else ()
    rows = g.kind(*BETWEEN_SYMBOLS, *FROM_FILES, *guessed)
    sign = F.when(F.col("kind") == "CALLS_HEURISTIC", -1).otherwise(1)
    ends = F.array(F.struct(F.col("dst").alias("id"), sign.alias("i"), F.lit(0).alias("o")), F.struct(F.when(~F.col("kind").isin(*FROM_FILES), F.col("src")).alias("id"), F.lit(0).alias("i"), sign.alias("o")))
    by_id = rows.select(F.explode(ends).alias("e")).select("e.*").where("id is not null").groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    nodes = by_id.join(g.internal().select("id", "name", "file"), "id").groupBy("name", "file").agg(F.greatest(F.sum("i"), F.lit(0)).alias("in_degree"), F.greatest(F.sum("o"), F.lit(0)).alias("out_degree"))
    return nodes.withColumn("total", F.col("in_degree") + F.col("out_degree")).where("total > 0")


def _order() -> list:
    return [F.desc("total"), F.desc("in_degree"), F.asc("file"), F.asc("name")]


def top(g: Graph, top_n: int = 10, edge_types: str = "default") -> DataFrame:
    """The top_n nodes by total degree, in-degree, file, name."""
    if not 1 <= top_n <= 100:
        raise InvalidParams("top_n is 1 to 100")
    return degrees(g, edge_types).orderBy(*_order()).limit(top_n)


def rank_of(g: Graph, symbol: str, file: str | None = None, edge_types: str = "default") -> DataFrame:
    """(name, file, total, rank) of a target: one more than the nodes before it, counted without a global sort."""
    d = degrees(g, edge_types)
    t = d.where(F.col("name") == symbol)
    t = (t.where(F.col("file") == file) if file else t).select(*(F.col(c).alias(f"t_{c}") for c in d.columns))
    before = F.struct(-F.col("total"), -F.col("in_degree"), F.col("file"), F.col("name")) < F.struct(-F.col("t_total"), -F.col("t_in_degree"), F.col("t_file"), F.col("t_name"))
    return d.join(F.broadcast(t), F.lit(True)).groupBy("t_name", "t_file", "t_total").agg((F.count_if(before) + 1).alias("rank")).select(F.col("t_name").alias("name"), F.col("t_file").alias("file"), F.col("t_total").alias("total"), "rank")


def all_ranks(nodes: DataFrame) -> DataFrame:
    """Every node's rank by group: within its file."""
    w = Window.partitionBy("file").orderBy(F.desc("total"), F.desc("in_degree"), F.asc("name"))
    return nodes.withColumn("rank", F.row_number().over(w))
