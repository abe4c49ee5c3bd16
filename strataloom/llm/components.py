"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _written(edges: DataFrame, name: str) -> DataFrame:
    """The edges as a table of at most two files for each core: every round writes two tables, and each file costs the
    executors several calls besides its rows."""
    return materialize(edges.coalesce(max(16, 2 * edges.sparkSession.sparkContext.defaultParallelism)), name)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every endpoint of edges (u, v); component is the smallest id reachable.

    Each round is two aggregations with map-side combine and two joins on the node, whose skew Spark can split; the
    edges stay in the shared folder, never on the driver. Self-loops and null ends are ignored; an empty edge table
    gives an empty result. Repeated edges count once.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = _written(e, "edges")
    state = _digest(e)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = _written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = _written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(large, e)
        e, before = new, state
        state = _digest(e)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    labels = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return labels.union(roots)
