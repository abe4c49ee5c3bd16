"""Importers of a file up to three hops away, over re-exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def importers(imports: DataFrame, path: str | None = None) -> DataFrame:
    """(target, path, via, depth, re_export) from imports (src, dst, re_export), for one target or all.

    The first hop may be any import, the next ones only re-exports: src imports the file that re-exports the target. A
    nearer way wins; via is the file next to the target on the way, the first by name. A file never imports itself.
    """
    edges = imports.groupBy("src", "dst").agg(F.max("re_export").alias("re_export")).where("src != dst")
    one = edges.select(F.col("dst").alias("target"), F.col("src").alias("path"), F.lit("").alias("via"), "re_export")
    one = one.where(F.col("target") == path) if path is not None else one
    hops, front = [one.withColumn("depth", F.lit(1))], one.where("re_export").select("target", F.col("path").alias("mid"), F.col("path").alias("via"))
    for depth in (2, 3):
        step = front.join(edges.select(F.col("src").alias("path"), F.col("dst").alias("mid"), "re_export"), "mid").where("path != target")
        step = step.groupBy("target", "path").agg(F.min("via").alias("via"), F.max("re_export").alias("re_export"))
        hops.append(step.select("target", "path", "via", "re_export").withColumn("depth", F.lit(depth)))
        front = step.where("re_export").select("target", F.col("path").alias("mid"), "via")
    every = hops[0].unionByName(hops[1]).unionByName(hops[2])
    best = every.groupBy("target", "path").agg(F.min(F.struct("depth", "via", "re_export")).alias("b"))
    return best.select("target", "path", F.col("b.via").alias("via"), F.col("b.depth").alias("depth"), F.col("b.re_export").alias("re_export"))
