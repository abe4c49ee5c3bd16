"""Signals from commits (sha, ts, subject, is_merge, path): co-change, frequency, churn, bug share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import predicates as p

LAST_COMMITS = 200
MOST_FILES = 50
#: Least number of partitions that commits are dealt to; a fixed number, since few large ones would need much memory each.
LEAST_PARTS = 200


def co_change(commits: DataFrame, last: int = LAST_COMMITS, most_files: int = MOST_FILES) -> DataFrame:
    """(target, path, commits): how many of a target's last commits touch the other path too.

    Merges don't count, nor commits of more than most_files files, so a commit gives at most most_files squared pairs. A
    target's last commits are by time, then sha, and are taken before large ones go, as the history is read.
    """
    parts = max(LEAST_PARTS, int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    c = commits.where("not is_merge").select("sha", "ts", "path").repartition(parts, "path").distinct()
    recent = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("sha"))
    c = c.select("sha", "path", (F.row_number().over(recent) <= last).cast("long").alias("mine"))
    small = c.repartition(parts, "sha").withColumn("n", F.count("*").over(Window.partitionBy("sha"))).where((F.col("n") > 1) & (F.col("n") <= most_files))
    groups = small.where("sha is not null").groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("path", "mine"))).alias("all"))
    # Each pair of a commit moves once, for both directions.
    pairs = groups.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.slice("all", F.col("i") + 2, most_files)).alias("b"))
    pairs = pairs.select(F.col("a.path").alias("x"), F.col("b.path").alias("y"), F.col("a.mine").alias("of_x"), F.col("b.mine").alias("of_y"))
    counts = pairs.where("x != y").groupBy("x", "y").agg(F.sum("of_x").alias("of_x"), F.sum("of_y").alias("of_y"))
    ways = F.array(F.struct(F.col("x").alias("target"), F.col("y").alias("path"), F.col("of_x").alias("commits")), F.struct(F.col("y").alias("target"), F.col("x").alias("path"), F.col("of_y").alias("commits")))
    return counts.select(F.explode(ways).alias("w")).select("w.*").where("commits > 0")


def ranked(pairs: DataFrame, limit: int = 5) -> DataFrame:
    """Each target's `limit` most frequent companions, equal counts by path, with their rank."""
    w = Window.partitionBy("target").orderBy(F.desc("commits"), "path")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def with_importers(pairs: DataFrame, imports: DataFrame, least: int = 1) -> DataFrame:
    """Companions that also import the target, less documentation files."""
    near = imports.select(F.col("src").alias("path"), F.col("dst").alias("target")).distinct()
    return pairs.where((F.col("commits") >= least) & ~p.is_noise_doc(F.col("path"))).join(near, ["target", "path"], "left_semi")


def frequencies(commits: DataFrame) -> DataFrame:
    """(path, commits): non-merge commits of each path."""
    return commits.where("not is_merge").groupBy("path").agg(F.countDistinct("sha").alias("commits"))


def upper_median(freq: DataFrame) -> DataFrame:
    """(median): the count at place n div 2 of the sorted counts, from their histogram."""
    hist = freq.groupBy("commits").agg(F.count("*").alias("n"))
    total = hist.agg(F.sum("n").alias("total"))
    w = Window.orderBy("commits")  # over distinct counts, not over paths
    below = hist.withColumn("upto", F.sum("n").over(w)).crossJoin(F.broadcast(total))
    return below.where(F.col("upto") > F.expr("total div 2")).agg(F.min("commits").alias("median"))


def hub_penalty(freq: DataFrame) -> DataFrame:
    """(path, commits, multiplier): 1 up to three times the median, then 1 / (1 + (ratio - 3) / 3)."""
    rows = freq.crossJoin(F.broadcast(upper_median(freq)))
    ratio = F.col("commits") / F.greatest("median", F.lit(1))
    return rows.select("path", "commits", F.round(F.when(ratio <= 3, 1.0).otherwise(1 / (1 + (ratio - 3) / 3)), 6).alias("multiplier"))


def churn(commits: DataFrame, anchor: str | None = None, days: int = 90) -> DataFrame:
    """(path, commits, bugs, churn, bug_share) in the days before the anchor time, by default the last commit's."""
    c = commits.where("not is_merge").select("sha", "ts", "subject", "path").distinct()
    end = F.lit(anchor).cast("timestamp") if anchor else c.agg(F.max("ts").alias("end")).first()["end"]
    end = end if anchor else F.lit(end)
    c = c.where((F.col("ts") <= end) & (F.col("ts") >= end - F.expr(f"interval {days * 86400} seconds")))
    rows = c.groupBy("path").agg(F.count("*").alias("commits"), F.count_if(p.is_bug_subject(F.col("subject"))).alias("bugs"))
    return rows.select("path", "commits", "bugs", F.round(F.least(F.col("commits") / 20, F.lit(1.0)), 6).alias("churn"), F.round(F.col("bugs") / F.col("commits"), 6).alias("bug_share"))
