"""Scores of retrieved against expected rows, ranking measures, token cost, BM25, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import predicates as p
from ..tables import written


def prf(expected: DataFrame, actual: DataFrame, tasks: DataFrame, beta: float = 1.0) -> DataFrame:
    """(task, tp, fp, fn, precision, recall, f) for each task, from (task, item) sets.

    An empty answer has precision 0, an empty expectation recall 1, and if both are empty f is 1.
    """
    both = expected.select("task", "item").distinct().withColumn("e", F.lit(1)).join(actual.select("task", "item").distinct().withColumn("a", F.lit(1)), ["task", "item"], "full_outer")
    n = both.groupBy("task").agg(F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    n = tasks.select("task").distinct().join(n, "task", "left").fillna(0, ["tp", "fp", "fn"])
    prec = F.when(F.col("tp") + F.col("fp") == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    rec = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    b = beta * beta
    f = F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).when(b * prec + rec == 0, 0.0).otherwise((1 + b) * prec * rec / (b * prec + rec))
    return n.select("task", "tp", "fp", "fn", F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(f, 6).alias("f"))


def mrr(ranked: DataFrame, expected: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task, rr): one over the rank of the first expected item of ranked (task, item, rank), 0 without one."""
    best = ranked.join(expected.select("task", "item").distinct(), ["task", "item"], "left_semi").groupBy("task").agg(F.min("rank").alias("r"))
    return tasks.select("task").distinct().join(best, "task", "left").select("task", F.round(F.coalesce(1 / F.col("r"), F.lit(0.0)), 6).alias("rr"))


def average_ranks(rows: DataFrame, value: str, key: str = "item") -> DataFrame:
    """(item, rank): ranks by value, equal values sharing their mean rank; from the histogram of values, not a global sort
    of rows."""
    hist = rows.groupBy(value).agg(F.count("*").alias("n"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = hist.withColumn("upto", F.sum("n").over(w)).select(value, (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    return rows.select(key, value).join(ranks, value).select(key, "rank")


def spearman(rows: DataFrame, x: str, y: str, key: str = "item") -> DataFrame:
    """(n, rho): Pearson's correlation of the average ranks of two columns."""
    a = average_ranks(rows, x, key).withColumnRenamed("rank", "rx")
    b = average_ranks(rows, y, key).withColumnRenamed("rank", "ry")
    return a.join(b, key).agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


def token_cost(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(task, tokens_50, tokens_100): tokens of the shortest ranked prefix with half and with all expected items; null if
    none has. ranked is (task, item, rank, tokens)."""
    total = expected.select("task", "item").distinct().groupBy("task").agg(F.count("*").alias("want"))
    rows = ranked.join(expected.select("task", "item").distinct().withColumn("hit", F.lit(1)), ["task", "item"], "left").join(total, "task")
    w = Window.partitionBy("task").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("spent", F.sum("tokens").over(w)).withColumn("hits", F.sum(F.coalesce("hit", F.lit(0))).over(w))
    return rows.groupBy("task").agg(F.min(F.when(2 * F.col("hits") >= F.col("want"), F.col("spent"))).alias("tokens_50"), F.min(F.when(F.col("hits") >= F.col("want"), F.col("spent"))).alias("tokens_100"))


def sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, f1, f2) over scored (score, positive) for each threshold, in one pass over the rows."""
    rows = scored.select("score", "positive", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    n = rows.groupBy("threshold").agg(F.count_if(hit & F.col("positive")).alias("tp"), F.count_if(hit & ~F.col("positive")).alias("fp"), F.count_if(~hit & F.col("positive")).alias("fn"))
    f = lambda b: F.round(F.coalesce((1 + b) * F.col("tp") / F.nullif((1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp"), F.lit(0)), F.lit(0.0)), 6)
    return n.select("threshold", "tp", "fp", "fn", f(1).alias("f1"), f(4).alias("f2"))


def impact_composite(tests: Column, completeness: Column, depth: Column, expected_depth: Column, precision: Column, found: Column) -> Column:
    """0.4 test recall + 0.3 completeness + 0.15 depth + 0.15 precision; depth is at most 1 and 0 if nothing was found."""
    d = F.when(~found, 0.0).when(expected_depth == 0, 1.0).otherwise(F.least(depth / expected_depth, F.lit(1.0)))
    return 0.4 * tests + 0.3 * completeness + 0.15 * d + 0.15 * precision


def summary(scores: DataFrame, value: str, by: str, pass_at: float = 0.5) -> DataFrame:
    """(by, n, mean, p95, pass_rate): mean, nearest-rank 95th percentile and the share at pass_at or more."""
    rows = scores.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.avg((F.col(value) >= pass_at).cast("double")).alias("pass_rate"))
    return rows.select(by, "n", F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"), F.round("pass_rate", 6).alias("pass_rate"))


def bm25(texts: DataFrame, query: str, top: int = 50, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(path, score): the top texts (path, text) for a query's identifiers, equal scores by path.

    Words that the query lacks are only counted for the length; the query's words are explicit, so a text sends a row for
    each query word it has, and never one for each of its words.
    """
    terms = sorted({*_query_terms(query)})
    words = p.identifiers(F.col("text"))
    # Texts are split once; totals and scores read what that wrote.
    rows = texts.select("path", words.alias("words")).select("path", F.size("words").alias("dl"), F.col("words"))
    tf = lambda t: F.size(F.filter("words", lambda w: w == t))
    counted = written(rows.select("path", "dl", F.array(*(F.struct(F.lit(t).alias("term"), tf(t).alias("tf")) for t in terms)).alias("q")))
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col("q")[i]["tf"] > 0).alias(f"df{i}") for i in range(len(terms))))
    joined = counted.crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col("q")[i]["tf"], F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return joined.select("path", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "path").limit(top)


def random_ranking(texts: DataFrame, seed: int, top: int = 50) -> DataFrame:
    """(path, rank): a baseline in an order that a seed determines."""
    first = texts.select("path").distinct().orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.xxhash64("path", F.lit(seed)), "path")))


def grep_ranking(texts: DataFrame, token: str, top: int = 50) -> DataFrame:
    """(path, hits): a baseline of the texts with most whole occurrences of a token, equal counts by path."""
    return texts.select("path", p.token_count(F.col("text"), token).alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "path").limit(top)


def _query_terms(query: str) -> list[str]:
    import re

    out = []
    for w in re.split(r"[^\w]+", query):
        if len(w) >= 2:
            out.append(w.lower())
            out += [x.lower() for x in w.split("_") if len(x) >= 2] if "_" in w else []
    return out
