"""Symbol search: exact, fuzzy, contains; large functions; paging; suffixes for duplicate names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import IndexNotReady, InvalidParams
from ..graph import Graph


def ready(g: Graph) -> Graph:
    """g, or IndexNotReady if it has no symbol."""
    if g.symbols.limit(1).isEmpty():
        raise IndexNotReady("the graph has no symbols")
    return g


def caller_counts(g: Graph) -> DataFrame:
    """(name, file, callers): incoming calls of each definition."""
    return g.ends("CALLS").groupBy(F.col("dst_name").alias("name"), F.col("dst_file").alias("file")).agg(F.count("*").alias("callers"))


def exact(g: Graph, pattern: str, cap: int = 10) -> DataFrame:
    """(name, file, kind, line, score): definitions of a name, the most called first; score is min(1 + 0.05 callers, 2)."""
    rows = g.internal().where(F.col("name") == pattern).join(caller_counts(g), ["name", "file"], "left")
    score = F.least(1 + 0.05 * F.coalesce("callers", F.lit(0)), F.lit(2.0))
    return rows.select("name", "file", "kind", "line", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "file", "line").limit(cap)


def fuzzy(g: Graph, pattern: str, cap: int = 10) -> DataFrame:
    """(name, file, kind, line, score), best first: a bonus for prefix (0.5) or infix (0.3) regardless of case, then the
    edit distance d, scaled by the distance of the last row in that order: bonus + 0.5 - 0.5 d / D, within 0 and 1.

    The last row is the one with the least bonus and, among those, the largest distance, so it is an aggregate and no
    window over all symbols.
    """
    low, p = F.lower("name"), pattern.lower()
    bonus = F.when(low.startswith(p), 0.5).when(low.contains(p), 0.3).otherwise(0.0)
    rows = g.internal().select("name", "file", "kind", "line", bonus.alias("bonus"), F.levenshtein("name", F.lit(pattern)).alias("d"))
    last = rows.agg(F.greatest(F.max_by("d", F.struct(-F.col("bonus"), F.col("d"))), F.lit(1)).alias("scale"))
    rows = rows.crossJoin(F.broadcast(last))
    score = F.least(F.greatest(F.col("bonus") + 0.5 - 0.5 * F.col("d") / F.col("scale"), F.lit(0.0)), F.lit(1.0))
    order = [F.desc("bonus"), F.asc("d"), F.asc("name"), F.asc("file"), F.asc("line")]
    return rows.withColumn("score", F.round(score, 6)).orderBy(*order).limit(cap).select("name", "file", "kind", "line", "score")


def contains(g: Graph, pattern: str, cap: int = 50) -> DataFrame:
    """(name, file, kind, line, score): names with the pattern regardless of case; 2 for a prefix, else 1."""
    low, p = F.lower("name"), pattern.lower()
    rows = g.internal().where(low.contains(p)).select("name", "file", "kind", "line", F.when(low.startswith(p), 2.0).otherwise(1.0).alias("score"))
    return rows.orderBy(F.desc("score"), F.lower("name"), "file", "line").limit(cap)


def search(g: Graph, pattern: str, mode: str = "exact") -> DataFrame:
    modes = {"exact": exact, "fuzzy": fuzzy, "contains": contains}
    if mode not in modes:
        raise InvalidParams(f"no such mode: {mode}")
    return modes[mode](ready(g), pattern)


def large_functions(g: Graph, min_lines: int = 50, kind: str | None = None, file_pattern: str | None = None, limit: int = 50) -> DataFrame:
    """(name, file, kind, line, span): symbols of min_lines or more, the longest first."""
    if not 1 <= limit <= 200:
        raise InvalidParams("limit is 1 to 200")
    span = F.col("line_end") - F.col("line") + 1
    rows = g.internal().select("name", "file", "kind", "line", span.alias("span")).where(F.col("span") >= min_lines)
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.where(F.col("file").contains(file_pattern)) if file_pattern else rows
    return rows.orderBy(F.desc("span"), "file", "name", "line").limit(limit)


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> tuple[DataFrame, int, bool]:
    """(rows of the page, total, whether more follow)."""
    if offset < 0 or not 1 <= limit <= 500:
        raise InvalidParams("offset is 0 or more, limit is 1 to 500")
    total = rows.count()
    return rows.orderBy(*order).offset(offset).limit(limit), total, offset + limit < total


def dup_suffix(symbols: DataFrame, name_col: str = "qualified_name", order: list | None = None) -> DataFrame:
    """symbols with `unique_name`: the second and later rows of a name in the given order get #dup1, #dup2, ..."""
    n = F.row_number().over(Window.partitionBy(name_col).orderBy(*(order or ["file", "line", "id"]))) - 1
    return symbols.withColumn("unique_name", F.when(n > 0, F.concat(F.col(name_col), F.lit("#dup"), n.cast("string"))).otherwise(F.col(name_col)))
