"""Quality rules whose thresholds adapt to each language and source, from mergeable quantile sketches. SQL functions only.

Every bound comes from the sketch alone; there is no fixed cutoff beside it. A count enters its rate less the least number
that it can have above zero, so that one symbol or one repeated line never condemns a document. Rates are integers. A
sketch is a log-linear histogram: values under 128 have a bucket each, larger ones 64 buckets for each doubling, so a
quantile is exact to one part in 64, two sketches merge by adding counts, and results don't depend on the order of rows. Sketches are counted map-side before they are shuffled, so a source with a third of all rows is at most a
few thousand rows for each task. A group of under `min_group` documents uses the sketch of its language, or of all documents,
which are sums of the finer ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

BLANK = r"[\x20\x09-\x0D]"
SOLID = r"[^\x20\x09-\x0D]"
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Reject a rate above its group's `level` percentile plus `spread` times the way there from the percentile 100 - level.

    Both are taken at their bucket's far end, so that a group whose values share a bucket is judged by what the bucket may
    hold. Documents of fewer than `words` words aren't judged by it.
    """

    metric: str
    level: int
    spread: int
    words: int = 0


#: Rates are in ten-thousandths, mean_word in hundredths of a character. Symbols and long words mark junk of up to a quarter of
#: a group; repeated lines and windows are rare in all groups, so their bounds are those of the group's last hundredth.
RULES = (Rule("symbol_rate", 75, 3), Rule("dup_rate", 99, 1), Rule("repeat_rate", 99, 1), Rule("mean_word", 75, 6, 10))
MIN_GROUP = 100


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words within 5-word windows found twice or more, given the words' hashes."""

    def of_windows(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            last = F.size(s) - 1
            twin = lambda e, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == e["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == e["h"]))
            places = F.array_sort(F.array_compact(F.transform(s, lambda e, k: F.when(twin(e, k), e["i"]))))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            add = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
            return F.aggregate(places, start, add, lambda a: a["n"])

        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(F.sort_array(pairs), of_sorted))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(h[i + j] for j in range(WINDOW))))
        return F.when(F.size(h) < WINDOW, 0).otherwise(_let(windows, of_windows))

    return _let(hashes, of_hashes)


def features(docs: DataFrame, text_col: str = "text", prefix: str = "", least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """docs with BASE, base_failed and the rules' rates as added columns, each name after `prefix`.

    Words are runs without blanks, and code points count as characters. A null, empty or blank text has no words: all
    counts are 0 and base_failed is true. The base rules want `least_words` words or more, and at most `most_repeated` of
    100 words in repeated windows.
    """
    name = lambda x: f"{prefix}{x}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SOLID))
    out = docs.withColumn(name("words_"), words).withColumn(name("lines_"), lines)
    w, ln = F.col(name("words_")), F.col(name("lines_"))
    out = out.withColumns(
        {
            name("n_words"): F.size(w).cast("long"),
            name("word_chars"): F.length(F.array_join(w, "")).cast("long"),
            name("n_symbols"): F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            name("n_dup_lines"): (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
            name("n_repeat_words"): _covered(F.transform(w, lambda x: F.xxhash64(x))).cast("long"),
            name("n_lines"): F.size(ln).cast("long"),
        }
    ).drop(name("words_"), name("lines_"))
    n, repeat = F.col(name("n_words")), F.col(name("n_repeat_words"))
    rate = lambda a, b, less=0, by=10_000: F.expr(f"coalesce({by} * greatest(`{name(a)}` - {less}, 0) div nullif(`{name(b)}`, 0), 0)")
    return out.withColumns(
        {
            name("base_failed"): (n < least_words) | (100 * repeat > most_repeated * n),
            name("symbol_rate"): rate("n_symbols", "word_chars", 1),
            name("dup_rate"): rate("n_dup_lines", "n_lines", 1),
            name("repeat_rate"): rate("n_repeat_words", "n_words", 2 * WINDOW),
            name("mean_word"): rate("word_chars", "n_words", by=100),
        }
    )


def _bucket(v: Column) -> Column:
    e = F.length(F.bin(v)) - 7
    return F.when(v < 128, v).otherwise(F.call_function("shiftright", v, e) + 64 * e)


def _bounds(column: str) -> tuple[Column, Column]:
    """The least and the largest value of a bucket."""
    e = F.expr(f"cast(({column} - 64) div 64 as int)")
    b = F.col(column)
    at = lambda more: F.call_function("shiftleft", b - 64 * e + more, e)
    return F.when(b < 128, b).otherwise(at(0)), F.when(b < 128, b).otherwise(at(1) - 1)


def thresholds(feats: DataFrame, lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP, prefix: str = "", rules=RULES) -> DataFrame:
    """(lang, source, <metric>_most ...) for each language and source in feats; the first two may be null.

    Only documents that pass the base rules count. A group all of whose documents failed them still has a row.
    """
    values = F.array(*(F.struct(F.lit(r.metric).alias("metric"), F.col(f"{prefix}{r.metric}").alias("v")) for r in rules))
    good = feats.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), (~F.col(f"{prefix}base_failed")).cast("long").alias("n"), F.explode(values).alias("m"))
    sketch = good.groupBy("lang", "source", F.col("m.metric").alias("metric"), _bucket(F.col("m.v")).alias("bucket")).agg(F.sum("n").alias("n"))
    sketch = materialize(sketch, "sketch")

    percents = F.create_map(*(F.lit(x) for r in rules for x in (r.metric, r.level)))[F.col("metric")]

    def quantiles(keys: list[str], tag: str) -> DataFrame:
        # A sketch has at most a few hundred buckets, so an array of them is small.
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        merged = merged.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("s"), F.sum("n").alias("total"))

        def at(percent: Column) -> Column:
            step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((a["b"] < 0) & (100 * (a["seen"] + x["n"]) >= percent * F.col("total")), x["bucket"]).otherwise(a["b"]).alias("b"))
            return F.aggregate("s", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("b")), step, lambda a: a["b"])

        both = merged.select(*keys, "metric", F.col("total").alias(f"{tag}_n"), at(100 - percents).alias("low"), at(percents).alias("high"))
        return both.select(*keys, "metric", f"{tag}_n", _bounds("low")[0].alias(f"{tag}_low"), _bounds("high")[1].alias(f"{tag}_high"))

    fine, by_lang, whole = quantiles(["lang", "source"], "fine"), quantiles(["lang"], "lang"), quantiles([], "all")
    by_lang = by_lang.withColumnsRenamed({"lang": "lang_", "metric": "metric_"})
    joined = fine.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("metric") == F.col("metric_"))).join(whole, "metric")
    pick = lambda q: F.when(F.col("fine_n") >= min_group, F.col(f"fine_{q}")).when(F.col("lang_n") >= min_group, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}"))
    picked = joined.select("lang", "source", "metric", pick("low").alias("low"), pick("high").alias("high"))
    most = lambda r: F.max(F.when(F.col("metric") == r.metric, F.col("high") + r.spread * (F.col("high") - F.col("low")))).alias(f"{r.metric}_most")
    return materialize(picked.groupBy("lang", "source").agg(*map(most, rules)), "thresholds")


def judge(feats: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "", rules=RULES) -> DataFrame:
    """feats with `kept`: not base_failed, and no rate above its group's threshold.

    The thresholds are joined by language and source (null equals null); Spark broadcasts them only while their written
    size is under its own limit, and else splits skewed groups.
    """
    limits = limits.withColumnsRenamed({c: f"{prefix}limit_{c}" for c in limits.columns})
    same = F.col(lang_col).eqNullSafe(F.col(f"{prefix}limit_lang")) & F.col(source_col).eqNullSafe(F.col(f"{prefix}limit_source"))
    over = F.lit(False)
    for r in rules:
        over = over | F.coalesce((F.col(f"{prefix}{r.metric}") > F.col(f"{prefix}limit_{r.metric}_most")) & (F.col(f"{prefix}n_words") >= r.words), F.lit(False))
    out = feats.join(limits, same, "left").withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & ~over)
    return out.drop(*(f"{prefix}limit_{c}" for c in ["lang", "source", *(f"{r.metric}_most" for r in rules)]))


def apply(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns, whatever those are called.

    Every row is judged by itself, so repeated rows stay or go together. A null, empty or blank text goes. Null languages and
    sources are groups of their own. An empty table gives an empty result. Rows and features are written once, for the
    thresholds and for the verdicts.
    """
    prefix = "_quality_"
    feats = materialize(features(docs, text_col, prefix, least_words, most_repeated), "quality")
    limits = thresholds(feats, lang_col, source_col, prefix=prefix)
    return judge(feats, limits, lang_col, source_col, prefix).where(f"{prefix}kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of docs.

    A null, empty or blank text has counts of 0, fails the base rules and isn't kept. A null id stays null, null languages
    and sources are groups of their own, repeated rows give repeated results, other columns are ignored, and an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "lang", "source")
    rates = [r.metric for r in RULES]
    feats = materialize(features(rows).select("doc_id", "lang", "source", *BASE, "base_failed", *rates), "quality")
    return judge(feats, thresholds(feats)).select("doc_id", *BASE, "base_failed", "kept")
