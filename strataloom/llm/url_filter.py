"""URL filter: host and path rules, else logistic regression on hashed character n-grams. DataFrame and SQL functions only.

The labelled table is small and bounded (`MOST_LABELS`); the n-grams of host and path are hashed to a fixed number of
features, and the fitted model is one weight for each, so nothing that goes to the driver follows the pages.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 14
GRAMS = (3, 4, 5)
MOST_LABELS = 10_000

# Words of hosts and paths to block or to allow, the forms they take, and the shapes of URLs.
BLOCK_WORDS = ["casino", "poker", "betting", "slots", "porn", "xxx", "escort", "viagra", "pills", "torrent", "warez", "crack", "keygen", "malware", "phish", "payday", "loans", "replica", "spam", "hacked"]
ALLOW_WORDS = ["news", "wiki", "docs", "blog", "science", "library", "school", "museum", "recipes", "history", "garden", "travel", "weather", "music", "books", "health", "sports", "code", "forum", "example"]
FORMS = ["{w}", "{w}s", "my{w}", "{w}24", "best-{w}"]
SHAPES = ["https://{w}.site.com/", "http://www.{w}.net/home", "https://{w}-online.org/page/7", "http://m.site.net/{w}/index.html", "https://blog.{w}.info/2020/05/post?id=3", "http://shop.org/de/{w}#top", "https://cdn.site.io/a/b/{w}.php", "http://{w}.example.net"]


def default_labels(spark: SparkSession, held_out: bool | None = None) -> DataFrame:
    """(url, label) of the default table, made by rule: forms of words in shapes, and URLs with a word of each list in host
    and path, which are to block. label 1 is to block. held_out gives a fixed fifth of the table, or all but that."""
    rows = [(s.format(w=f.format(w=w)), label) for label, words in ((1.0, BLOCK_WORDS), (0.0, ALLOW_WORDS)) for w in words for f in FORMS for s in SHAPES]
    for i, bad in enumerate(BLOCK_WORDS):
        for j, good in enumerate(ALLOW_WORDS):
            if (i + j) % 4 == 0:
                rows += [(f"https://{bad}.site.com/{good}/{i}", 1.0), (f"http://{good}.site.org/{bad}/{j}", 1.0), (f"http://{good}.site.org/{ALLOW_WORDS[i]}/{j}", 0.0)]
    held = [i % 5 == 2 for i in range(len(rows))]
    return spark.createDataFrame([r for r, h in zip(rows, held, strict=True) if held_out in (None, h)], "url string, label double")


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: after the first ://, up to / ? # or the end, lower-cased; then up to ? # or the end. Else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and of path; the two never mix."""

    def of(tag: str, text: Column) -> list[Column]:
        # A mark at both ends lets the model tell the start of a label from its inside.
        text = F.concat(F.lit("^"), text, F.lit("$"))
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.concat(F.lit(tag), F.substring(text, i, n)))
        return [F.when(F.length(text) >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in GRAMS]

    return F.concat(*of("h:", host), *of("p:", path))


def _vectors(urls: DataFrame) -> DataFrame:
    host, path = parts(F.col("url").cast("string"))
    rows = urls.withColumns({"url_host_": host, "url_path_": path})
    rows = rows.withColumn("url_grams_", grams(F.col("url_host_"), F.col("url_path_")))
    return HashingTF(inputCol="url_grams_", outputCol="url_features_", numFeatures=FEATURES, binary=True).transform(rows)


def train(labels: DataFrame, strength: float = 0.002, rounds: int = 60) -> LogisticRegressionModel:
    """The regression of labels (url, label), at most MOST_LABELS rows; null labels are left out."""
    rows = labels.select("url", F.col("label").cast("double").alias("label")).where("label is not null")
    n = rows.count()
    if not 0 < n <= MOST_LABELS:
        raise ValueError(f"the labelled table has {n} rows; 1 to {MOST_LABELS} are needed")
    rows = _vectors(rows).coalesce(1)
    return LogisticRegression(featuresCol="url_features_", labelCol="label", regParam=strength, maxIter=rounds, standardization=False).fit(rows)


def _rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a (length, rule, verdict) struct; null where none does."""
    fits = []
    for verdict, rule in rules:
        own, _, rest = rule.partition("/")
        inside = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        fits.append(F.when(inside, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<length: int, rule: string, verdict: string>")


def ruled(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, rule_verdict) for each row of pages; the last two are null where no rule fits.

    rules are (verdict, host/path prefix); a rule fits its host and all subdomains, and the longest wins. A null url or one
    without :// has an empty host and path and no rule. Repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty result.
    """
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("fit", _rule(F.col("host"), F.col("path"), rules))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("rule_verdict"))


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", cut: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for each row of pages.

    Rules, nulls, repeated rows and empty tables are as in ruled(). Without a rule the verdict is `block` where the model's
    probability is over `cut`.
    """
    rows = _vectors(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")))
    rows = model.setProbabilityCol("url_chance_").setRawPredictionCol("").setPredictionCol("").transform(rows)
    score = vector_to_array("url_chance_")[1]
    rows = rows.select("page_id", F.col("url_host_").alias("host"), F.col("url_path_").alias("path"), F.round(score, 6).alias("block_score"))
    rows = rows.withColumn("fit", _rule(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("block_score") > cut, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_model).alias("verdict"), "block_score")
