from collections import Counter

from pyspark.sql import functions as F

from strataloom.llm import quality

from .data import edge_docs, empty_docs, words_of


def base(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(5)}
    out = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*out, len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_base_features_and_edge_cases(spark):
    docs = edge_docs(spark)
    rows = quality.report(docs).collect()
    want = Counter((r.doc_id, *base(r.text)) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.report(empty_docs(spark)).count() == 0 and quality.apply(empty_docs(spark)).count() == 0
    kept = quality.apply(docs)
    assert kept.columns == docs.columns


def test_thresholds_adapt_to_the_group(spark):
    prose = " ".join(f"w{i % 37}x{i}" for i in range(50))
    rows = [(i, prose + " #" * (12 if s == "noisy" else 0), "en", s) for s in ("noisy", "calm") for i in range(150)]
    rows += [(1000, prose + " #" * 12, "en", "calm"), (1001, prose + " #" * 12, "en", "noisy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.report(docs).where("doc_id >= 1000").collect()}
    assert kept == {1000: False, 1001: True}


def test_bounds_come_from_the_group_alone(spark):
    clean, noisy = "calm words stand here in one plain line of text now", "calm words & stand & here & in # one line of text now"
    rows = [(i, clean + f" {i}", "en", "clean") for i in range(120)] + [(500 + i, noisy + f" {i}", "en", "noisy") for i in range(120)]
    rows += [(1000, clean + " #", "en", "clean"), (1001, clean + " # #", "en", "clean"), (1002, noisy + " 7", "en", "noisy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    feats = quality.features(docs)
    limits = {r.source: r for r in quality.thresholds(feats).collect()}
    assert limits["clean"].symbol_rate_most == 0 < limits["noisy"].symbol_rate_most
    assert limits["clean"].dup_rate_most == limits["clean"].repeat_rate_most == 0
    # One symbol never condemns, two do in a group that has none, and as many as its group has don't.
    assert {r.doc_id: r.kept for r in quality.report(docs).where("doc_id >= 1000").collect()} == {1000: True, 1001: False, 1002: True}


def test_sketches_merge_to_the_coarser_group(spark):
    rows = [(i, " ".join(f"a{i}b{j}" for j in range(20)), "en", f"s{i}") for i in range(30)]
    feats = quality.features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    limits = quality.thresholds(feats, min_group=10).collect()
    assert len(limits) == 30 and len({r.mean_word_most for r in limits}) == 1


def test_buckets_hold_their_values(spark):
    rows = spark.range(0, 70_000, 37).select(F.col("id").alias("v"), quality._bucket(F.col("id")).alias("b")).withColumn("top", quality._bounds("b")[1]).withColumn("bottom", quality._bounds("b")[0])
    bad = rows.where((F.col("top") < F.col("v")) | (F.col("top") > F.col("v") * 1.0626 + 1))
    assert bad.count() == 0
    assert rows.where("bottom > v or top < v or bottom < v / (1 + 1/64.0) - 1").count() == 0
    assert rows.where("top > 128 and top > v * (1 + 1/64.0) + 1").count() == 0


def test_plan_has_no_python(spark):
    plan = quality.report(edge_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
