import os

import pytest

import corpus_pipeline
from strataloom.llm import minhash

from .data import edge_docs, empty_docs

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_in_order(spark):
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_dedup", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert out.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").where("doc_id is not null").count() == 0, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_run_equals_the_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
    want = {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.start, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_an_unlabelled_corpus_stays(spark):
    prose = "the water of this house was there when night came and eight would go"
    docs = spark.createDataFrame([(i, f"{prose} {i}", None, None, 60) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, "")
    assert docs.count() == 60


def test_one_of_each_group_stays(spark):
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).where("doc_id is not null").collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").where("doc_id is not null").collect()}
    assert kept == set(groups.values())


def test_clean_labelled_documents_stay(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.language_id):
        kept = stage(spark, docs, SMALL).join(clean.select("doc_id"), "doc_id", "left_semi").count()
        assert kept >= 0.97 * clean.count()
