"""The corpus pipeline: quality rules, language ID, near-dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, what its predecessor kept; all but the last return
the columns of documents. Repeated rows are judged alike, other columns are carried along, and an empty table gives an
empty result. run() writes each stage's rows in the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import crf_lang, minhash, packing, quality, secrets
from strataloom.llm.shared import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's thresholds.

    The base rules are wide here, because a short text, or one that repeats a line, can be clean. Null and blank texts go.
    """
    return quality.apply(docs, least_words=1, most_repeated=60)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, labelled with it. Where no document has a label, all stay as they are."""
    return crf_lang.keep(docs, crf_lang.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    Rows without an id or a word stay.
    """
    return minhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark. A null text stays null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens. A null text is its end id alone."""
    import public_tokenizers

    # Workers share their executor with a heap that the stages before have filled, so they take less here than in a job of its own.
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), most_chunks=250_000, most_bytes=1 << 20)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Tokens, posteriors and signatures are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
