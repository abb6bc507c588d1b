"""From raw documents to token files, in five stages.

Each stage takes what its predecessor kept and returns the documents it keeps; the last returns the documents' places in the
token files. A repeated document of the mix is a repeated row.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mercantile.llm import decontamination, mixing, near_dedup, quality, token_files
from mercantile.llm.tables import scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return quality.keep_scored(docs, quality.train_on(docs, quality.learnable(table(spark, sf_dir, "labels"))))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each class of near-duplicates."""
    return near_dedup.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it. A document weighs what the quality classifier, fitted on these documents, scores it."""
    model = quality.train_on(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return mixing.repeat_mixed(docs, lambda data, at: model.score(quality.statistics(data, at)))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids are in the token files, and their checksum, read back from the files."""
    return token_files.read_documents(token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_ids),
]

#: A fitted classifier and a tokenizer are no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored and read again."""
    store = scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.store(stage(spark, docs, sf_dir), name.split()[0].replace("/", "-") + "-" + uuid.uuid4().hex[:6])
    return docs
