"""Stages that turn ``documents`` into token ids; each one's output is written as Parquet and read as the next one's input.

Documents that the quality classifier rejects go, then all but one of equal texts, all but one of near duplicates, and documents
that hold benchmark passages. The last stage gives each document's ids and the digest of the bytes that they decode to.

Defined cases, beyond those of the operators' modules: all stages but the last keep every column of ``documents``, whatever its name; rows are told apart by id and text, a null text counting as the
empty one, so rows of one id with different texts are judged apart; null and empty texts go through each stage as texts without words (the classifier scores them, exact dedup leaves one, near-duplicate
detection links them, the benchmark doesn't match them) and have no ids; texts of any length are read whole; rows without an id are never dropped as near copies; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgauge.llm import bpe, decontamination, exact_dedup, quality, simhash
from tabgauge.llm.common import discard, read, small_batches, written
from tabgauge.llm.queries import learnable


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the stage's input, accepts."""
    small_batches(spark)
    return quality.keep_good(docs, quality.train(docs, learnable(spark, sf_dir)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: of each SimHash component (4 of 64 bits) that with the smallest id, and of what is left none that has a
    Jaccard similarity of 0.8 or more, over shingles of five words, with a document of smaller id that stays."""
    small_batches(spark)
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the bytes that the ids decode to."""
    small_batches(spark)
    found = bpe.decode(bpe.encode(docs))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", good), ("exact_dedup", exact), ("simhash_near_dedup", near), ("benchmark_decontamination", clean), ("byte_level_bpe", tokens)]

#: Learned models and byte-pair merges have no SQL form; tests/llm compares the pipeline with a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)  # nothing reads it any more
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
