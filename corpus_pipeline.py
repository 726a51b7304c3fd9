"""The corpus pipeline: quality, near copies, benchmark items, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from townloom.llm.decontamination import drop_contaminated
from townloom.llm.jaccard_join import one_of_each
from townloom.llm.packing import pack_documents
from townloom.llm.pii import pseudonymize
from townloom.llm.quality import keep_good
from townloom.llm.queries import PSEUDONYM_KEY, table
from townloom.session import scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled documents of the corpus."""
    return keep_good(docs, docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group linked by five-word shingles at 0.8 or more."""
    return one_of_each(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal numbers, dates, addresses and keys are pseudonyms of the same format."""
    return pseudonymize(docs, PSEUDONYM_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 4096."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near_copies", without_near_copies), ("decontamination", without_benchmark),
          ("pii", with_pseudonyms), ("packing", packed)]

# The classifier, the tokenizer and the pseudonyms have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
