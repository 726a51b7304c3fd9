"""Bounded labelled samples for classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 20_000  # labelled documents that a classifier learns from, at most


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int,
                    limit: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, text, y) of at most `limit` labelled documents outside the held-out fold, in hash order.

    The sample of labels is bounded by `limit`, so it is broadcast. Ids with several labels take the mean,
    rounded; null labels and ids are left out.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).alias("y")).where(
        F.col("y").isNotNull() & F.col("label_id").isNotNull() & (fold(F.col("label_id"), folds) != held))
    known = known.groupBy("label_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select(
        "doc_id", "text", "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
