"""Incremental intake of districts and label overrides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_intake(spark: SparkSession, source: str, schema, pattern: str, summarise: Callable[
        [DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 1000
        ) -> None:
    """Files that arrive in a folder are summarised and stored, each batch exactly once.

    A batch writes its own folder named after the batch number and replaces it when repeated,
    so a restart after a lost driver neither doubles nor drops a batch. `checkpoint` must be the
    same folder at every start of the same intake.
    """
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
              .option("maxFilesPerTrigger", files_per_batch).parquet(source))

    def store(batch: DataFrame, number: int) -> None:
        summarise(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (stream.writeStream.foreachBatch(store).trigger(availableNow=True)
             .option("checkpointLocation", checkpoint).start())
    query.awaitTermination()


def merged_counts(spark: SparkSession, target: str, keys: list[str], value: str) -> DataFrame:
    """The corpus table: additive summaries of all batches added up."""
    return spark.read.parquet(target).groupBy(*keys).agg(F.sum(value).alias(value))


def latest_label(overrides: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """The last confirmed label per district in an override log."""
    return overrides.groupBy(key).agg(F.max_by(label, F.struct(*order)).alias(label))


def apply_overrides(labels: DataFrame, overrides: DataFrame, key: str, label: str) -> DataFrame:
    """Confirmed labels where there are any, the given ones otherwise."""
    o = overrides.select(key, F.col(label).alias("_o"))
    return labels.join(o, key, "left").withColumn("confirmed", F.col("_o").isNotNull()).withColumn(
        label, F.coalesce("_o", label)).drop("_o")
