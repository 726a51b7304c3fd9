"""Session helpers: configuration, lineage cuts and size checks."""

from __future__ import annotations

import os
import tempfile
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A frame whose estimated size is below this fits into one task or one broadcast.
SMALL_BYTES = 32 * 1024 * 1024


def build_session(app: str = "townloom", cpus: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session is given."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; in local mode a temporary one if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame reliably and forget how it was computed."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """As cut, for the tables of a loop; also forgets the estimate of their size.

    A checkpoint keeps the optimizer's estimate, and a join's is the product of its sides: in a loop that joins a
    table with itself the number of digits doubles every round, until the estimate takes longer than the job.
    """
    spark, kept = df.sparkSession, cut(df)
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)


def worked_out(df: DataFrame) -> DataFrame:
    """The same rows with every column worked out in one place.

    A filter stays above an inline. Below it, a filter would hold the expressions of its columns many times over, and be
    worked out in the few tasks of a small scan.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def by_size(rows: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys that hold at most `limit` rows, and those of the other keys, if there are any."""
    crowded = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*keys))
    if crowded.isEmpty():
        return rows, None
    return rows.join(crowded, keys, "left_anti"), rows.join(crowded, keys, "left_semi")


def columns_of(df: DataFrame, same: list[str], **named: str) -> str:
    """A schema of columns as they are in the frame, and of new ones typed like a column of it."""
    of = lambda c: df.schema[c].dataType.simpleString()
    return ", ".join([f"`{c}` {of(c)}" for c in same] + [f"`{new}` {of(c)}" for new, c in named.items()])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, reachable by all executors."""
    import uuid

    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate. Runs no job."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    return estimated_bytes(df) <= limit


def fan_out(df: DataFrame, *columns: str) -> DataFrame:
    """Few rows that expand into much work, spread over the session's shuffle partitions.

    The count is explicit, so adaptive execution does not fold the small rows into one task.
    """
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")),
            4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)


def spread_scan(df: DataFrame) -> DataFrame:
    """A scan of fewer file splits than cores, spread over the cores. Larger scans are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def followed(rows: DataFrame, k: list[str], follow, **columns: str) -> DataFrame:
    """What `follow` makes of the rows of each key, keys of bounded size one after the other in Arrow batches.

    It turns arrays by column into arrays by new column; `columns` names, for each of these, the column of `rows` that
    has its type, or double. Only the rows of a batch and of one key are held.
    """
    kind = lambda c: c if c == "double" else rows.schema[c].dataType.simpleString()
    schema = ", ".join([f"`{c}` {kind(c)}" for c in k] + [f"`{new}` {kind(c)}" for new, c in columns.items()])
    values = [c for c in rows.columns if c not in k]

    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            parts = [t for t in (held, None if batch is None else pa.Table.from_batches([batch])) if t is not None and len(t)]
            if not parts:
                continue
            table = pa.concat_tables(parts)
            fresh = np.zeros(len(table), bool)
            fresh[0] = True
            for c in k:
                key = table[c].to_numpy()
                fresh[1:] |= key[1:] != key[:-1]
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(table))
            if batch is not None:  # the last key may go on
                held, starts, ends = table.slice(starts[-1]), starts[:-1], ends[:-1]
            if not len(starts):
                continue
            arrays = {c: table[c].to_numpy() for c in values}
            found = [follow({c: v[i:j] for c, v in arrays.items()}) for i, j in zip(starts.tolist(), ends.tolist())]
            at = pa.array(np.repeat(starts, [len(f[next(iter(columns))]) for f in found]))
            made = [pa.array(np.concatenate([f[new] for f in found]), pa.float64() if c == "double" else table.schema.field(c).type)
                    for new, c in columns.items()]
            yield pa.record_batch([*(table[c].combine_chunks().take(at) for c in k), *made], names=[*k, *columns])

    return fan_out(rows, *k).sortWithinPartitions(*k).mapInArrow(run, schema)
