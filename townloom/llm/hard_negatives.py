"""Hard negatives by a secondary sort.

Pair scores are packed into keys (anchor, descending score, kind, id). A shuffle deals them by anchor and
sorts them within its partitions, on disk if need be; an iterator then reads an anchor's pairs from the
highest score down, opens a window at every positive and hands each negative to the windows it falls into.
Its state is a few open windows, however many pairs an anchor has.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townloom.session import cut

BLOCK_ROWS = 2048  # candidates in a block
ANCHOR_ROWS = 2048  # anchors in a block
SLICE_ROWS = 256  # anchors of a block whose scores are looked at together
TASK_BYTES = 32 << 20  # vectors of the candidates that a task holds
ADDED_ROWS = 1 << 18  # pairs that wait to be merged with the best so far
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
KEY = ">QQBQ"
KEY_TYPE = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
SIGN = 1 << 63
POSITIVE, NEGATIVE = 0, 1


def sound_vectors(df: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vec): one sound row for each id, components floor(scale * x)."""
    x = F.col(vec_col)
    whole = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.where(F.coalesce(whole, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.struct(
            F.col(label_col).cast("long").alias("label"),
            F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vec")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.vec")


def blocks_of(df: DataFrame, block: Column, parts: int, dims: int, *more: str) -> DataFrame:
    """One row for each value of `block`, in so many partitions: arrays of ids and labels (and others), and the vectors one after the other."""
    vec = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("vec")))
    rows = df.select(block.alias("block"), F.struct("vec_id", "label", vec.alias("vec"), *more).alias("row"))
    packed = rows.repartition(parts, "block").groupBy("block").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # about as many rows as aimed at
    return packed.select("block", F.col("rows.vec_id").alias("ids"), F.col("rows.label").alias("labels"),
                         F.flatten("rows.vec").alias("vecs"), *(F.col(f"rows.{c}").alias(c) for c in more))


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of integers as the shortest numbers that hold every partial sum of their inner products."""
    longest = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    top = longest(a) * longest(b) * (1 + 1e-9)  # no sum of absolute products is larger
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    return a.astype(kind), b.astype(kind)


class First:
    """The k first pairs, by score from the highest, then id, of every list; `floor` is the k-th score of full lists."""

    def __init__(self, lists: int, k: int):
        self.k, self.floor = k, np.full(lists, LEAST)
        self.held, self.waiting, self.more = tuple(np.zeros(0, np.int64) for _ in range(3)), [], 0

    def add(self, *pairs: np.ndarray) -> None:
        """Lists, scores and ids of pairs."""
        self.waiting.append(pairs)
        self.more += len(pairs[0])
        if self.more > ADDED_ROWS:
            self.merge()

    def merge(self) -> None:
        lists, score, ids = (np.concatenate(x) for x in zip(self.held, *self.waiting))
        order = np.lexsort((ids, ~score, lists))
        lists, score, ids = lists[order], score[order], ids[order]
        nth = np.arange(len(lists)) - np.searchsorted(lists, lists)
        last = nth == self.k - 1
        self.floor[lists[last]] = score[last]
        self.held, self.waiting, self.more = tuple(x[nth < self.k] for x in (lists, score, ids)), [], 0


def packed_keys(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys whose order as bytes is anchor, score from the highest, positives first, id."""
    keys = np.empty(len(anchor), KEY_TYPE)
    keys["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN)
    keys["score"] = ~(score.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN))
    keys["kind"] = kind
    keys["id"] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN)
    return pa.Array.from_buffers(pa.binary(KEY_TYPE.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, i = struct.unpack(KEY, key)
    return anchor - SIGN, (score ^ (2 * SIGN - 1)) - SIGN, kind, i - SIGN


class Positives:
    """The k best candidates of its label for each anchor of a block."""

    kind = POSITIVE

    def __init__(self, anchors: dict[str, np.ndarray], k: int):
        self.anchors, self.lists, self.first = anchors, 1, First(len(anchors["ids"]), k)

    def meet(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> None:
        a, (own, vecs) = self.anchors, exact(self.anchors["vecs"], vecs)
        for i in range(0, len(a["ids"]), SLICE_ROWS):
            s = own[i:i + SLICE_ROWS] @ vecs.T
            good = (a["labels"][i:i + SLICE_ROWS, None] == labels[None, :]) & (s >= self.first.floor[i:i + SLICE_ROWS, None].astype(s.dtype))
            row, col = np.divmod(np.flatnonzero(good), s.shape[1])
            other = a["ids"][row + i] != ids[col]
            row, col = row[other], col[other]
            self.first.add(row + i, s[row, col].astype(np.int64), ids[col])
        self.first.merge()

    def keys(self) -> pa.Array:
        lists, score, ids = self.first.held
        row = lists // self.lists
        order = np.lexsort((ids, row))  # a negative may be in more than one window
        row, score, ids = row[order], score[order], ids[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
        return packed_keys(self.anchors["ids"][row[fresh]], score[fresh], self.kind, ids[fresh])


class Negatives(Positives):
    """The k best candidates of other labels within the window of each positive of each anchor of a block."""

    kind = NEGATIVE

    def __init__(self, anchors: dict[str, np.ndarray], goals: pa.ListArray, k: int, low: int, high: int):
        offsets = np.asarray(goals.offsets).astype(np.int64)
        flat, n = np.asarray(goals.flatten()), np.diff(offsets)
        self.anchors, self.lists = anchors, max(int(n.max(initial=0)), 1)
        at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], n)
        self.low, self.high = np.full((len(n), self.lists), MOST), np.full((len(n), self.lists), LEAST)
        row = np.repeat(np.arange(len(n)), n)
        self.low[row, at], self.high[row, at] = -(-low * flat // 100), high * flat // 100
        self.first = First(self.low.size, k)

    def meet(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> None:
        a, (own, vecs) = self.anchors, exact(self.anchors["vecs"], vecs)
        low = np.maximum(self.low, self.first.floor.reshape(self.low.shape))
        for i in range(0, len(a["ids"]), SLICE_ROWS):
            s = own[i:i + SLICE_ROWS] @ vecs.T
            least = low[i:i + SLICE_ROWS].min(axis=1).astype(s.dtype)
            some = np.flatnonzero(s.max(axis=1, initial=LEAST) >= least)
            row, col = np.divmod(np.flatnonzero(s[some] >= least[some, None]), s.shape[1])
            row = some[row] + i
            other = a["labels"][row] != labels[col]
            row, col = row[other], col[other]
            score = s[row - i, col].astype(np.int64)
            for nth in range(self.lists):
                good = (score >= low[row, nth]) & (score <= self.high[row, nth])
                self.first.add(row[good] * self.lists + nth, score[good], ids[col[good]])
        self.first.merge()


def kept_pairs(anchors: DataFrame, blocks: DataFrame, dims: int, start) -> DataFrame:
    """Keys of the pairs that are kept of each block of anchors and the blocks of candidates that a task holds.

    Every block of anchors meets every block of candidates in a nested loop over partitions, so nothing is shuffled.
    """
    pairs = anchors.select(*(F.col(c).alias("a_" + c) for c in anchors.columns)).hint("shuffle_replicate_nl").crossJoin(blocks)
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            column = dict(zip(names, batch.columns))
            of = lambda c, i: np.asarray(column[c][i].values)
            for i in range(len(batch)):
                if held is None or column["a_block"][i].as_py() != at:
                    if held is not None:
                        yield pa.record_batch([held.keys()], names=["key"])
                    at = column["a_block"][i].as_py()
                    own = {"ids": of("a_ids", i), "labels": of("a_labels", i), "vecs": of("a_vecs", i).reshape(-1, dims)}
                    held = start(own, column["a_goals"][i].values if "a_goals" in column else None)
                held.meet(of("ids", i), of("labels", i), of("vecs", i).reshape(-1, dims))
        if held is not None:
            yield pa.record_batch([held.keys()], names=["key"])

    return pairs.mapInArrow(run, "key binary")


def windows(pairs: Iterator[tuple[bytes, None]], positives: int, negatives: int, low: int, high: int):
    """Reads sorted keys; yields (anchor, positive, rank, negative, positive score, negative score)."""
    last, opened, seen = None, [], 0
    for key, _ in pairs:
        anchor, score, kind, i = unpacked(key)
        if anchor != last:
            last, opened, seen = anchor, [], 0
        if kind == POSITIVE:
            if seen < positives:
                opened.append([i, score, 0])
                seen += 1
            continue
        # scores only fall: a window whose lower end is passed, or that is full, is closed for good
        opened = [o for o in opened if o[2] < negatives and low * o[1] <= 100 * score]
        for o in opened:
            if 100 * score <= high * o[1]:
                o[2] += 1
                yield anchor, o[0], o[2], i, o[1], score


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the integer inner product of vectors of floor(scale * x). An anchor's positives are the
    first `positives` other rows of its label, by score, then smaller id. For each, the first `negatives`
    rows of other labels with low * positive_score <= 100 * score <= high * positive_score are returned, in the same
    order. `high` is at most 100, since a window opens at its positive.

    Rows without an id, label or vector, or with a null or non-finite component, take no part. Of
    different rows under one id the one with the smallest label, then vector, counts, once. Shorter vectors count as
    filled up with zeros. Anchors whose label no other row has, and empty tables, give no rows.

    Blocks of anchors meet blocks of candidates twice: first for positives, at most `positives` an anchor
    and task, then for negatives, at most `negatives` a window and task. Only these are shuffled, so an anchor's
    share of the sort grows with the number of tasks and not with that of rows.
    """
    if high > 100:
        raise ValueError("a window ends at its positive: high is at most 100")
    spark = rows.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    every = cut(sound_vectors(rows, scale, id_col, vec_col, label_col))
    asked = cut(sound_vectors(anchors, scale, id_col, vec_col, label_col))
    size = every.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    ask = asked.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    if not size.n or not ask.n:
        return spark.createDataFrame([], schema)
    dims = max(size.dims, ask.dims, 1)
    shards = max(-(-size.n // BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, -(-size.n // 256)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-size.n * dims * 8 // TASK_BYTES), min(cores, shards))
    blocks = cut(blocks_of(every, deal(shards), parts, dims).drop("block")).coalesce(parts)
    groups = -(-ask.n // ANCHOR_ROWS)
    ways = min(groups, -(-4 * cores // parts))
    near = kept_pairs(cut(blocks_of(asked, deal(groups), ways, dims)).coalesce(ways), blocks, dims, lambda own, _: Positives(own, positives))
    field = lambda at: F.substring("key", at, 8)
    # per task the best are known; of all tasks the first by key are the anchor's positives
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy("key"))
    near = cut(near.withColumn("anchor", field(1)).withColumn("nth", nth).where(F.col("nth") <= positives).drop("nth"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpacked(k) for k in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                                  names=["vec_id", "goal"])

    goals = near.select("key").mapInArrow(decoded, "vec_id bigint, goal bigint").groupBy("vec_id").agg(
        F.array_sort(F.collect_list("goal")).alias("goals"))  # at most `positives` each
    ready = cut(blocks_of(asked.join(goals, "vec_id"), deal(groups), ways, dims, "goals")).coalesce(ways)
    far = kept_pairs(ready, blocks, dims, lambda own, wanted: Negatives(own, wanted, negatives, low, high))
    keys = near.select("key").union(far).rdd.map(lambda r: (bytes(r.key), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionAndSortWithinPartitions(parts, lambda k: zlib.crc32(k[:8]) % parts)
    return spark.createDataFrame(dealt.mapPartitions(lambda it: windows(it, positives, negatives, low, high)), schema)
