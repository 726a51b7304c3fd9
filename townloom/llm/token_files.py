"""Token files: ids in patched frame-of-reference blocks, written and read by Spark."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townloom.llm.bytesops import text_bytes
from townloom.llm.wordcodes import batches_by_bytes, library_encoder, row_ids, worker_cache

BLOCK = 128  # ids in a block
PERCENTILE = 90  # the packed width holds this share of a block's differences; the others are exceptions
FILE_SCHEMA = "part int, segment int, doc_ids binary, doc_lengths binary, n_ids bigint, n_exceptions bigint, blocks binary"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits needed for each value below 2**32."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values, each of `width` bits, little-endian, as BLOCK / 8 * width bytes a row."""
    rows = len(values)
    bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits.reshape(rows, -1), axis=1, bitorder="little")


def unpack_bits(data: np.ndarray, width: int) -> np.ndarray:
    """Reads each value from the eight bytes around it."""
    rows = len(data)
    padded = np.concatenate([data, np.zeros((rows, 8), np.uint8)], axis=1)
    first = np.arange(BLOCK) * width
    words = np.zeros((rows, BLOCK), np.uint64)
    for k in range(5):
        words |= padded[:, first // 8 + k].astype(np.uint64) << np.uint64(8 * k)
    return ((words >> (first % 8).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, int]:
    """Patched frame-of-reference bytes of the ids, and the number of exceptions.

    Layout: number of ids and blocks (two unsigned 64-bit), then per block its start in the payload
    (unsigned 64-bit), minimum (unsigned 32-bit), width and number of exceptions (a byte each), then the
    payload: the low bits of all differences, then places (a byte each) and high parts (unsigned 32-bit) of
    the exceptions. The last block is filled up with its own minimum.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return struct.pack("<QQ", 0, 0), 0
    table = np.empty(blocks * BLOCK, np.uint32)
    table[:n] = ids
    table[n:] = ids[(blocks - 1) * BLOCK:].min()
    table = table.reshape(blocks, BLOCK)
    low = table.min(axis=1)
    rest = table - low[:, None]
    kth = BLOCK * PERCENTILE // 100 - 1
    width = bit_lengths(np.partition(rest, kth, axis=1)[:, kth])
    over = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    number = (over > 0).sum(axis=1)
    sizes = BLOCK // 8 * width + 5 * number
    starts = np.cumsum(sizes) - sizes
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            packed = pack_bits(rest[rows], w)
            payload[starts[rows][:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    at = (starts + BLOCK // 8 * width)[row]
    payload[at + nth] = place
    high = over[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    payload[(at + number[row] + 4 * nth)[:, None] + np.arange(4)] = high
    head = struct.pack("<QQ", n, blocks) + starts.astype("<u8").tobytes() + low.astype("<u4").tobytes()
    return head + width.astype(np.uint8).tobytes() + number.astype(np.uint8).tobytes() + payload.tobytes(), len(row)


def decode_blocks(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks `first` to `last` (exclusive; all by default), found through the block index."""
    n, blocks = struct.unpack_from("<QQ", data)
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(data, "<u8", blocks, 16).astype(np.int64)[first:last]
    low = np.frombuffer(data, "<u4", blocks, 16 + 8 * blocks)[first:last]
    width = np.frombuffer(data, np.uint8, blocks, 16 + 12 * blocks)[first:last].astype(np.int64)
    number = np.frombuffer(data, np.uint8, blocks, 16 + 13 * blocks)[first:last].astype(np.int64)
    payload = np.frombuffer(data, np.uint8, -1, 16 + 14 * blocks)
    out = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            out[rows] = unpack_bits(payload[starts[rows][:, None] + np.arange(BLOCK // 8 * w)], w)
    row = np.repeat(np.arange(last - first), number)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    at = (starts + BLOCK // 8 * width)[row]
    high = payload[(at + number[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    out[row, payload[at + nth]] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return (out + low[:, None]).reshape(-1)[:min(n, last * BLOCK) - first * BLOCK]


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Writes the ids of all texts, each followed by `end_id`, in ascending order of the document ids.

    The rows are range-partitioned by id; each task writes one Parquet file whose rows are segments of
    whole documents (about 8 MB of text, or one longer document): their ids, lengths and the encoded
    blocks. Parts are numbered in id order. Spark's writer commits a task's file once, so lost executors
    are replaced. Documents with the same id are ordered by the hash of their text; null ids come first.
    """
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("ids", tokenizer_path, library_encoder(tokenizer_path))
        part, segment = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in batches_by_bytes(offsets):
                ids, counts = row_ids(cache, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1
                doc_ids = batch.column(0).slice(i, j - i)
                known = np.asarray(doc_ids.is_valid())
                data, exceptions = encode_blocks(ids)
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "segment": segment, "n_ids": len(ids), "n_exceptions": exceptions, "blocks": data,
                    "doc_ids": np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes() + np.packbits(known).tobytes(),
                    "doc_lengths": counts.astype("<u8").tobytes()}],
                    schema=pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.binary()),
                                      ("doc_lengths", pa.binary()), ("n_ids", pa.int64()), ("n_exceptions", pa.int64()),
                                      ("blocks", pa.binary())]))
                segment += 1

    ordered = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn(
        "tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(shards, "id", "tie").sortWithinPartitions("id", "tie")
    ordered.select("id", "text").mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (uint32 bytes)."""
    files = spark.read.parquet(path)
    # one row per segment, not per document; the running total goes over parts first
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    part_start = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    heads = files.select("part", "segment", "n_ids").join(part_start, "part")
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    starts = heads.select("part", "segment", (F.col("part_start") + within).alias("segment_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["doc_lengths"], "<u8").astype(np.int64)
                keys = np.frombuffer(row["doc_ids"], "<i8", len(counts))
                null = ~np.unpackbits(np.frombuffer(row["doc_ids"], np.uint8, -1, 8 * len(counts)))[:len(counts)].astype(bool)
                data = decode_blocks(row["blocks"]).astype("<u4").tobytes()
                first = np.cumsum(counts) - counts
                ids = [data[4 * a:4 * (a + n)] for a, n in zip(first.tolist(), counts.tolist())]
                yield pa.record_batch([pa.array(keys, mask=null), pa.array(first + row["segment_start"]), pa.array(counts),
                                       pa.array([zlib.crc32(b) for b in ids], pa.int64()), pa.array(ids, pa.binary())],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    rows = files.select("part", "segment", "doc_ids", "doc_lengths", "blocks").join(starts, ["part", "segment"])
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
