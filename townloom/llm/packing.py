"""Best-fit packing of documents into sequences after a dominance reduction of the instance."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townloom.llm.bytesops import text_bytes
from townloom.llm.wordcodes import batches_by_bytes, library_encoder, row_ids, worker_cache
from townloom.session import cut

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token pieces of every text: ids, then `end_id`, cut every `capacity` tokens.

    With `keep_ids` each piece also carries its ids, little-endian unsigned 32-bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("ids", tokenizer_path, library_encoder(tokenizer_path))
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            doc_ids = batch.column(0)
            for i, j in batches_by_bytes(offsets):
                ids, counts = row_ids(cache, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype("<u4"), counts + 1
                per = -(-counts // capacity)
                row = np.repeat(np.arange(j - i), per)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(capacity, counts[row] - start)
                at = (np.cumsum(counts) - counts)[row] + start
                data = ids.tobytes()
                blobs = [data[4 * a:4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
                columns = [doc_ids.take(pa.array(row + i)), pa.array(piece.astype(np.int32)), pa.array(start),
                           pa.array(length), pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(blobs, pa.binary()))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


@dataclass
class Pattern:
    """`count` sequences that hold pieces of these lengths, one after the other."""

    count: int
    lengths: tuple[int, ...]


def reduce_dominated(counts: list[int], capacity: int) -> list[Pattern]:
    """Fix sets that dominate every other set with their largest piece; `counts` keeps the rest.

    Taking the lengths from the largest down, a length L is settled
      - alone, if nothing that is left fits beside it;
      - with the one length that fills the sequence, since any other company of L could change places with it;
      - with the largest length that fits, if no two of the pieces that are left fit beside L together;
      - with the largest length that fits, if at most two fit together and no two of them weigh more than it.
    """
    fixed: list[Pattern] = []
    there = [n for n in range(1, capacity + 1) if counts[n]]

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append(Pattern(times, lengths))
        for n in lengths:
            counts[n] -= times
            if not counts[n]:
                there.pop(bisect_left(there, n))

    def smallest(k: int, without: int) -> list[int]:
        """The k smallest pieces that are left beside one piece of length `without`."""
        out: list[int] = []
        for n in there:
            out += [n] * min(k, counts[n] - (n == without))
            if len(out) >= k:
                break
        return out[:k]

    for n in range(capacity, 0, -1):
        while counts[n]:
            room = capacity - n
            low = smallest(3, n)
            if not low or low[0] > room:
                lone = counts[n] if not (low and low[0] == n) or 2 * n > capacity else 1
                take((n,), lone)
                continue
            mate = there[bisect_left(there, room + 1) - 1]
            if mate == n and counts[n] == 1:
                at = bisect_left(there, n) - 1
                mate = there[at] if at >= 0 else 0
            times = counts[n] // 2 if mate == n else min(counts[n], counts[mate])
            if mate == room or len(low) == 1 or low[0] + low[1] > room:
                # while copies of n run out, the smallest pieces only get larger: the condition keeps holding
                take((n, mate), times)
            elif (len(low) == 2 or sum(low) > room) and best_pair(there, counts, room, n) <= mate:
                take((n, mate), 1)
            else:
                break
    return fixed


def best_pair(there: list[int], counts: list[int], room: int, without: int) -> int:
    """The largest total of two pieces that are left and fit the room together; 0 if none do."""
    free = {n: counts[n] - (n == without) for n in there}
    usable, best = [n for n in there if free[n] and n < room], 0
    low, high = 0, len(usable) - 1
    while low <= high:
        a, b = usable[low], usable[high]
        if a + b > room or low == high and free[a] < 2:
            high -= 1
        else:
            best = max(best, a + b)
            low += 1
    return best


def best_fit(counts: list[int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over lengths with multiplicities; sequences with equal contents move together."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, lengths: tuple[int, ...]) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((times, lengths))

    for n in range(capacity, 0, -1):
        left = counts[n]
        while left:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                times, lengths = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
                used = min(times, left)
                if used < times:
                    put(room, times - used, lengths)
                put(room - n, used, lengths + (n,))
                left -= used
            else:
                per = capacity // n
                full = left // per
                if full:
                    put(capacity - per * n, full, (n,) * per)
                    left -= full * per
                if left:
                    put(capacity - left * n, 1, (n,) * left)
                    left = 0
    return [Pattern(times, lengths) for group in by_room.values() for times, lengths in group]


def plan_runs(counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank, sequence of the first rank, offset) that place all pieces.

    The pieces of one length are interchangeable, so the plan speaks of their ranks only. Its size depends
    on `capacity`, not on the number of pieces.
    """
    counts = list(counts)
    patterns = reduce_dominated(counts, capacity)
    patterns += best_fit(counts, capacity)
    runs, used, sequence = [], [0] * (capacity + 1), 0
    for p in patterns:
        offset = 0
        for n in p.lengths:
            runs.append((n, used[n], used[n] + p.count - 1, sequence, offset))
            used[n] += p.count
            offset += n
        sequence += p.count
    return runs


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), filling few sequences.

    The driver sees only how many pieces each length has: at most `capacity` numbers. Sets that dominate
    are fixed on that histogram and the rest is packed best-fit. Pieces then take places by their rank
    within their length, counted in two steps so that a common length is spread over all tasks.
    Every length must be between 1 and `capacity`. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # 'cut' fixes the rows, so the histogram and the ranks see the same ones
    pieces = cut(pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * shards)).cast("int")))
    sizes = pieces.groupBy("length", "shard").count()
    histogram = [0] * (capacity + 1)
    for row in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        histogram[row.length] = row.n
    runs = spark.createDataFrame(plan_runs(histogram, capacity),
                                 "run_length bigint, low bigint, high bigint, base bigint, offset bigint")
    before = sizes.select("length", "shard", (F.sum("count").over(
        Window.partitionBy("length").orderBy("shard")) - F.col("count")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("local", local - 1).join(before, ["length", "shard"]).withColumn(
        "rank", F.col("local") + F.col("before"))
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length"))
                         & F.col("rank").between(F.col("low"), F.col("high")))
    kept = [c for c in pieces.columns if c != "shard"]
    return placed.select(*kept, (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
                   keep_ids: bool = False) -> DataFrame:
    """Packs whole documents into sequences of at most `capacity` tokens.

    Only documents longer than `capacity` are cut. A null or empty text is the end id alone. Repeated rows
    are packed as often as they occur, null ids are kept, other columns are ignored.
    """
    return pack(token_pieces(df, tokenizer_path, capacity, end_id, keep_ids), capacity)
