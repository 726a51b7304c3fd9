"""Exact top-k inner products by a Voronoi kNN join.

Maximum inner product becomes nearest neighbour when every candidate y gets one more component
sqrt(M - |y|^2), M being the largest squared length, and every query a zero: |q' - y'|^2 = |q|^2 + M - 2 qy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townloom.session import cut

CELL_ROWS = 4096  # vectors per pivot that are aimed at
MAX_PIVOTS = 64  # pivots, at most; larger cells have more blocks
BLOCK_ROWS = 8192  # vectors in a packed block
QUERY_ROWS = 256
SLICE_BLOCKS = 8  # blocks of a cell that meet queries in one task
SLACK = 1e-6


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Packed little-endian 64-bit vectors as rows, shorter ones filled up with zeros."""
    rows = column.to_pylist()
    if rows and all(len(r) == 8 * dims for r in rows):
        return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), dims)
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r) // 8] = np.frombuffer(r, "<i8")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows, by floats where they are exact."""
    top = max(int(np.abs(a).max(initial=0)), 1) * max(int(np.abs(b).max(initial=0)), 1) * max(a.shape[1], 1)
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def quantized(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of each component; vectors with null or non-finite ones are left out."""
    sound = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = df.where(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(1)
            sizes = np.diff(np.asarray(vec.offsets))
            data = np.asarray(vec.flatten()).astype("<i8")
            ends = np.cumsum(sizes)
            packed = [data[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            norms = [int((data[a:b] ** 2).sum()) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary()), pa.array(norms, pa.int64())],
                                  names=["vec_id", "vec", "norm"])

    return whole.mapInArrow(run, "vec_id bigint, vec binary, norm bigint")


def near(points: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every point and its distance."""
    d = ((points ** 2).sum(axis=1) + extra ** 2)[:, None] + ((pivots ** 2).sum(axis=1) + pivot_extra ** 2)[None, :]
    d = np.sqrt(np.maximum(d - 2 * (points @ pivots.T + extra[:, None] * pivot_extra[None, :]), 0))
    cell = d.argmin(axis=1)
    return cell, d[np.arange(len(d)), cell]


def assign(df: DataFrame, space: dict, augmented: bool) -> DataFrame:
    """Adds the cell and the distance from its pivot."""
    names = df.columns
    at = names.index("vec"), names.index("norm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(at[0]), space["dims"]).astype(np.float64)
            norm = np.asarray(batch.column(at[1])).astype(np.float64)
            extra = np.sqrt(np.maximum(space["largest"] - norm, 0)) if augmented else np.zeros(len(points))
            cell, dist = near(points, extra, space["pivots"], space["pivot_extra"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(dist)],
                                             names=[*names, "cell", "dist"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, schema + ", cell int, dist double")


def packed(df: DataFrame, rows: int, dims: int, id_type: str) -> DataFrame:
    """Rows ordered by cell and distance, packed into blocks of one cell each."""
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, held = TaskContext.get().partitionId() << 32, [], 0

        def flush(final: bool):
            nonlocal block, waiting, held
            table = pa.Table.from_batches(waiting).combine_chunks()
            cells = np.asarray(table["cell"])
            i = 0
            while i < len(cells):
                j = min(int(np.searchsorted(cells, cells[i], side="right")), i + rows)
                if j == len(cells) and not final and j - i < rows:
                    break
                part = table.slice(i, j - i)
                dist = np.asarray(part["dist"])
                yield pa.RecordBatch.from_pylist(
                    [{"block": block, "cell": int(cells[i]), "n": j - i, "low": float(dist.min()), "high": float(dist.max()),
                      "ids": part["ids"].to_pylist(), "vecs": matrix(part["vec"], dims).astype("<i8").tobytes()}], schema=arrow)
                block, i = block + 1, j
            waiting, held = table.slice(i).to_batches(), len(cells) - i

        arrow = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()),
                           ("ids", pa.list_(pa.list_(pa.int64()) if "array" in id_type else pa.int64())), ("vecs", pa.binary())])
        for batch in batches:
            waiting.append(batch)
            held += len(batch)
            if held >= rows:
                yield from flush(False)
        if waiting:
            yield from flush(True)

    ordered = df.select("ids", "vec", "cell", "dist").repartitionByRange(shards, "cell", "dist").sortWithinPartitions("cell", "dist")
    return cut(ordered.mapInArrow(run, f"block bigint, cell int, n bigint, low double, high double, ids array<{id_type}>, vecs binary"))


def top_products(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest integer inner products of every query.

    Ties go to the smaller vec_id; a candidate with the query's own id is left out; fewer candidates than k
    give fewer rows. Vectors that are null or hold null or non-finite components, and rows without an id, take
    no part; shorter vectors count as filled up with zeros; repeated rows of a candidate count once.

    Equal candidate vectors are merged first and keep their k + 1 smallest ids, which is all a result can
    name. Pivots (a hash sample of bounded size) split candidates and queries into cells; from each cell's
    summary (count, radius, its k + 1 smallest distances) follows how far any query of a block may have to
    look. Query blocks travel only to cells and blocks within that bound, and each pair of blocks is solved
    by one matrix product that returns at most k rows a query.
    """
    wanted = k + 1
    rows = quantized(candidates, scale, id_col, vec_col)
    rows = rows.groupBy("vec", "vec_id").agg(F.first("norm").alias("norm"))
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    merged = rows.withColumn("nth", nth).where(F.col("nth") <= wanted).groupBy("vec").agg(
        F.first("norm").alias("norm"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    merged = cut(merged)
    asked = quantized(queries, scale, id_col, vec_col).groupBy(F.col("vec_id").alias("ids")).agg(
        F.min(F.struct("vec", "norm")).alias("v")).select("ids", "v.vec", "v.norm")  # a repeated query is asked once
    asked = cut(asked)
    size = merged.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max(F.octet_length("vec")).alias("bytes")).first()
    longest = asked.agg(F.max(F.octet_length("vec")).alias("bytes")).first().bytes
    spark = queries.sparkSession
    if not size.n or longest is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dims = max(size.bytes, longest, 8) // 8
    number = int(min(MAX_PIVOTS, max(4, size.n // CELL_ROWS)))
    chosen = merged.orderBy(F.xxhash64("vec"), "vec").limit(number).toArrow()
    space = {"dims": dims, "largest": float(size.norm), "pivots": matrix(chosen["vec"].combine_chunks(), dims).astype(np.float64)}
    space["pivot_extra"] = np.sqrt(np.maximum(space["largest"] - np.asarray(chosen["norm"]).astype(np.float64), 0))
    number = len(space["pivots"])
    blocks = packed(assign(merged, space, True), BLOCK_ROWS, dims, "array<bigint>")
    asked = packed(assign(asked, space, False), QUERY_ROWS, dims, "bigint")

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # blocks are cut from rows in order of distance; the summary needs only each block's first ones
        for batch in batches:
            vecs, cells, out = batch.column("vecs").to_pylist(), np.asarray(batch.column("cell")), []
            norms = [(np.frombuffer(v, "<i8").reshape(-1, dims)[:wanted] ** 2).sum(axis=1) for v in vecs]
            for v, n, c in zip(vecs, norms, cells.tolist()):
                points = np.frombuffer(v, "<i8").reshape(-1, dims)[:wanted].astype(np.float64)
                extra = np.sqrt(np.maximum(space["largest"] - n, 0))
                gap = np.sqrt(np.maximum(((points - space["pivots"][c]) ** 2).sum(axis=1) + (extra - space["pivot_extra"][c]) ** 2, 0))
                out += [(c, float(g)) for g in gap]
            yield pa.record_batch([pa.array([c for c, _ in out], pa.int32()), pa.array([g for _, g in out], pa.float64())], names=["cell", "gap"])

    gaps = blocks.select("cell", "vecs").mapInArrow(closest, "cell int, gap double")
    order = F.row_number().over(Window.partitionBy("cell").orderBy("gap"))
    gaps = gaps.withColumn("nth", order).where(F.col("nth") <= wanted).select("cell", "gap").collect()  # pivots x (k + 1) rows
    cells = blocks.groupBy("cell").agg(F.count("*").alias("blocks"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    lows, highs = np.full(number, np.inf), np.full(number, -np.inf)
    slices = np.zeros(number, np.int64)
    for c in cells:
        lows[c.cell], highs[c.cell], slices[c.cell] = c.low, c.high, -(-c.blocks // SLICE_BLOCKS)
    gap_cells, gap_values = np.array([g.cell for g in gaps]), np.array([g.gap for g in gaps])
    p = space["pivots"]
    between = np.sqrt(np.maximum(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)
                                 + (space["pivot_extra"][:, None] - space["pivot_extra"][None, :]) ** 2, 0))
    slack = SLACK * (1 + np.sqrt(space["largest"]))

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in batch.to_pylist():
                d = between[q["cell"]]
                reach = np.sort(q["high"] + d[gap_cells] + gap_values)
                bound = float(reach[wanted - 1]) if len(reach) >= wanted else np.inf
                least = np.maximum(np.maximum(d - q["high"] - highs, lows - d - q["high"]), q["low"] - d - highs)
                for c in np.flatnonzero((slices > 0) & (least <= bound + slack)).tolist():
                    yield pa.RecordBatch.from_pylist([{
                        "cell": c, "slice": s, "far": float(d[c]), "q_low": q["low"], "q_high": q["high"], "bound": bound,
                        "q_ids": q["ids"], "q_vecs": q["vecs"]} for s in range(int(slices[c]))], schema=arrow)

    arrow = pa.schema([("cell", pa.int32()), ("slice", pa.int64()), ("far", pa.float64()), ("q_low", pa.float64()), ("q_high", pa.float64()),
                       ("bound", pa.float64()), ("q_ids", pa.list_(pa.int64())), ("q_vecs", pa.binary())])
    sent = asked.mapInArrow(travel, "cell int, slice bigint, far double, q_low double, q_high double, bound double, q_ids array<bigint>, q_vecs binary")
    count = F.lit(slices.tolist()) if number else None
    sliced = blocks.withColumn("slice", F.pmod(F.xxhash64("block"), F.element_at(count, F.col("cell") + 1)))
    least = F.greatest(F.col("far") - F.col("q_high") - F.col("high"), F.col("low") - F.col("far") - F.col("q_high"),
                       F.col("q_low") - F.col("far") - F.col("high"))
    pairs = sent.join(sliced, ["cell", "slice"]).where(least <= F.col("bound") + slack).select("q_ids", "q_vecs", "ids", "vecs")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q_ids, q_vecs, ids, vecs = (batch.column(c)[i] for c in range(4))
                a = np.frombuffer(q_vecs.as_buffer(), "<i8").reshape(-1, dims)
                b = np.frombuffer(vecs.as_buffer(), "<i8").reshape(-1, dims)
                yield best_rows(np.asarray(q_ids.values), a, ids.values, b, k)

    found = pairs.mapInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_rows(query_ids: np.ndarray, a: np.ndarray, ids: pa.Array, b: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best candidates of every query within one block; `ids` lists the ids of each vector of b."""
    scores = products(a, b)
    n = scores.shape[1]
    kth = np.partition(scores, n - min(n, k + 1), axis=1)[:, n - min(n, k + 1)]
    row, col = np.nonzero(scores >= kth[:, None])
    offsets, flat = np.asarray(ids.offsets).astype(np.int64), np.asarray(ids.flatten())
    offsets = offsets - offsets[0]
    times = offsets[col + 1] - offsets[col]
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    vec_id, row_all, score = flat[np.repeat(offsets[col], times) + inner], np.repeat(row, times), np.repeat(scores[row, col], times)
    other = vec_id != query_ids[row_all]
    vec_id, row_all, score = vec_id[other], row_all[other], score[other]
    order = np.lexsort((vec_id, -score, row_all))
    vec_id, row_all, score = vec_id[order], row_all[order], score[order]
    nth = np.arange(len(row_all)) - np.searchsorted(row_all, row_all)
    keep = nth < k
    return pa.record_batch([pa.array(query_ids[row_all[keep]]), pa.array(vec_id[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])
