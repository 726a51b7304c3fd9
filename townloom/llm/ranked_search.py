"""Ranked lexical search turned around: the items' inverted index travels, the documents stream past it.

Items are few and documents are many, so the index is built over the items' terms and broadcast, block by
block of bounded size. Each task counts the terms of its documents, follows them into the index and keeps
the best documents of every item in a bounded heap; the heaps of all tasks are merged at the end.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townloom.llm.bytesops import gather, lower_ascii, release_caches, spans_hash, text_bytes, word_spans
from townloom.llm.wordcodes import batches_by_bytes
from townloom.session import cut

BLOCK_POSTINGS = 1_000_000  # (item, term) pairs aimed at in a broadcast index, 24 bytes each
CELLS = 1_000_000  # scores (documents x items), and postings followed, at once
SEGMENT = 2 << 20  # bytes whose terms are looked up at once
MERGE_PARTS = 64  # first level of the merge of heaps


def term_bytes() -> np.ndarray:
    """Which bytes belong to terms: ASCII letters and digits, and all beyond ASCII."""
    table = np.zeros(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return table


def segments(solid: np.ndarray):
    """Stretches of about SEGMENT bytes that end where no term goes on."""
    i = 0
    while i < len(solid):
        j = min(i + SEGMENT, len(solid))
        if j < len(solid):
            ahead = int(solid[j:].argmin())
            j = len(solid) if solid[j + ahead] else j + ahead
        yield i, j
        i = j


def term_hashes(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and row of every term, stretch by stretch, so a long text needs no more memory than a short one."""
    solid = term_bytes()[raw]
    for i, j in segments(solid):
        low = lower_ascii(np.where(solid[i:j], raw[i:j], 32).astype(np.uint8))
        starts, ends, rows = word_spans(low, np.clip(offsets, i, j) - i)
        yield spans_hash(low, starts, ends), rows


def tallied(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    distinct, at = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, at, counts)
    return distinct, sums


def known_terms(raw: np.ndarray, offsets: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in `terms` and count of each indexed term of the rows, and how many terms each row has."""
    total = np.zeros(len(offsets) - 1, np.int64)
    pairs, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for keys, rows in term_hashes(raw, offsets):
        total += np.bincount(rows, minlength=len(total))
        if not len(terms):
            continue
        at = np.minimum(np.searchsorted(terms, keys), len(terms) - 1)
        there = terms[at] == keys
        pair, n = np.unique(rows[there] * len(terms) + at[there], return_counts=True)
        pairs.append(pair)
        counts.append(n)
    pair, tf = tallied(np.concatenate(pairs), np.concatenate(counts))
    return pair // max(len(terms), 1), pair % max(len(terms), 1), tf, total


class Index(NamedTuple):
    """Postings of one block of items: terms ascending, and for each its items and their repeats of it."""

    ids: pa.Array
    terms: np.ndarray
    first: np.ndarray
    count: np.ndarray
    items: np.ndarray
    times: np.ndarray


def inverted(postings: pa.Table) -> Index:
    item = postings["item_id"].combine_chunks().dictionary_encode()
    items, times = np.asarray(item.indices).astype(np.int64), np.asarray(postings["times"])
    hashes = np.asarray(postings["term"]).view(np.uint64)
    order = np.lexsort((items, hashes))
    terms, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
    return Index(item.dictionary, terms, first, count, items[order], times[order])


def item_postings(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of all items; `items` has item_id and text."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for keys, rows in term_hashes(raw, offsets):
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(keys.view(np.int64))], names=["item_id", "term"])

    return items.mapInArrow(run, f"item_id {kind}, term bigint").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def corpus_counts(docs: DataFrame, terms) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term, documents with terms, and terms with repeats, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        known = terms.value
        df, filled, length = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in batches_by_bytes(offsets):
                _, at, _, total = known_terms(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], known)
                df += np.bincount(at, minlength=len(df))
                filled, length = filled + int((total > 0).sum()), length + int(total.sum())
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[filled, length], df[at]]))],
                              names=["at", "n"])

    found = docs.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # vocabulary + 2 rows
    n = dict(zip(found["at"].to_pylist(), found["n"].to_pylist()))
    return np.array([n.get(i, 0) for i in range(len(terms.value))], np.int64), n.get(-1, 0), n.get(-2, 0)


class Heaps:
    """The k best documents of every item. Equal scores prefer the smaller id, and any id to none."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score below this changes nothing

    def offer(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        """`scores`: a row for each document, a column for each item."""
        good = scores >= self.least
        for item in np.flatnonzero(good.any(axis=0)).tolist():
            at = np.flatnonzero(good[:, item])
            if len(at) > self.k:
                at = at[np.lexsort((ids[at], ~named[at], -scores[at, item]))[:self.k]]
            heap = self.heaps[item]
            for entry in zip(scores[at, item].tolist(), named[at].tolist(), (-ids[at]).tolist()):
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]

    def rows(self) -> tuple[list[int], list[int | None], list[int]]:
        found = [(item, -i if named else None, score) for item, heap in enumerate(self.heaps) for score, named, i in heap]
        return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]


def stream(docs: DataFrame, index, weights, filled: int, length: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best documents of every item of the index within each task."""
    import pyspark.sql.pandas.types as kinds

    item_type = kinds.from_arrow_type(index.value.ids.type).simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        ix, w = index.value, weights.value
        heaps, most = Heaps(len(ix.ids), k), max(1, CELLS // max(len(ix.ids), 1))
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            named = np.asarray(batch.column(0).is_valid())
            ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
            for a, b in batches_by_bytes(offsets):
                for i in range(a, b, most):
                    j = min(i + most, b)
                    part, at = raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                    heaps.offer(scored(ix, w, known_terms(part, at, ix.terms), filled, length), ids[i:j], named[i:j])
        item, doc_id, score = heaps.rows()
        yield pa.record_batch([ix.ids.take(pa.array(item, pa.int64())), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())],
                              names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, f"item_id {item_type}, doc_id bigint, score bigint")


def scored(ix: Index, w: np.ndarray, found: tuple, filled: int, length: int) -> np.ndarray:
    """Scores of some documents (rows) against all items of the index (columns)."""
    rows, at, tf, total = found
    out = np.zeros(len(total) * len(ix.ids), np.int64)
    kept = w[at] > 0
    rows, at, tf = rows[kept], at[kept], tf[kept]
    m = 100 - 25 + (25 * total * filled) // max(length, 1)
    gain = w[at] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[rows]))
    ends = np.cumsum(ix.count[at])
    i = 0
    while i < len(at):  # terms in many items make many postings; a bounded number at once
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CELLS, side="right")))
        first, count = ix.first[at[i:j]], ix.count[at[i:j]]
        cell = np.repeat(rows[i:j] * len(ix.ids), count) + gather(ix.items, first, count)
        np.add.at(out, cell, np.repeat(gain[i:j], count) * gather(ix.times, first, count))
        i = j
    return out.reshape(len(total), len(ix.ids))


def ranked_documents(df: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                     item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for every item.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with only A-Z lower-cased.
    With N documents that have terms, L terms in them, n in one, df documents holding a term and tf
    occurrences: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + 25 n N div L, and the score sums
    w * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included, in whole numbers.

    Every row is a document; repeated rows rank one after the other, equal scores by ascending doc_id, rows
    without an id last. The texts of an item_id given more than once are searched as one, exact repeats
    counting once; items without an id are left out. Null, empty and termless texts, and empty tables, give
    no rows. Terms are told apart by 64-bit hashes. Items are taken in blocks of about BLOCK_POSTINGS
    postings; each block costs two passes over the documents, whatever their number.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    asked = asked.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    postings = cut(item_postings(asked))
    spark, blocks = df.sparkSession, -(-2 * postings.count() // BLOCK_POSTINGS)
    kind = asked.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, doc_id bigint, score bigint")
    for block in range(blocks):
        index = inverted(postings.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow())
        if not len(index.terms):
            continue
        held, filled, length = corpus_counts(docs, spark.sparkContext.broadcast(index.terms))
        w = [math.floor(1000 * math.log((2 * filled + 2) / (2 * n + 1))) for n in held.tolist()]
        found = found.union(stream(docs, spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(np.array(w, np.int64)),
                                   filled, length, k))
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))
    first = Window.partitionBy("item_id", "part").orderBy(*best)
    found = found.withColumn("part", part).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*best))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
