"""Token counts by byte-pair merging with a heap over a linked list of symbols."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townloom.llm.bytesops import text_bytes
from townloom.llm.wordcodes import batches_by_bytes, part_starts, row_sums, worker_cache

# Fixed value: the published split pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when the lowest-rank adjacent pair, leftmost first, is merged until none is.

    A heap holds (rank, place) of the pairs; the symbols form a doubly linked list. A popped entry whose
    pair has changed meanwhile is skipped. The answer is the number of symbols minus the merges.
    """
    n = len(symbols)
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    after, before, merges = [*range(1, n), -1], [*range(-1, n - 1)], 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] is None or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = None
        k = after[i] = after[j]
        merges += 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


def counter(path: str) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """Counts for texts from the merge table and the added tokens of a byte-level BPE file."""

    def make():
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ranks = {pair: i for i, pair in enumerate(pairs)}
        names, find = byte_symbols(), regex.compile(PRETOKEN).findall
        added = [t["content"] for t in spec.get("added_tokens", [])]
        special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

        def plain(text: str) -> int:
            return sum(merged_length([names[b] for b in piece.encode()], ranks) for piece in find(text))

        def count(text: str) -> int:
            if special is None or not any(t in text for t in added):
                return plain(text)
            return len(special.findall(text)) + sum(map(plain, special.split(text)))

        return lambda texts: [[count(t)] for t in texts]

    return make


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Bytes, tokens and whether the tokens exceed `limit`, for every row of `df`.

    Each distinct part of a text (see wordcodes) is merged once per worker, whatever the table's size, and
    no identifiers are made. Null and empty texts have 0 bytes and 0 tokens. Null ids are kept, repeated
    rows give repeated rows, an empty table gives an empty one; other columns are ignored.
    """
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("counts", tokenizer_path, counter(tokenizer_path))
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            counts = [np.zeros(0, np.int64)]
            for i, j in batches_by_bytes(offsets):
                part, at = raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                starts = part_starts(part, at)
                slots = cache.slots(part, starts, np.append(starts[1:], len(part)))
                counts.append(row_sums(cache.flat[cache.first[slots]].astype(np.int64), starts, at))
            tokens = np.concatenate(counts)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens),
                                   pa.array(tokens > limit)],
                                  names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
