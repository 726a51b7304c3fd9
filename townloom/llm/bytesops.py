"""Vectorised splitting and hashing of UTF-8 text held in one Arrow buffer.

Everything works on the bytes of a whole batch at once; texts are never cut short. Hashes are 64 bits
wide: two different strings of one batch collide with probability below 1e-9.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 18  # bytes hashed at once; bounds the temporary arrays and the kept powers
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, for caches that several tasks share."""
    module = sys.modules.setdefault("townloom_worker_store", types.ModuleType("townloom_worker_store"))
    return module.__dict__.setdefault(name, {})


def release_caches() -> None:
    """Forget what tasks of other operators left in this worker, and give free memory back to the system.

    Workers live on from stage to stage, so a task calls this before it fills stores of its own.
    """
    for store in vars(sys.modules.get("townloom_worker_store", types.ModuleType(""))).values():
        if isinstance(store, dict):
            store.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library: freed arrays stay in its heap otherwise
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def byte_values() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept in the worker."""
    store = worker_store("powers")
    have = store.get(base)
    if have is None or len(have) <= n:
        factors = np.full(max(n, SEGMENT_BYTES) + 1, base, np.uint64)
        factors[0] = 1
        have = np.cumprod(factors, dtype=np.uint64)
        if n <= SEGMENT_BYTES:  # those for a longer word are not kept
            store[base] = have
    return have


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets (n + 1 of them); null counts as empty."""
    pa.default_memory_pool().release_unused()  # of the batches before; workers live long
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span. Spans ascend and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    values, i = byte_values(), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT_BYTES, side="right")))
        j = min(j, len(starts))
        a, b = int(starts[i]), int(ends[j - 1])
        forth, back = powers(BASE, b - a), powers(INVERSE, b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[raw[a:b]] * forth[:b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        i = j
    return out


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def blank(raw: np.ndarray) -> np.ndarray:
    """White space of the word rule: space and 0x09 to 0x0D."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and the row of each word. No word crosses rows."""
    solid = ~blank(raw)
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begins = solid & np.concatenate([[True], ~solid[:-1]]) if len(raw) else solid
    begins = begins | (solid & first[:-1])
    stops = np.concatenate([~solid[1:], [True]]) if len(raw) else solid
    stops = solid & (stops | first[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def texts_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = raw.tobytes() if len(starts) > 64 else None
    if data is None:
        return [raw[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
    return [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


class HashSlots:
    """Open-addressing map from non-zero 64-bit hashes to slot numbers 0, 1, 2, ..., in flat arrays."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.limit = (1 << bits) * 6 // 10
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = np.zeros(1 << bits, np.int32)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        at = keys & self.mask
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.slots[at[hit]]
            go = ~hit & (there != 0)
            left, at = left[go], (at[go] + np.uint64(1)) & self.mask
        return out

    def grow(self) -> None:
        kept, slots = self.keys[self.keys != 0], self.slots[self.keys != 0]
        self.__init__(len(self.keys).bit_length())
        self.add(kept[np.argsort(slots)])

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Slots for new, distinct keys."""
        while self.size + len(keys) > self.limit:
            self.grow()
        slots = np.arange(self.size, self.size + len(keys))
        left, at = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.slots[at[won]] = slots[left[won]]
            left, at = left[~won], (at[~won] + np.uint64(1)) & self.mask
        self.size += len(keys)
        return slots


def gather(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[first[i] : first[i] + counts[i]] for every i, one after the other."""
    total = int(counts.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(counts)
    return values[np.arange(total) + np.repeat(first - (ends - counts), counts)]
