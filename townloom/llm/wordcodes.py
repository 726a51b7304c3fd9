"""Token ids of whole texts by way of their distinct parts.

A byte-level tokenizer first splits a text with a pattern whose matches never run from a non-blank
character into a blank one. Cutting in front of every run of ASCII white space, and between a letter and
ASCII punctuation, therefore leaves the ids unchanged, and each distinct part has to be encoded once per
Python worker. The cache is bounded and is emptied when full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from townloom.llm.bytesops import HashSlots, gather, release_caches, spans_hash, texts_of, worker_store

CACHE_BITS = 16  # the table grows from here
FULL = 600_000  # parts in a worker's cache beyond which the next batch starts with an empty one
BATCH_BYTES = 1 << 20  # bytes of text worked on at once; arrays over them take some fifty times as much
ENCODED_AT_ONCE = 4_000  # parts given to the library at once; what it returns takes over a kilobyte a part
# ASCII punctuation in front of which a part may begin after a letter; no apostrophe (contractions).
PUNCTUATION = np.frombuffer(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~", np.uint8)


SPACE, LETTER, POINT, HIGH, LATIN, ASK = 1, 2, 4, 8, 16, 32


def byte_classes() -> bytes:
    """For bytes.translate: what each byte may be. LATIN: lead of a two-byte letter of Latin script."""
    table = np.zeros(256, np.uint8)
    table[[32, *range(9, 14)]] |= SPACE
    table[65:91] |= LETTER
    table[97:123] |= LETTER
    table[PUNCTUATION] |= POINT
    table[128:] |= HIGH
    table[0xC3:0xCA] |= LATIN
    table[[*range(0x1C, 0x20), 60, 0xC2, 0xE1, 0xE2, 0xE3]] |= ASK
    return table.tobytes()


def keeps_whole(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the positions start white space beyond ASCII or a special-token mark `<|`."""
    padded = np.concatenate([raw, np.zeros(2, np.uint8)])
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    return ((a < 32) | (a == 60) & (b == 124) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
            | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
            | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))


def part_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts begin. Rows with unusual white space or special-token marks stay whole."""
    if not len(raw):
        return np.zeros(0, np.int64)
    kind = np.frombuffer(raw.tobytes().translate(byte_classes()), np.uint8)
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    cut = ((kind & SPACE) > (before & SPACE)) | ((kind & POINT) != 0) & ((before & (LETTER | HIGH)) != 0)
    # after a byte beyond ASCII only a two-byte Latin letter (two signs in that range are none) will do,
    # and no punctuation is cut off that a combining mark may follow
    risky = np.flatnonzero(cut & ((kind & POINT) != 0))
    after = np.append(kind, 0)[risky + 1] & HIGH
    high = (before[risky] & HIGH) != 0
    lead, last = raw[np.maximum(risky - 2, 0)], raw[risky - 1]
    letter = ((kind[np.maximum(risky - 2, 0)] & LATIN) != 0) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    cut[risky[(after != 0) | high & ~letter]] = False
    ask = np.flatnonzero(kind & ASK)
    if len(ask := ask[keeps_whole(raw, ask)]):
        rows = np.unique(np.searchsorted(offsets, ask, side="right") - 1)
        for a, b in zip(offsets[rows].tolist(), offsets[rows + 1].tolist()):
            cut[a:b] = False
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class PartCache:
    """What `encode` (a list of texts to a list of integer lists) says of each distinct part."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known = HashSlots(CACHE_BITS)
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    def learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        found = self.encode([p.decode("utf-8", "replace") for p in parts])
        counts = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum()))
        slots = self.known.add(keys)
        while self.known.size > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.first[slots] = self.used + np.cumsum(counts) - counts
        self.count[slots] = counts
        self.flat[self.used:self.used + len(flat)] = flat
        self.used += len(flat)

    def slots(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = spans_hash(raw, starts, ends)
        keys[keys == 0] = 1
        if self.known.size > FULL:
            self.clear()
        out = self.known.find(keys)
        if (new := np.flatnonzero(out < 0)).size:
            fresh, at = np.unique(keys[new], return_index=True)
            for i in range(0, len(fresh), ENCODED_AT_ONCE):
                chosen = new[at[i:i + ENCODED_AT_ONCE]]
                self.learn(fresh[i:i + ENCODED_AT_ONCE], texts_of(raw, starts[chosen], ends[chosen]))
            out[new] = self.known.find(keys[new])
        return out


def batches_by_bytes(offsets: np.ndarray, limit: int = BATCH_BYTES):
    """Row ranges of at most `limit` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def worker_cache(kind: str, path: str, make: Callable[[], Callable]) -> PartCache:
    store = worker_store("part caches")
    if (kind, path) not in store:
        release_caches()
        store[kind, path] = PartCache(make())
    return store[kind, path]


def row_ids(cache: PartCache, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after the other, and how many each row has."""
    starts = part_starts(raw, offsets)
    ends = np.append(starts[1:], len(raw))
    slots = cache.slots(raw, starts, ends)
    counts = cache.count[slots].astype(np.int64)
    ids = gather(cache.flat, cache.first[slots], counts)
    return ids, row_sums(counts, starts, offsets)


def row_sums(values: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of the parts of each row."""
    sums = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(starts, offsets)
    return sums[at[1:]] - sums[at[:-1]]


def library_encoder(path: str) -> Callable[[], Callable]:
    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return make
