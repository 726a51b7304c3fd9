"""Near copies by MinHash bands with sequential Bayesian verification.

Texts that agree in all rows of a band are candidates. Their signatures are compared batch by batch; after
each batch the posterior of the pair's similarity (uniform prior, so a beta distribution) says how likely it
still reaches the threshold, and the pair is dropped once that is below the chosen miss probability. Pairs that
outlive all batches are decided on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townloom.llm.bytesops import mix
from townloom.llm.jaccard_join import NO_ID, alike, components, lists, mapped, needed, row_key, signature
from townloom.session import cut

BANDS, BAND_ROWS = 25, 5  # a pair at 0.85 shares no band with probability (1 - 0.85 ** 5) ** 25, below 5e-7
HASHES = 128  # values of a signature, the first of which make the bands; 16 bits are kept of each
BATCH = 32  # signature values compared between two looks at the posterior
MISS = 1e-6  # a pair is dropped when it reaches the threshold with less than this probability
CHUNK = 1 << 16  # shingles hashed at once
DENSE = 8  # pairs a text in a bucket from which its texts are compared by their rare shingles
SALT_ROWS = 2000  # rows of one key that meet the other side in one task


def hash_seeds() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return (seeds[:HASHES] >> np.uint64(32)).astype(np.uint32), (seeds[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhashes(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The low bits of HASHES minima of every row's shingles; rows without shingles have zeros."""
    out = np.zeros((len(sizes), HASHES), np.uint16)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    flip, times = hash_seeds()
    filled = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[filled]
    i = 0
    while i < len(filled):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK)))
        end = starts[j] if j < len(filled) else len(x)
        part, at = x[starts[i]:end], starts[i:j] - starts[i]
        for k in range(HASHES):
            h = (part ^ flip[k]) * times[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out[filled[i:j], k] = np.minimum.reduceat(h, at) & np.uint32(0xFFFF)
        i = j
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of every band of every signature."""
    rows = signatures[:, :BANDS * BAND_ROWS].reshape(len(signatures), BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return keys


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """For every batch: the fewest matches so far that leave a probability of at least `miss`.

    After s matches of m the similarity is Beta(s + 1, m - s + 1), which reaches t with the probability
    that at most s of m + 1 trials with chance t succeed.
    """
    t, out = percent / 100, []
    for m in range(BATCH, HASHES + 1, BATCH):
        chance, s = 0.0, -1
        while chance < miss:
            s += 1
            chance += math.comb(m + 1, s) * t ** s * (1 - t) ** (m + 1 - s)
        out.append(s)
    return out


def signature_rows(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), HASHES)


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that outlive all batches; `pairs` has the signatures too."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 4096):
                batch = whole.slice(i, 4096)
                x, y = signature_rows(batch.column(2)), signature_rows(batch.column(3))
                alive, matches = np.arange(len(batch)), np.zeros(len(batch), np.int64)
                for k, fewest in enumerate(least):
                    at = slice(k * BATCH, (k + 1) * BATCH)
                    matches[alive] += (x[alive, at] == y[alive, at]).sum(axis=1)
                    alive = alive[matches[alive] >= fewest]
                yield batch.select([0, 1]).take(pa.array(alive))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def texts_of(docs: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(key, text, node, sig_a): the text that stands for each node of `ends`."""
    wanted = nodes.join(ends, "node").select("node", "sig_a", F.col("own_key").alias("key"))
    return docs.join(wanted, "key").select("key", "text", "node", "sig_a")


def set_rows(texts: DataFrame, n: int) -> DataFrame:
    """(node, tokens): the full shingle sets."""

    def whole(batch, sets, sizes, classes):
        # an id may have other texts too; the signature tells the node's own
        own = signature(sets, sizes)[0] == np.asarray(batch.column(3))
        return [batch.column(2), pa.array(own), lists(pa.array(sets.view(np.int64)), sizes)]

    return mapped(texts, "node bigint, own boolean, tokens array<bigint>", n, whole).where("own").drop("own").dropDuplicates(["node"])


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, of those the sequential test leaves."""
    pairs = cut(pairs.distinct())
    side = lambda end: nodes.select(F.col("node").alias(end), F.col("minima").alias(f"{end}_minima"))
    met = likely(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_minima", "b_minima"), percent)
    met = cut(met)
    ends = met.select(F.col("a").alias("node")).union(met.select("b")).distinct()
    sets = cut(set_rows(texts_of(docs, nodes, ends), n))
    both = met.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    # set by set in the JVM: a batch of pairs for Python could hold any number of long sets
    enough = F.size(F.array_intersect("x", "y")) * (100 + percent) >= (F.size("x") + F.size("y")) * percent
    return cut(both.where(enough).select("a", "b"))


def salted_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left x right by `key`; right rows of a key with many of them are dealt over salts, left rows copied to each."""
    counts = cut(right.groupBy(key).agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")))
    right = right.join(counts, key).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts")
    left = left.join(counts, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return left.join(right, [key, "salt"])


def across(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of one key that are in different components and of sizes that may link."""
    left = rows.select(key, *(F.col(c).alias("l_" + c) for c in ("node", "n", "component")))
    ahead = (F.col("l_n") < F.col("n")) | (F.col("l_n") == F.col("n")) & (F.col("l_node") < F.col("node"))
    met = salted_pairs(left, rows, key).where(
        ahead & (F.col("l_component") != F.col("component")) & alike(F.col("l_n"), F.col("n"), percent))
    return met.select(F.least("l_node", "node").alias("a"), F.greatest("l_node", "node").alias("b"))


def mixed(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys with more than one component, and the pairs a row that the key would make."""
    sizes = rows.groupBy(key, "component").agg(F.count("*").alias("c"))
    total = sizes.groupBy(key).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"), F.count("*").alias("parts"))
    dense = ((F.col("m") * F.col("m") - F.col("s")) / (2 * F.col("m"))).alias("density")
    return rows.join(total.where("parts > 1").select(key, dense), key)


def rare_pairs(rows: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """Candidates among the nodes of `rows` by their rarest shingles, for buckets too dense for all pairs.

    Two sets that link share a token within the first (1 - percent %) of either, in whatever order; ordered by
    how many of these nodes hold a token, a passage that fills a bucket comes last.
    """
    ends = cut(rows.select("node", "n", "component").distinct())
    tokens = cut(set_rows(texts_of(docs, nodes, ends.select("node")), n)).select("node", F.explode("tokens").alias("token"))
    held = cut(tokens.groupBy("token").agg(F.count("*").alias("nodes")).where("nodes > 1"))
    order = Window.partitionBy("node").orderBy(F.col("nodes").asc_nulls_first(), "token")
    placed = tokens.join(held, "token", "left").withColumn("place", F.row_number().over(order)).where("nodes IS NOT NULL")
    kept = placed.join(ends, "node").where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1)
    kept = cut(kept.select("token", "node", "n", "component", "place"))
    kept = mixed(kept, "token").drop("density")
    left = kept.select("token", *(F.col(c).alias("l_" + c) for c in ("node", "n", "component", "place")))
    room = F.least(F.col("l_n") - F.col("l_place"), F.col("n") - F.col("place")) + 1 >= needed(F.col("l_n"), F.col("n"), percent)
    ahead = (F.col("l_n") < F.col("n")) | (F.col("l_n") == F.col("n")) & (F.col("l_node") < F.col("node"))
    met = salted_pairs(left, kept, "token").where(
        ahead & (F.col("l_component") != F.col("component")) & alike(F.col("l_n"), F.col("n"), percent) & room)
    return met.select(F.least("l_node", "node").alias("a"), F.greatest("l_node", "node").alias("b"))


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept of every row.

    Rows link when their sets of n-word shingles have at least `percent` % in common (Jaccard). A text of
    fewer words is one shingle; null, empty and wordless texts have none and link with nothing.

    Equal sets are one node. In every bucket of a band the nodes first meet the node with most copies,
    which joins most near copies; then nodes of a bucket that are still in different components meet each other.
    Buckets that would make more than DENSE pairs a node make candidates by rare shingles instead, so no bucket
    is cut short. A link is missed only if the pair shares no band or the sequential test drops it (MISS a look).

    Every row is a text of its own: repeated rows share their component, different texts under one id may have
    different ones. `kept` marks rows whose id is their component's; rows without an id take part,
    and a component of such rows only has a null id and keeps them all. An empty table gives an empty one.
    """
    docs = df.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))

    def summary(batch, sets, sizes, classes):
        a, b = signature(sets, sizes)
        minima = minhashes(sets, sizes)
        packed = pa.Array.from_buffers(pa.binary(2 * HASHES), len(minima), [None, pa.py_buffer(minima.astype("<u2").tobytes())])
        return [batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(a), pa.array(b), packed.cast(pa.binary())]

    members = mapped(docs, "key bigint, n int, sig_a bigint, sig_b bigint, minima binary", n, summary).select(
        "key", "n", "sig_a", "minima", F.xxhash64("n", "sig_a", "sig_b").alias("node"))
    members = cut(members)
    nodes = cut(members.where("n > 0").groupBy("node").agg(
        F.first("n").alias("n"), F.first("sig_a").alias("sig_a"), F.min("key").alias("own_key"),
        F.count("*").alias("copies"), F.first("minima").alias("minima")))
    members = members.select("key", "n", "node")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(signature_rows(batch.column(3)))
            row = pa.array(np.repeat(np.arange(len(batch)), BANDS))
            yield pa.record_batch([*(batch.column(c).take(row) for c in range(3)), pa.array(keys.reshape(-1).view(np.int64))],
                                  names=["node", "n", "copies", "band"])

    bands = nodes.select("node", "n", "copies", "minima").mapInArrow(banded, "node bigint, n int, copies bigint, band bigint")
    hubs = bands.groupBy("band").agg(F.count("*").alias("nodes"), F.max(F.struct("copies", "node", "n")).alias("hub"))
    hubs = hubs.where("nodes > 1").select("band", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    shared = cut(bands.drop("copies").join(hubs, "band"))
    star = shared.where((F.col("node") != F.col("hub")) & alike(F.col("n"), F.col("hub_n"), percent)).select(
        F.col("hub").alias("a"), F.col("node").alias("b"))
    links = cut(components(verified(star, docs, nodes, n, percent)))

    placed = shared.select("band", "node", "n").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(mixed(placed, "band"))
    rest = across(placed.where(F.col("density") <= DENSE), "band", percent).union(
        rare_pairs(placed.where(F.col("density") > DENSE), docs, nodes, n, percent))
    more = verified(rest, docs, nodes, n, percent)
    raised = lambda end: links.select(F.col("node").alias(end), F.col("component").alias("c_" + end))
    merged = more.join(raised("a"), "a", "left").join(raised("b"), "b", "left").select(
        F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    final = components(merged).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    part = nodes.select("node", "own_key").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    part = cut(part.join(final, "component", "left").select("node", "own_key", F.coalesce("joined", "component").alias("part")))
    named = part.join(part.groupBy("part").agg(F.min("own_key").alias("lowest")), "part").select("node", "lowest")
    out = members.join(named, "node", "left").select("key", "n", F.coalesce("lowest", "key").alias("component"))
    given = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return out.select(given("key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                      given("component").alias("component_id"),
                      ((F.col("key") == F.col("component")) | (F.col("component") >= NO_ID)).alias("kept"))
