"""N-gram Jaccard join with several global token orders, and the components of its links.

Two documents whose shingle sets are similar enough share a token within the first few of either set under
any one order of all tokens. Orders used here put tokens that many documents share last (a counted, bounded
list), before them tokens of frequent words, and differ in how they shuffle tokens of one class. The first order makes candidates through an inverted index; a candidate
pair must also share a prefix token under the other orders before its sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townloom.llm.bytesops import lower_ascii, mix, release_caches, spans_hash, text_bytes, word_spans
from townloom.llm.decontamination import small
from townloom.llm.wordcodes import batches_by_bytes
from townloom.session import cut

ORDERS = 3
HOT_TOKENS = 200_000  # tokens that the orders rank by frequency, at most; any list keeps the join exact
HOT_IN_BATCH, HOT_IN_ALL = 3, 20
COUNT_BYTES = 3 << 20  # text that counts as a batch here
COMMON_WORDS = 100_000  # words whose frequency shapes the orders, at most
COMMON_IN_BATCH = 4
NO_ID = 1 << 62  # rows without an id are numbered from here by their text
BITMAP_BITS = 1 << 24  # of a filter that spares most documents a shuffle; broadcast as 64-bit words
PLACE_BITS, COPIES_BITS = 28, 5  # of a prefix token's row


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int, common: tuple[np.ndarray, np.ndarray] | None = None
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending within the row, how many each row has, and classes.

    A row with fewer than n words has its whole sequence as one shingle; one without words has none. A
    shingle's class follows from how common its words are (all 0 without `common`).
    """
    low = lower_ascii(raw)
    starts, ends, rows = word_spans(low, offsets)
    keys = spans_hash(low, starts, ends)
    heavy = np.zeros(len(keys))
    if common is not None and len(common[0]) and len(keys):
        at = np.minimum(np.searchsorted(common[0], keys), len(common[0]) - 1)
        heavy = np.where(common[0][at] == keys, common[1][at], 0)
    words = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(words) - words
    left = np.repeat(first + words, words) - np.arange(len(keys))  # words from here to the row's end
    run, weight = np.zeros(len(keys), np.uint64), np.zeros(len(keys))
    for k in range(n):
        there = left > k
        at = np.minimum(np.arange(len(keys)) + k, max(len(keys) - 1, 0))
        run = np.where(there, mix(run * np.uint64(0x9E3779B97F4A7C15) + keys[at] + np.uint64(1)), run)
        weight = np.where(there, weight + heavy[at], weight)
    whole = np.zeros(len(keys), bool)
    whole[first[(words > 0) & (words < n)]] = True
    kept = (left >= n) | whole
    run, rows, weight = run[kept], rows[kept], weight[kept]
    order = np.lexsort((run, rows))
    run, rows, weight = run[order], rows[order], weight[order]
    fresh = np.ones(len(run), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (rows[1:] != rows[:-1])
    return run[fresh], np.bincount(rows[fresh], minlength=len(offsets) - 1), np.floor(weight[fresh] / n).astype(np.int64)


def in_order(sets: np.ndarray, classes: np.ndarray, rows: np.ndarray, order: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Positions of the tokens, row by row: by listed frequency, by class, then by the order's own hash."""
    count = np.zeros(len(sets), np.int64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], sets), len(hot[0]) - 1)
        count = np.where(hot[0][at] == sets, hot[1][at], 0)
    return np.lexsort((mix(sets ^ np.uint64(order * 0x9E3779B97F4A7C15 % (1 << 64))), classes, count, rows))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def prefixes(sets: np.ndarray, sizes: np.ndarray, classes: np.ndarray, order: int, percent: int, hot) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of every set under the order, and how many."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    sets = sets[in_order(sets, classes, rows, order, hot)]
    nth = np.arange(len(sets)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = prefix_size(sizes, percent)
    return sets[nth < kept[rows]], kept


def signature(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart: sums of two hashes of the tokens."""
    ends = np.cumsum(sizes)
    out = []
    for seed in (1, 2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(seed)), dtype=np.uint64)])
        out.append((sums[ends] - sums[ends - sizes]).view(np.int64))
    return out[0], out[1]


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def mapped(docs: DataFrame, schema: str, n: int, make, common=None) -> DataFrame:
    """For each batch of (key, text, ...): `make` turns the batch, shingle sets, sizes and classes into columns."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in batches_by_bytes(offsets):
                found = shingle_sets(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], n, common)
                yield pa.record_batch(make(batch.slice(i, j - i), *found), names=names)

    return docs.mapInArrow(run, schema)


def ascending(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    item, count = np.asarray(table["item"]).view(np.uint64), np.asarray(table["n"])
    order = np.argsort(item)
    return item[order], count[order]


def frequencies(docs: DataFrame, n: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Tokens that many documents seem to share with counts, and common words with log-counts, by hash.

    Counted are those that occur several times within a batch. The lists only shape the orders and are
    bounded: the driver gets HOT_TOKENS and COMMON_WORDS rows at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in batches_by_bytes(offsets, COUNT_BYTES):
                part, at = raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                low = lower_ascii(part)
                starts, ends, _ = word_spans(low, at)
                for token, values, least in ((True, shingle_sets(part, at, n)[0], HOT_IN_BATCH),
                                             (False, spans_hash(low, starts, ends), COMMON_IN_BATCH)):
                    item, count = np.unique(values, return_counts=True)
                    often = count >= least
                    yield pa.record_batch([pa.array(np.full(often.sum(), token)), pa.array(item[often].view(np.int64)),
                                           pa.array(count[often].astype(np.int64))], names=["token", "item", "n"])

    counts = cut(docs.mapInArrow(run, "token boolean, item bigint, n bigint").groupBy("token", "item").agg(F.sum("n").alias("n")))
    top = lambda rows, most: ascending(rows.orderBy(F.col("n").desc(), "item").limit(most).toArrow())
    words = top(counts.where("not token"), COMMON_WORDS)
    return top(counts.where(F.col("token") & (F.col("n") >= HOT_IN_ALL)), HOT_TOKENS), (words[0], np.log2(words[1] + 1))


def alike(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def needed(a: Column, b: Column, percent: int) -> Column:
    """Shared tokens that two sets of these sizes need."""
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def texts_of_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, text, own): the documents whose keys are nodes, with the signature of the node's text."""
    wanted = small(nodes.select("node", F.col("sig_a").alias("own")))
    return docs.join(wanted, F.col("key") == F.col("node")).select("key", "text", "own")


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int, hot, common) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under every other order and are similar enough."""
    pairs = cut(pairs.distinct())

    def own(batch, sets, sizes) -> list:
        # a key may have other texts too; the signature picks the node's own
        return [batch.column(0), pa.array(signature(sets, sizes)[0] == np.asarray(batch.column(2)))]

    def others(batch, sets, sizes, classes):
        out = [*own(batch, sets, sizes), pa.array(sizes.astype(np.int32))]
        for order in range(1, ORDERS):
            tokens, kept = prefixes(sets, sizes, classes, order, percent, hot)
            # 32 bits of each token: a filter may pass more, never less (see `hidden` below)
            out.append(lists(pa.array((tokens >> np.uint64(32)).astype(np.uint32).view(np.int32)), kept))
        return out

    def whole(batch, sets, sizes, classes):
        return [*own(batch, sets, sizes), lists(pa.array(sets.view(np.int64)), sizes)]

    def of_ends(pairs: DataFrame, schema: str, make) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "sig_a"), "node")
        return cut(mapped(texts_of_nodes(docs, cut(ends)), f"node bigint, own boolean, {schema}", n, make, common).where("own").drop("own"))

    columns = [f"p{k}" for k in range(1, ORDERS)]
    found = of_ends(pairs, "n int, " + ", ".join(f"{c} array<int>" for c in columns), others)
    side = lambda end, mark: found.select(F.col("node").alias(end), *(F.col(c).alias(mark + c) for c in ("n", *columns)))
    met = pairs.join(side("a", "l"), "a").join(side("b", "r"), "b")
    for c in columns:
        # one of the prefixes ends first; what it does not hold of the other is not shared, so beyond
        # the common prefix tokens at most the rest of that set is
        # (tokens of equal halves within one prefix count once in the intersection; what that may hide is added)
        hidden = F.least(*(F.size(side + c) - F.size(F.array_distinct(side + c)) for side in ("l", "r")))
        common_tokens = F.size(F.array_intersect("l" + c, "r" + c)) + hidden
        rest = F.greatest(F.col("ln") - F.size("l" + c), F.col("rn") - F.size("r" + c))
        met = met.where((common_tokens > 0) & (common_tokens + rest >= needed(F.col("ln"), F.col("rn"), percent)))
    met = cut(met.select("a", "b"))
    found = of_ends(met, "tokens array<bigint>", whole)

    both = met.join(found.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(
        found.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    # pairs of sets stay in the JVM, row by row: a batch of them for Python could hold any number of long sets
    enough = F.size(F.array_intersect("x", "y")) * (100 + percent) >= (F.size("x") + F.size("y")) * percent
    return cut(both.where(enough).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node of an edge list (a, b).

    Alternates large-star and small-star steps until no edge changes; each round cuts its lineage.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(low, "a")
        edges = cut(step.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(step.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct())


def row_key(doc_id: Column, text: Column) -> Column:
    """The id, or for rows without one a number beyond all ids that follows from the text."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_ID // 2)))


def one_of_each(df: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df` without near copies: of each component the document with the smallest id stays, once.

    Rows without shingles stay, once per id. Different texts under an id that stays all stay, each once: none of
    them is dropped for another. Other columns are kept as they are. An empty table gives an empty one.
    """
    keyed = df.withColumn("townloom_key", row_key(F.col("doc_id"), F.col("text")))
    keys = similarity_keys(df, n, percent).groupBy("key").agg(
        F.count("*").alias("rows"), F.max(F.col("key") == F.col("component")).alias("stays"))
    keys = cut(keys.where("not stays or rows > 1").select(F.col("key").alias("townloom_key"), "stays"))
    maybe = marked(keyed, keys, "townloom_key")
    rest = maybe.where("townloom_mark").join(keys, "townloom_key", "left").where(F.coalesce("stays", F.lit(True))).withColumn(
        "townloom_text", F.xxhash64("text")).dropDuplicates(["townloom_key", "townloom_text"])
    return maybe.where("not townloom_mark").select(*df.columns).union(rest.select(*df.columns))


def marked(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The documents with a column townloom_mark: true for those whose key is listed and few others. Shuffles no document."""
    bit = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    found = docs.withColumn("townloom_bit", bit).join(F.broadcast(words), F.shiftright("townloom_bit", 6) == F.col("word"), "left")
    mark = F.expr("coalesce(shiftright(bits, cast(townloom_bit & 63 as int)) & 1 = 1, false)")
    return found.select(*docs.columns, mark.alias("townloom_mark"))


def similarity_components(df: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document.

    Documents link when their sets of n-word shingles have at least `percent` % in common (Jaccard). Equal
    sets become one node first. Nodes that share a prefix token are compared with the node of that token
    that has it earliest; links found there already join most copies. Nodes of one token
    that are still in different components are then compared with each other, smaller against larger,
    as far as sizes and the token's places allow a link. So no link between different components is lost,
    while a large group of copies costs about one comparison each.

    Null, empty and wordless texts have no shingles and link with nothing. Repeated rows share their
    component; so do different texts under one id. Rows without an id take part; a component of such rows
    only has a null id. An empty table gives an empty one.
    """
    found = similarity_keys(df, n, percent, id_col, text_col)
    return found.select(F.when(F.col("key") < NO_ID, F.col("key")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                        F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"))


def similarity_keys(df: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """similarity_components with keys (see row_key) in place of ids: key, n, component."""
    docs = df.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    hot, common = frequencies(docs, n)

    def first_order(batch, sets, sizes, classes):
        tokens, kept = prefixes(sets, sizes, classes, 0, percent, hot)
        a, b = signature(sets, sizes)
        return [batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(a), pa.array(b), lists(pa.array(tokens.view(np.int64)), kept)]

    members = cut(mapped(docs, "key bigint, n int, sig_a bigint, sig_b bigint, prefix array<bigint>", n, first_order, common))
    same = ["n", "sig_a", "sig_b"]
    nodes = members.where("n > 0").groupBy(*same).agg(F.min("key").alias("node"), F.count("*").alias("copies"), F.first("prefix").alias("prefix"))
    # A token's hub is the node that has it earliest, hence the fewest tokens of its own before it: the text that
    # the others are copies of, or the nearest to it. One number holds the place, copies and the node's hash.
    # Rows are dealt by token once, for the hubs and for their join, with n, copies and place (cut off at its bits:
    # a smaller place only lets more pairs through) in one number.
    low = lambda c, bits: F.least(c.cast("long"), F.lit((1 << bits) - 1))
    upper = F.shiftleft(F.col("n").cast("long"), PLACE_BITS + COPIES_BITS) + F.shiftleft(
        low(F.floor(F.log2("copies")), COPIES_BITS), PLACE_BITS)
    rows = nodes.select("node", upper.alias("packed"), F.posexplode("prefix").alias("place", "token")).where("token is not null")
    rows = rows.select("token", "node", (F.col("packed") + low(F.col("place"), PLACE_BITS)).alias("packed")).repartition("token")
    field = lambda shift, bits: F.shiftright("packed", shift).bitwiseAND(F.lit((1 << bits) - 1))
    who = F.shiftleft(F.least(field(PLACE_BITS, COPIES_BITS), F.lit(30)), 47) + F.shiftrightunsigned(F.xxhash64("node"), 17)
    rows = rows.select("node", F.shiftright("packed", PLACE_BITS + COPIES_BITS).cast("int").alias("n"),
                       field(0, PLACE_BITS).cast("int").alias("place"), "token", who.alias("who"))
    rows = rows.select("node", "n", "place", "token", (F.shiftleft(
        F.lit(1023) - F.least(F.col("place"), F.lit(1023)).cast("long"), 52) + F.col("who")).alias("standing"))
    hubs = rows.groupBy("token").agg(F.count("*").alias("nodes"), F.max("standing").alias("hub")).where("nodes > 1").drop("nodes")
    shared = cut(rows.join(hubs, "token"))
    identity = cut(members.where("n > 0").groupBy(*same).agg(F.min("key").alias("node")))

    hub = F.col("hub").bitwiseAND(F.lit((1 << 52) - 1)).alias("hub")
    chosen = shared.where("standing = hub").select(hub, F.col("node").alias("a"), F.col("n").alias("hub_n")).distinct()
    star = shared.where("standing <> hub").select("node", "n", hub).distinct().join(chosen, "hub").where(
        alike(F.col("n"), F.col("hub_n"), percent)).select("a", F.col("node").alias("b"))
    links = cut(components(confirmed(star, docs, identity, n, percent, hot, common)))
    placed = shared.drop("hub", "standing").join(small(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lowest"), F.max("component").alias("highest")).where("lowest <> highest")
    placed = cut(placed.join(mixed.select("token"), "token", "left_semi"))
    # of the smaller set of a pair fewer tokens are enough
    smaller = placed.where(F.col("place") < F.col("n") - F.ceil(F.col("n") * 2.0 * percent / (100 + percent) - 1e-9) + 1).select(
        "token", *(F.col(c).alias("s_" + c) for c in ("node", "n", "place", "component")))
    ahead = (F.col("s_n") < F.col("n")) | (F.col("s_n") == F.col("n")) & (F.col("s_node") != F.col("node"))
    room = F.least(F.col("s_n") - F.col("s_place"), F.col("n") - F.col("place")) >= needed(F.col("s_n"), F.col("n"), percent)
    rest = smaller.join(placed, "token").where(ahead & (F.col("s_component") != F.col("component")) & alike(F.col("s_n"), F.col("n"), percent) & room)
    rest = rest.select(F.least("s_node", "node").alias("a"), F.greatest("s_node", "node").alias("b"))
    more = confirmed(rest, docs, identity, n, percent, hot, common)

    def raised(side: str) -> DataFrame:
        return links.select(F.col("node").alias(side), F.col("component").alias("c_" + side))

    merged = more.join(raised("a"), "a", "left").join(raised("b"), "b", "left").select(
        F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    final = components(merged).select(F.col("node").alias("component"), F.col("component").alias("lowest"))
    named = identity.join(links, "node", "left").withColumn("component", F.coalesce("component", "node")).join(
        final, "component", "left").select(*same, F.coalesce("lowest", "component").alias("component"))
    out = members.select("key", *same).join(named, same, "left")
    return out.select("key", "n", F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component")).alias("component"))
