"""Ranked search, hard negatives and MinHash near-duplicates against brute force, with odd rows and ties."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import ODD, prose, shingles, tokens
from townloom.llm import hard_negatives, minhash_dedup, ranked_search


def terms(text):
    out, word = [], ""
    for c in text or "":
        if ord(c) > 127 or c.isalnum():
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif word:
            out, word = [*out, word], ""
    return [*out, word] if word else out


def ranked(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = {at: sum(b.values()) for at, (_, b) in enumerate(bags)}
    filled, length = sum(v > 0 for v in n.values()), sum(n.values())
    df = Counter(t for _, b in bags for t in b)
    texts = {}
    for i, t in dict.fromkeys(items):
        if i is not None:
            texts.setdefault(i, Counter()).update(terms(t))
    rows = []
    for item, bag in texts.items():
        found = []
        for at, (i, b) in enumerate(bags):
            m = 100 - 25 + (25 * n[at] * filled) // max(length, 1)
            score = sum(c * math.floor(1000 * math.log((2 * filled + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
                        for t, c in bag.items() if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        rows += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(map(str, rows))


@pytest.fixture(scope="module")
def searched(spark):
    r = random.Random(4)
    rows = [(i, t) for i, t in enumerate([*ODD, *(prose(s, r.randint(1, 90)) for s in range(40)), "tie one", "tie one", "TIE-one", "Größe groß σ"])]
    rows += [(None, "tie one"), (None, "tie one"), (5, "a second text of five"), (6, prose(3, 30_000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("item_id", "term", "rank", "score", "part")})
    items = [(1, "the river runs over stones12 stones12"), (2, None), (3, ""), (4, "tie one two"), (4, "tie one two"), (4, "one more"), (5, "GRÖßE Größe groß"),
             (None, "the river"), (6, "nobody says any of it" * 3), (7, prose(7, 60))]
    items = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    return docs.repartition(5), items


def pairs_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("postings, cells, k", [(None, None, 20), (40, 30, 3)])
def test_ranked_search(searched, monkeypatch, postings, cells, k):
    docs, items = searched
    if postings:  # several blocks of items, few cells at once
        monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", postings)
        monkeypatch.setattr(ranked_search, "CELLS", cells)
    got = ranked_search.ranked_documents(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == ranked(pairs_of(docs, "doc_id", "text"), pairs_of(items, "item_id", "text"), k)


def test_ranked_search_of_nothing(searched):
    docs, items = searched
    assert ranked_search.ranked_documents(docs.where("false"), items).count() == 0
    assert ranked_search.ranked_documents(docs, items.where("false")).count() == 0
    assert ranked_search.ranked_documents(docs.where("text is null"), items).count() == 0


def test_terms_in_stretches(monkeypatch):
    raw = np.frombuffer("ab-cd12 é;xyz  q".encode(), np.uint8)
    offsets = np.array([0, 2, 2, 10, len(raw)])
    whole = [np.concatenate(x) for x in zip(*ranked_search.term_hashes(raw, offsets))]
    monkeypatch.setattr(ranked_search, "SEGMENT", 3)
    parts = [np.concatenate(x) for x in zip(*ranked_search.term_hashes(raw, offsets))]
    assert whole[1].tolist() == parts[1].tolist() == [0, 2, 2, 3, 3] and (whole[0] == parts[0]).all()


def test_heaps_keep_ties_by_id():
    heaps = ranked_search.Heaps(1, 2)
    for ids, scores in (([9, 4], [7, 7]), ([3, 0], [7, 7]), ([1], [0])):
        heaps.offer(np.array([[s] for s in scores]), np.array(ids), np.array([i > 0 for i in ids]))
    assert sorted(zip(*heaps.rows())) == [(0, 3, 7), (0, 4, 7)]


def mined(rows, anchors, k=5, low=80):
    sound = {}
    for i, label, v in sorted((r for r in rows if usable(r)), key=lambda r: (r[1], [math.floor(256 * x) for x in r[2]])):
        sound.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = []
    for a in sorted({i for i, *_ in anchors if i in sound}):
        label, v = sound[a]
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in sound.items() if i != a)
        for s, p, _ in [x for x in scores if x[2]][:k]:
            window = [(n, i) for n, i, same in scores if not same and low * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(window)]
    return sorted(out)


def usable(row):
    i, label, v = row
    return i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block, groups", [(2048, 256), (16, 2)])
def test_hard_negatives(spark, monkeypatch, block, groups):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", groups)
    r = random.Random(5)
    vec = lambda: [r.choice([-0.5, 0.25, 0.5, 0.75, 1.0]) for _ in range(4)]  # noqa: E731  (many ties)
    rows = [(i, r.randint(0, 2), vec()) for i in range(300)] + [(7, 0, vec()), (9, 1, [0.5, 1.0]), (100, 1, vec()), (100, 2, vec())]
    rows += [(300, 3, vec()), (301, None, vec()), (302, 1, None), (303, 1, [0.5, None, 1.0, 1.0]), (304, 1, [float("nan")] * 4),
             (305, 1, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, vec()), (306, 1, []), (50, 1, [-9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in ("block", "score", "rank", "vec", "anchor")})
    asked = df.where("vec_id % 50 = 0")
    got = sorted(tuple(x) for x in hard_negatives.hard_negatives(df.unionByName(df.where("vec_id < 20")), asked).collect())
    assert got == mined(rows, [x for x in rows if x[0] is not None and x[0] % 50 == 0]) and len(got) > 50
    assert len({g[0] for g in got}) > 3 and not [g for g in got if g[0] == 300]
    assert hard_negatives.hard_negatives(df.where("false"), asked).count() == 0
    assert hard_negatives.hard_negatives(df, asked.where("false")).count() == 0


def test_keys_sort_as_pairs():
    r = random.Random(1)
    rows = [(r.randint(-3, 3), r.choice([-(2**62), -1, 0, 1, 2**62]), r.randint(0, 1), r.randint(-9, 9)) for _ in range(200)]
    keys = [hard_negatives.packed_keys(np.array([a]), np.array([s]), kind, np.array([i]))[0].as_py() for a, s, kind, i in rows]
    assert [hard_negatives.unpacked(k) for k in keys] == rows
    assert [hard_negatives.unpacked(k) for k in sorted(keys)] == sorted(rows, key=lambda x: (x[0], -x[1], x[2], x[3]))


def components_of(rows, n, percent):
    """Every row is a text of its own."""
    sets = [shingles(tokens(t), n) for _, t in rows]
    lead = list(range(len(rows)))

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lead[top(i)] = top(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        lowest = min((x for x in groups[top(i)] if x is not None), default=None)
        out.append((str(k), len(sets[i]), str(lowest), k == lowest))
    return sorted(out)


def copies(spark):
    r = random.Random(8)
    base = prose(1, 160).split(" ")
    rows = [(i, t) for i, t in enumerate([*ODD, " ".join(base), " ".join(base)])]
    for k in range(30):  # copies with 1 to 9 changed words, some within the threshold of each other only
        words = list(base)
        for _ in range(1 + k % 9):
            words[r.randrange(160)] = f"edit{k}"
        rows.append((20 + k, " ".join(words)))
    passage = prose(2, 60)
    rows += [(100 + k, passage + " " + prose(200 + k, 40)) for k in range(12)]  # share a passage, do not link
    rows += [(150 + k, passage + " " + prose(200 + k, 40) + " end") for k in range(3)]
    rows += [(None, " ".join(base)), (None, prose(77, 30)), (3, prose(78, 50)), (400, prose(78, 50)), (401, prose(79, 20_000)), (402, prose(79, 20_000) + " x")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {c: F.lit("clash") for c in ("key", "node", "n", "band", "component", "kept", "a", "b")})


@pytest.mark.parametrize("dense, salt", [(32, 2000), (0.0, 2)])
def test_near_duplicates(spark, monkeypatch, dense, salt):
    monkeypatch.setattr(minhash_dedup, "DENSE", dense)  # 0: every mixed bucket goes by rare shingles
    monkeypatch.setattr(minhash_dedup, "SALT_ROWS", salt)
    rows, df = copies(spark)
    got = minhash_dedup.near_duplicates(df.repartition(4)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept if x.doc_id is not None else x.component_id is None)
                  for x in got) == [(a, b, c, d) for a, b, c, d in components_of(rows, 5, 85)]
    if dense:
        assert minhash_dedup.near_duplicates(df.where("false")).count() == 0
        assert {x.component_id for x in minhash_dedup.near_duplicates(df.where("doc_id < 3")).collect()} == {0, 1, 2}


def test_rare_shingles_find_every_link(spark):
    """The way for dense buckets alone, without any band: all links between different components."""
    rows = [(i, t) for i, t in copies(spark)[0] if i is not None and 19 < i < 200]
    docs = spark.createDataFrame(rows, "key bigint, text string")
    sets = {i: shingles(tokens(t), 5) for i, t in rows}
    made = minhash_dedup.mapped(docs, "key bigint, n int, sig_a bigint", 5, lambda batch, s, sizes, c: [
        batch.column(0), minhash_dedup.pa.array(sizes.astype(np.int32)), minhash_dedup.pa.array(minhash_dedup.signature(s, sizes)[0])])
    nodes = made.select(F.col("key").alias("node"), "n", "sig_a", F.col("key").alias("own_key"))
    found = minhash_dedup.rare_pairs(nodes.withColumn("component", F.col("node")), docs, nodes, 5, 85).distinct().collect()
    found = {(min(x), max(x)) for x in found}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    shared = {(a, b) for a in range(100, 112) for b in range(a + 1, 112)}
    assert links and links <= found and not shared & found


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    pool = r.integers(0, 2**64, 3000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.85):
        n = 1000
        common = int(2 * n * share / (1 + share))
        sets = np.concatenate([pool[:n], np.concatenate([pool[:common], pool[n:2 * n - common]])])
        x, y = minhash_dedup.minhashes(sets, np.array([n, n]))
        assert abs((x == y).mean() - share) < 0.11
    assert (minhash_dedup.minhashes(np.zeros(0, np.uint64), np.array([0, 0])) == 0).all()


def test_posterior_keeps_links_and_drops_others():
    least = minhash_dedup.least_matches(85)
    r = np.random.default_rng(1)

    def dropped(similarity, trials):
        hits = r.random((trials, minhash_dedup.HASHES)) < similarity
        seen = hits.cumsum(axis=1)[:, minhash_dedup.BATCH - 1::minhash_dedup.BATCH]
        return (seen < least).any(axis=1).mean()

    assert dropped(0.85, 20_000) <= 2e-4 and dropped(0.5, 2_000) > 0.99
    for m, s in zip(range(32, 129, 32), least):  # the posterior itself, by summing the density
        grid = (np.arange(200_000) + 0.5) / 200_000
        for matches, enough in ((s, True), (s - 1, False)):
            density = grid ** matches * (1 - grid) ** (m - matches)
            assert (density[grid >= 0.85].sum() / density.sum() >= minhash_dedup.MISS) == enough


def test_pairs_kept_do_not_grow_with_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ADDED_ROWS", 50)
    r = random.Random(9)
    rows = [(i, r.randint(0, 1), [r.choice([0.25, 0.5, 0.75, 1.0]) for _ in range(4)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    kept, whole = [], hard_negatives.kept_pairs
    monkeypatch.setattr(hard_negatives, "kept_pairs", lambda *a: kept.append(whole(*a)) or kept[-1])
    got = sorted(tuple(x) for x in hard_negatives.hard_negatives(df, df.where("vec_id % 50 = 0")).collect())
    assert got == mined(rows, [x for x in rows if x[0] % 50 == 0])
    tasks = spark.sparkContext.defaultParallelism
    near, far = (k.count() for k in kept)
    assert near <= 14 * 5 * tasks and far <= 14 * 25 * tasks  # 44 blocks


@pytest.mark.parametrize("size, kind", [(100, np.float32), (10**5, np.float64), (10**9, np.int64)])
def test_products_are_exact(size, kind):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-size, size + 1, (20, 6)), rng.integers(-size, size + 1, (30, 6))
    x, y = hard_negatives.exact(a, b)
    assert x.dtype == kind and [[int(s) for s in row] for row in x @ y.T] == [
        [sum(int(p) * int(q) for p, q in zip(u, v)) for v in b] for u in a]
