"""The training-data operators against brute force, with nulls, empty and long texts, ties and repeats."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from townloom.llm import (decontamination, jaccard_join, lattice_lm, packing, pii, quality, token_counts, token_files,
                          topk, toxicity)
from townloom.session import scratch_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "   ", "Don't stop, it's 12,34!!  <|endoftext|> x", "café é!! ≠   \n\n y  z", "one two three",
       "ONE two three", "tail  ", "x" * 3000, "a " * 5000]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "river", "runs", "over", "stones", "and", "under", "bridge", "of", "old", "town"]) + str(r.randint(0, 60))
                    for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1, 120)
    words = base.split(" ")
    near = [" ".join(w if i != 10 * k + 5 else "changed" for i, w in enumerate(words)) for k in range(4)]
    rows = [*ODD, base, base, *near, *(prose(s, 80) for s in range(2, 30))]
    table = [(i, t) for i, t in enumerate(rows)] + [(3, ODD[3]), (None, base), (None, "nobody's text here is short")]
    return spark.createDataFrame(table, "doc_id bigint, text string").withColumns(
        {c: F.lit("clash") for c in ("key", "node", "n", "train", "score", "y", "vec", "lang")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def encoder(path):
    from tokenizers import Tokenizer

    return lambda t: Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids


def test_token_counts(docs, empty):
    encode = encoder(BYTES)
    rows = docs.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(encode(r.text)), len(encode(r.text)) > 1024) for r in rows)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, BYTES).collect())
    assert got == want
    assert token_counts.token_counts(empty, BYTES).count() == 0


def test_heap_merges_equal_the_library():
    count = token_counts.counter(BYTES)()
    encode = encoder(BYTES)
    for t in ["hello world", "aaaaaaaaaaaaaaa", "unbelievably", " \n\n x", "日本語 ü", ""]:
        assert count([t]) == [[len(encode(t))]]


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 3000):
        ids = np.where(r.random(n) < 0.1, r.integers(0, 2**32, n), r.integers(500, 900, n)).astype(np.uint32)
        data, exceptions = token_files.encode_blocks(ids)
        assert (token_files.decode_blocks(data) == ids).all()
        assert n < 1000 or exceptions > 0 and (token_files.decode_blocks(data, 3, 5) == ids[384:640]).all()
    assert (token_files.decode_blocks(token_files.encode_blocks(np.full(500, 7, np.uint32))[0]) == 7).all()


def test_token_files(spark, docs, empty):
    path = scratch_path(spark, "test-token-files")
    token_files.write_token_files(docs, path, BYTES)
    encode = encoder(BYTES)
    want = Counter((r.doc_id, zlib.crc32(np.array([*encode(r.text), 2], "<u4").tobytes())) for r in docs.collect())
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want
    end, last = 0, -1
    for r in rows:
        assert r.start == end and (r.doc_id is None or r.doc_id >= last)
        end, last = end + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    path = scratch_path(spark, "test-token-files")
    token_files.write_token_files(empty, path, BYTES)
    assert token_files.read_token_files(spark, path).count() == 0


def test_packing(docs, empty):
    encode, capacity = encoder(WORDS), 64
    rows = packing.pack_documents(docs, WORDS, capacity=capacity, keep_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*encode(r.text), 1]
        for k in range(0, len(ids), capacity):
            want[r.doc_id, k // capacity, k, tuple(ids[k:k + capacity])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= capacity
    assert packing.pack_documents(empty, WORDS).count() == 0


def best_number(lengths, capacity):
    """Fewest bins by search over partitions of a few pieces."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                bins[b] += lengths[i]
                place(i + 1, bins)
                bins[b] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_dominance_keeps_an_optimum():
    r = random.Random(3)
    for _ in range(150):
        capacity = r.choice([10, 17, 30])
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 8))), reverse=True)
        counts = [lengths.count(n) for n in range(capacity + 1)]
        fixed = packing.reduce_dominated(counts, capacity)
        left = [n for n in range(capacity, 0, -1) for _ in range(counts[n])]
        used = Counter(n for p in fixed for n in p.lengths for _ in range(p.count))
        used.update(left)
        assert used == Counter(lengths) and all(sum(p.lengths) <= capacity for p in fixed)
        assert sum(p.count for p in fixed) + best_number(left, capacity) == best_number(lengths, capacity)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(words, n):
    return {tuple(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def linked(rows, n, percent):
    sets = [shingles(tokens(t), n) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                parent[top(i)] = top(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(k)
    lowest = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [(str(k), len(sets[i]), str(lowest[top(i)])) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_join(docs, empty, n, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard_join.similarity_components(docs, n, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(linked(rows, n, percent))
    assert n != 4 or jaccard_join.similarity_components(empty).count() == 0


def test_jaccard_chain_without_a_hub(spark):
    """Links that only neighbours in a long chain of edits have."""
    words = prose(7, 100).split(" ")
    rows = []
    for k in range(25):
        rows.append((k, " ".join(words)))
        words[(k * 37) % 100] = f"edit{k}"
    df = spark.createDataFrame(rows[::-1], "doc_id bigint, text string")
    got = jaccard_join.similarity_components(df, 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(linked(rows, 4, 85))


def test_one_of_each(docs):
    kept = jaccard_join.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 10 in ids and not {11, 12, 13, 14, 15} & set(ids) and ids.count(3) == 1 and {0, 1, 2} <= set(ids)


def test_texts_under_one_id_are_not_dropped_for_each_other(spark):
    a, b, c = prose(60, 50), prose(61, 50), prose(62, 50)
    df = spark.createDataFrame([(5, a), (5, b), (5, b), (7, a), (9, c)], "doc_id bigint, text string")
    kept = sorted((r.doc_id, r.text) for r in jaccard_join.one_of_each(df).collect())
    assert kept == sorted([(5, a), (5, b), (9, c)])


def test_few_documents_are_marked_for_a_shuffle(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    keys = docs.where("doc_id % 100 = 7").select(F.col("doc_id").alias("townloom_key"))
    got = {r.doc_id: r.townloom_mark for r in jaccard_join.marked(
        docs.withColumn("townloom_key", F.col("doc_id")), keys, "townloom_key").collect()}
    assert len(got) == 5000 and all(got[i] for i in range(7, 5000, 100)) and sum(got.values()) < 60
    df = spark.createDataFrame([(i, prose(i, 40)) for i in range(100, 120)] + [(200, prose(100, 40))], "doc_id bigint, text string")
    kept = jaccard_join.one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(100, 120))
    first = kept._jdf.queryExecution().optimizedPlan().toString().split("Union")[1].split("Aggregate")[0]
    assert "townloom_text" not in first  # most documents are neither joined with keys nor grouped


def test_components_of_a_chain(spark):
    edges = spark.range(30).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in jaccard_join.components(edges).collect()} == {0}


def test_equal_halves_of_tokens_hide_no_link(spark):
    """Tokens whose upper halves are all equal: the filter of the other orders still passes the pair."""
    same = jaccard_join.F.array(*[jaccard_join.F.lit(7)] * 5)
    hidden = F.least(F.size(same) - F.size(F.array_distinct(same)), F.lit(9))
    got = spark.range(1).select((F.size(F.array_intersect(same, same)) + hidden).alias("n")).first()
    assert got.n == 5


def test_decontamination(spark, docs, empty):
    item = prose(5, 40).split(" ")
    rows = [(100, prose(50, 200) + " " + " ".join(item) + " " + prose(51, 200)), (101, prose(52, 100) + " " + " ".join(item[:25])),
            (102, "Only Four, words here"), (103, "so only four words here are"), (None, " ".join(item).upper() + "!"), (100, None)]
    both = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"), allowMissingColumns=True)
    items = spark.createDataFrame([(1, " ".join(item)), (2, "only four words here"), (3, None), (4, ""), (5, " ".join(item)), (None, "of")],
                                  "item_id bigint, text string")
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    want = set()
    for d in both.collect():
        for b in items.collect():
            x, y = shingles(words(d.text), 5), shingles(words(b.text), 5)
            if y and 5 * len(x & y) >= 4 * len(y):
                want.add((d.doc_id, b.item_id, len(y), len(x & y)))
    got = decontamination.contaminated(both, items).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == want and len(got) == len(want) == 7
    kept = decontamination.drop_contaminated(both, items)
    assert kept.columns == both.columns and kept.count() == both.count() - 4
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(docs, items.where("false")).count() == 0


def test_pieces_of_any_length_have_arcs():
    names = lattice_lm.vocabulary(PIECES)[0]
    long = [n for n in names if len(n) > 16]
    assert long
    for piece in long:
        word = piece.removeprefix(b" ")
        (_, size, pieces), = lattice_lm.lattices([word], names)
        assert names[pieces[len(piece) - 1][0, size - len(piece)]] == piece


def luhn(digits):
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def test_pseudonyms(spark, docs, empty):
    cards = ["4111111111111111", "4111 1111 1111 1111", "378282246310005"]
    text = "a " + " b ".join([*cards, "7841447338341023", "2024-02-29", "2023-02-30", "31/12/1999", "8.8.8.8", "999.8.8.8", "123-45-6789",
                              "000-45-6789", "+1 (609) 555-7932", "jo.doe.72@mail3.example.com", "DE89370400440532013000",
                              "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e", "12345"]) + " end"
    df = spark.createDataFrame([(1, text), (2, "see " + cards[0] + "!")], "doc_id bigint, text string")
    out = {r.doc_id: r for r in pii.pseudonymize(df, "k", count_col="found").collect()}
    new, old = out[1].text[2:-4].split(" b "), text[2:-4].split(" b ")
    for i in (0, 1, 2, 4, 6, 7, 9, 11, 12, 13, 14):
        assert new[i] != old[i] and re.sub("[a-z]", "a", re.sub("[0-9]", "9", new[i])) != "" and i == 7 or len(new[i]) == len(old[i])
        assert i in (7, 14) or re.sub("[a-z]", "a", re.sub("[0-9]", "9", new[i])) == re.sub("[a-z]", "a", re.sub("[0-9]", "9", old[i]))
    for i in (3, 5, 8, 10, 15):
        assert new[i] == old[i]
    assert all(luhn(re.sub(r"\D", "", new[i])) and new[i][0] == old[i][0] for i in range(3))
    assert new[0] == new[1].replace(" ", "") and out[2].text == f"see {new[0]}!"
    assert new[12].endswith("@mail3.example.com") and all(0 <= int(o) <= 255 for o in new[7].split("."))
    assert spark.sql(f"select to_date('{new[4]}') is not null as ok").first().ok
    kept = pii.pseudonymize(docs, "k")
    assert kept.columns == docs.columns and kept.where("text is null").count() == 1 and pii.pseudonymize(empty, "k").count() == 0


def test_pseudonyms_after_matches_that_do_not_validate(spark):
    cases = {
        "paid 2019 4111 1111 1111 1111 ok": r"paid 2019 4\d{3} \d{4} \d{4} \d{4} ok", "1 2019 3782 822463 10005 x": r"1 2019 3\d{3} \d{6} \d{5} x",
        "BE68 5390 0754 7034 FROM me": r"BE\d\d \d{4} \d{4} \d{4} FROM me", "XX12 3456 BE68 5390 0754 7034": r"XX12 3456 BE\d\d \d{4} \d{4} \d{4}",
        "on 3/7/2021.": r"on \d{1,2}/\d{1,2}/\d{4}\.", "7.3.2021": r"\d{1,2}\.\d{1,2}\.\d{4}", "2021-3-7": r"\d{4}-\d{1,2}-\d{1,2}",
        "99/99/2021/03/07": r"99/99/\d{4}/\d\d/\d\d", "7 March 2021": r"\d{1,2} [A-Z][a-z]+ \d{4}", "MAR 7th, 2021": r"[A-Z]{3} \d{1,2}(st|nd|rd|th), \d{4}",
        "7. März 2021": r"\d{1,2}\. \w+ \d{4}", "1er août 2021": r"\d{1,2}(er)? \w+ \d{4}", "7 de marzo de 2021": r"\d{1,2} de \w+ de \d{4}",
        "call 555 123 4567 now": r"call \d{3} \d{3} \d{4} now", "+33 1 23 45 67 89": r"\+33 \d \d\d \d\d \d\d \d\d",
        "+33 1 23 45 67 89 4111 1111 1111 1111": r"\+33 \d \d\d \d\d \d\d \d\d 4\d{3} \d{4} \d{4} \d{4}",
        "+49 30 1234567": r"\+49 \d\d \d{7}", "01 23 45 67 89": r"\d\d \d\d \d\d \d\d \d\d",
    }
    two = {"+33 1 23 45 67 89 4111 1111 1111 1111"}
    same = ["31/4/2021", "30 February 2021", "29 Feb 2021", "2019 4111 1111 1111", "0000-1-1", "1.2.3", "in March of 2021", "GB00 1234 5678 FROM", "00000000000000000000000000000000"]
    df = spark.createDataFrame([(v,) for v in [*cases, *same]], "text string").withColumn("old", F.col("text"))
    out = {r.old: r for r in pii.pseudonymize(df, "k", count_col="found").collect()}
    for old, form in cases.items():
        assert re.fullmatch(form, out[old].text) and out[old].text != old and out[old].found == 1 + (old in two), (old, out[old])
    for old in same:
        assert out[old].text == old and out[old].found == 0, out[old]
    assert luhn(re.sub(r"\D", "", out["paid 2019 4111 1111 1111 1111 ok"].text[10:]))


def test_dates_of_other_forms_are_one_to_one(spark):
    day = F.date_add(F.lit("1999-12-20").cast("date"), F.col("id").cast("int"))
    for form in ("M/d/yyyy", "d.M.yyyy", "d MMMM yyyy", "MMM dd, yyyy"):
        got = pii.pseudonymize(spark.range(13, 900).select(F.date_format(day, form).alias("text")), "k", count_col="found")
        assert got.where("found <> 1").count() == 0 and got.select("text").distinct().count() == got.count() == 887, form


def test_permutations_are_one_to_one(spark):
    key = "k"
    n = spark.range(189 * 773).select(pii.permute_number(F.col("id"), 189, 773, key, F.lit("t")).alias("v"))
    assert n.agg(F.count_distinct("v"), F.min("v"), F.max("v")).first() == (146097, 0, 146096)
    s = spark.range(1000).select(pii.permute_string(F.lpad(F.col("id").cast("string"), 3, "0"), "0123456789", key, F.lit("t")).alias("v"))
    assert s.distinct().count() == 1000
    days = spark.sql("select date_format(date_add(to_date('2000-01-01'), cast(id as int)), 'yyyy-MM-dd') d from range(3000)")
    out = days.select(pii.date(F.col("d"), key).alias("v"))
    assert out.where("to_date(v) is null").count() == 0 and out.distinct().count() == 3000


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 460)] + [(7, rows[7][1])]  # many equal vectors, a repeated row
    rows += [(900, None), (901, [1.0] * 7 + [None]), (902, [1.0] * 7 + [float("nan")]), (903, [float("inf")] * 8), (None, [1.0] * 8), (904, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("ids", F.lit("x"))
    good = {i: np.pad(np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(int), (0, 8 - len(v)))
            for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q, a in good.items():
        if q % 20 == 0 or q == 904:
            best = sorted((-int(a @ b), i) for i, b in good.items() if i != q)[:20]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    asked = df.where("vec_id % 20 = 0 or vec_id = 904")
    got = topk.top_products(asked.union(asked), df).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert topk.top_products(df.where("vec_id = 20"), df.where("vec_id in (20, 21)")).collect() == [
        (20, 1, 21, int(good[20] @ good[21]))]
    assert topk.top_products(df.where("false"), df).count() == 0 and topk.top_products(df, df.where("false")).count() == 0


def test_lattice_model(docs, empty, monkeypatch):
    names, logs = lattice_lm.vocabulary(PIECES)
    known = dict(zip(names, logs))

    def brute(word):
        word, sums = b" " + word, [0.0]
        for j in range(1, len(word) + 1):
            terms = [sums[i] + known[word[i:j]] for i in range(max(0, j - 16), j) if word[i:j] in known]
            sums.append(np.logaddexp.reduce(terms))
        return sums[-1]

    words = [b"the", b"unbelievable", "über".encode(), b"x" * 70, b"q"]
    assert np.allclose(lattice_lm.word_scores(words, names, logs), [brute(w) for w in words])
    # expected counts cover every byte once
    counts = lattice_lm.expected_counts(words, np.ones(len(words)), names, logs)
    assert np.isclose((counts * [len(n) for n in names]).sum(), sum(len(w) + 1 for w in words))
    monkeypatch.setattr(lattice_lm, "TOP_WORDS", 30)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: (zlib.crc32(str(i).encode()) % 7 if i is not None else 0) == 2
    c = Counter(w for i, t in rows if not held(i) for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)) + 1, sum(c[w] > 0 for w in [*tokens(t), None]), n,
                   round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in [*tokens(t), None]), 6)) for i, t in rows)
    got = lattice_lm.score_documents(docs, PIECES).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lattice_lm.score_documents(empty, PIECES).count() == 0


def labelled(spark, marked, plain):
    rows = [(i, t, 1) for i, t in enumerate(marked)] + [(1000 + i, t, 0) for i, t in enumerate(plain)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id bigint, y int")
    return docs, labels


def test_string_kernel():
    rows = toxicity.feature_rows([b"idiot"])
    same, gapped, other = toxicity.kernel([b"idiot", b"i-d-i-o-t", b"thention"], rows)[:, 0]
    assert np.isclose(same, 1) and gapped > 0.7 and other < 0.2

    def slow(s, t):
        def features(x):
            out = Counter()
            for i in range(len(x)):
                for j in range(i + 1, len(x)):
                    for k in range(j + 1, min(len(x), i + toxicity.SPAN)):
                        if "".join((x[i], x[j], x[k])).isalpha():
                            out[x[i], x[j], x[k]] += toxicity.DECAY ** (k - i + 1)
            return out
        a, b = features(s), features(t)
        return (sum(a[u] * b[u] for u in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5) ** 2

    for s, t in [("banana", "bandana"), ("idiotic", "i.d.iot"), ("ththth", "thatth")]:
        assert np.isclose(toxicity.kernel([s.encode()], toxicity.feature_rows([t.encode()]))[0, 0], slow(s, t), atol=1e-5)


def test_toxicity(spark, docs, empty):
    r = random.Random(2)
    bad = ["blockhead", "nitwit", "dunderhead"]
    marked = [" ".join([prose(s, 20), r.choice(bad), prose(s + 500, 20), r.choice(bad)]) for s in range(150)]
    table, labels = labelled(spark, marked, [prose(s + 2000, 40) for s in range(300)])
    labels = labels.withColumnRenamed("y", "toxic")
    got = {x.doc_id: x for x in toxicity.classify_toxicity(table, labels).collect()}
    held = [x for x in got.values() if x.held_out]
    assert len(held) > 50 and np.mean([x.predicted == (x.doc_id < 1000) for x in held]) > 0.95
    model = toxicity.fit_toxicity(table, labels)
    more = spark.createDataFrame([(1, prose(9, 30) + " b-l-o-c-k-h-e-a-d n.i.t.w.i.t"), (2, prose(9, 30))], "doc_id bigint, text string")
    scores = {x.doc_id: x.score for x in toxicity.score_toxicity(more, model).collect()}
    assert scores[1] > 0.5 > scores[2]
    odd = toxicity.classify_toxicity(docs, labels.where("false")).collect()
    assert len(odd) == docs.count() and all(0 <= x.score <= 1 and x.predicted == 0 for x in odd)
    assert toxicity.classify_toxicity(empty, labels).count() == 0


def test_quality(spark, docs, empty):
    junk = [" ".join(w + random.Random(s).choice(["***", "$$$"]) for w in prose(s, 90).split(" ")) for s in range(120)]
    table, labels = labelled(spark, [prose(s + 2000, 90) for s in range(240)], junk)
    labels = labels.withColumnRenamed("y", "quality")
    got = quality.classify_quality(table, labels).collect()
    held = [x for x in got if x.held_out]
    assert len(held) > 60 and np.mean([x.predicted == (x.doc_id < 1000) for x in held]) > 0.95
    odd = quality.classify_quality(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= x.score <= 1 for x in odd)
    kept = quality.keep_good(table.withColumn("score", F.lit(1)), table, labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.where("doc_id < 1000").count() > 230 > 240 - kept.count() + 0
    assert quality.classify_quality(empty, labels).count() == 0 and quality.keep_good(empty, docs, labels.where("false")).count() == 0


def test_attention_gradient():
    r = np.random.default_rng(0)
    x, rows, y = r.normal(size=(30, quality.FEATURES)), np.repeat(np.arange(6), 5), np.array([0, 1, 1, 0, 1, 0.0])
    model = quality.train(x, rows, y, hidden=4, epochs=1)

    def loss(m):
        z = quality.attend(m, x, rows)[0]
        return (np.logaddexp(0, z) - y * z).sum()

    logits, kept = quality.attend(model, x, rows)
    grad = quality.gradients(model, kept, quality.sigmoid(logits) - y)
    for name in ("w1", "v", "u", "a", "w2", "b1"):
        at = tuple(0 for _ in model[name].shape)
        step = {k: np.array(v, float) for k, v in model.items()}
        step[name][at] += 1e-6
        assert np.isclose((loss(step) - loss(model)) / 1e-6, grad[name][at], atol=1e-4)
