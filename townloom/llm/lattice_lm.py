"""Language-model scores of whole texts: every segmentation into subwords of a unigram vocabulary counts.

A text is a sequence of words and an end. A word's probability is the sum over all ways to cut its bytes
(with a mark for the blank before it) into pieces of the vocabulary, each with its own probability; single
bytes are pieces too, so every text has a probability. A word of the training texts also has one arc of its
own across the whole lattice, weighted by its count; the share of once-seen words (Good-Turing) is what the
subwords keep. Pieces never run across blanks, so the lattice of a text falls apart into those of its words,
and each distinct word is summed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townloom.llm.bytesops import (BASE, INVERSE, HashSlots, byte_values, lower_ascii, mix, powers, spans_hash,
                                   text_bytes, texts_of, word_spans)
from townloom.llm.labelled import fold
from townloom.llm.wordcodes import batches_by_bytes
from townloom.session import cut

COUNT_BYTES = 8 << 20  # text whose words are counted together before the shuffle
TOP_WORDS = 300_000  # the commonest words travel to all tasks (24 bytes each); the others are joined
CELLS = 400_000  # lattice cells held at once, fewer where pieces have more than 16 bytes
SMOOTHING = 0.1  # expected count added to every piece
ROUNDS = 3  # of expectation maximisation


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The usable pieces of a sentencepiece model and starting log-probabilities from its scores.

    The blank's mark becomes a space. A model whose scores are ranks (0, -1, -2, ...) starts from weights
    1 / (10 + rank); one with log-probabilities from these. The 256 bytes are added where they are missing.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:]:
            pieces[piece] = model.get_score(i)
    scores = np.array(list(pieces.values()))
    if len(scores) and scores.min() < -1000:
        scores = -np.log(10 - scores)
    floor = scores.min() if len(scores) else 0.0
    names = [*pieces, *(b for b in (bytes([c]) for c in range(256)) if b not in pieces)]
    weights = np.exp(np.append(scores, np.full(len(names) - len(scores), floor)))
    return names, np.log(weights / weights.sum())


def piece_index(names: list[bytes]) -> HashSlots:
    """Piece numbers by hash."""
    ends = np.cumsum([len(n) for n in names])
    keys = spans_hash(np.frombuffer(b"".join(names), np.uint8), ends - [len(n) for n in names], ends)
    index = HashSlots(17)
    index.add(keys)
    return index


def lattices(words: list[bytes], names: list[bytes]):
    """For words of one length at a time: their positions and the piece of every substring.

    pieces[k - 1][:, i] is the piece that starts at byte i and has k bytes, or -1.
    """
    index = piece_index(names)
    values, longest = byte_values(), max(map(len, names))
    sizes = np.array([len(w) + 1 for w in words])
    for size in np.unique(sizes).tolist():
        everyone = np.flatnonzero(sizes == size)
        forth, back = powers(BASE, size), powers(INVERSE, size)
        step = max(1, CELLS * 16 // (size * max(16, min(longest, size))))
        for a in range(0, len(everyone), step):
            at = everyone[a:a + step]
            codes = np.frombuffer(b"".join(b" " + words[i] for i in at.tolist()), np.uint8).reshape(-1, size)
            sums = np.zeros((len(at), size + 1), np.uint64)
            np.cumsum(values[codes] * forth[:size], axis=1, out=sums[:, 1:])
            pieces = []
            for k in range(1, min(longest, size) + 1):
                keys = mix((sums[:, k:] - sums[:, :-k]) * back[:size - k + 1] + np.uint64(k))
                pieces.append(index.find(keys.ravel()).reshape(keys.shape))
            yield at, size, pieces


def log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(terms)
    top = stacked.max(axis=0)
    return top + np.log(np.exp(stacked - top).sum(axis=0))


def forward(pieces: list[np.ndarray], scores: np.ndarray, size: int) -> np.ndarray:
    """Log-probability of every prefix: alpha[:, j] sums over the last piece."""
    alpha = np.zeros((len(pieces[0]), size + 1))
    for j in range(1, size + 1):
        alpha[:, j] = log_sum([alpha[:, j - k] + scores[pieces[k - 1][:, j - k]] for k in range(1, min(len(pieces), j) + 1)])
    return alpha


def backward(pieces: list[np.ndarray], scores: np.ndarray, size: int) -> np.ndarray:
    beta = np.zeros((len(pieces[0]), size + 1))
    for i in range(size - 1, -1, -1):
        beta[:, i] = log_sum([beta[:, i + k] + scores[pieces[k - 1][:, i]] for k in range(1, min(len(pieces), size - i) + 1)])
    return beta


def word_scores(words: list[bytes], names: list[bytes], logs: np.ndarray) -> np.ndarray:
    """Natural log-probability of each word, marginal over its segmentations."""
    scores, out = np.append(logs, -np.inf), np.zeros(len(words))
    for at, size, pieces in lattices(words, names):
        out[at] = forward(pieces, scores, size)[:, size]
    return out


def expected_counts(words: list[bytes], times: np.ndarray, names: list[bytes], logs: np.ndarray) -> np.ndarray:
    """How often each piece occurs, weighted by the posterior of the segmentations and the words' counts."""
    scores, out = np.append(logs, -np.inf), np.zeros(len(names) + 1)
    for at, size, pieces in lattices(words, names):
        alpha, beta = forward(pieces, scores, size), backward(pieces, scores, size)
        for k, found in enumerate(pieces, 1):
            share = np.exp(alpha[:, :size - k + 1] + scores[found] + beta[:, k:] - alpha[:, size:]) * times[at][:, None]
            out += np.bincount(np.where(found < 0, len(names), found).ravel(), share.ravel(), minlength=len(names) + 1)
    return out[:-1]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every lower-cased word of all texts and how often training texts hold it (0 too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            train = np.asarray(batch.column(1)).astype(np.float64)
            for i, j in batches_by_bytes(offsets, COUNT_BYTES):
                low = lower_ascii(raw[offsets[i]:offsets[j]])
                starts, ends, rows = word_spans(low, offsets[i:j + 1] - offsets[i])
                _, first, inverse = np.unique(spans_hash(low, starts, ends), return_index=True, return_inverse=True)
                counts = np.bincount(inverse, train[i:j][rows], minlength=len(first)).astype(np.int64)
                yield pa.record_batch([pa.array(texts_of(low, starts[first], ends[first]), pa.binary()), pa.array(counts)],
                                      names=["word", "c"])

    return docs.select("text", "train").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def spread(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fit_pieces(words: DataFrame, names: list[bytes], logs: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
    """Log-probabilities of the pieces and of the end, by expectation maximisation over all training words.

    Each distinct word counts once, since common words have arcs of their own and subwords speak for new ones.
    The sums that reach the driver have one row per piece of the vocabulary.
    """
    for _ in range(ROUNDS):
        def run(batches: Iterator[pa.RecordBatch], logs=logs) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(names))
            for batch in batches:
                total += expected_counts(batch.column(0).to_pylist(), np.ones(len(batch)), names, logs)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        sums = words.where("c > 0").mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = np.full(len(names), SMOOTHING)
        for row in sums.collect():
            counts[row.piece] += row.n
        logs = np.log(counts / (counts.sum() + ends + 1))
    return logs, float(np.log((ends + 1) / (counts.sum() + ends + 1)))


def score_documents(df: DataFrame, model_path: str, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Documents outside the held-out fold are the training texts: their words are counted exactly, over all
    rows, and the pieces' probabilities are fitted to these counts. base_score is the add-one word model,
    score the lattice model, both log10 of the probability of the whole text with its end. Null and empty
    texts are the end alone. Repeated rows are scored (and counted) as often as they occur; a null id
    counts as fold 0; an empty table gives an empty one.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("train", fold(F.col("doc_id"), folds) != held)
    names, logs = vocabulary(model_path)
    words = cut(spread(word_counts(docs)))
    known = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"),
                      F.sum((F.col("c") == 1).cast("long")).alias("once")).first()
    ends = docs.where("train").count()
    n, v = (known.n or 0) + ends, (known.v or 0) + (ends > 0)
    logs, end_log = fit_pieces(words, names, logs, ends)
    subwords = ((known.once or 0) + 1) / (n + 2)  # what the lattices of subwords weigh in all

    def with_arc(lattice: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of the probability with the arc of a word counted c times."""
        whole = np.log(np.maximum(c, 1e-300) / max(n, 1)) + np.log(1 - subwords)
        return np.where(c > 0, np.logaddexp(whole, lattice + np.log(subwords)), lattice + np.log(subwords if n else 1)) / np.log(10)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            stops = np.cumsum(sizes)
            keys = spans_hash(np.frombuffer(b"".join(texts), np.uint8), stops - sizes, stops)
            yield pa.record_batch([pa.array(keys.view(np.int64)), batch.column(1),
                                   pa.array(with_arc(word_scores(texts, names, logs), np.asarray(batch.column(1))))], names=["key", "c", "log10p"])

    rated = cut(words.mapInArrow(rate, "key bigint, c bigint, log10p double"))
    top = rated.orderBy(F.col("c").desc(), "key").limit(TOP_WORDS).toArrow()
    top_keys, top_c, top_p = (np.asarray(top.column(i)) for i in range(3))
    order = np.argsort(top_keys.view(np.uint64))
    top_keys, top_c, top_p = top_keys.view(np.uint64)[order], top_c[order], top_p[order]
    base = np.log10((top_c + 1) / (n + v + 1))
    end_base, end_score = float(np.log10((ends + 1) / (n + v + 1))), float(with_arc(np.array(end_log), np.array(ends)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashSlots(20)
        index.add(np.where(top_keys == 0, np.uint64(1), top_keys))
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in batches_by_bytes(offsets):
                low, rows_n = lower_ascii(raw[offsets[i]:offsets[j]]), j - i
                starts, ends_at, rows = word_spans(low, offsets[i:j + 1] - offsets[i])
                keys = spans_hash(low, starts, ends_at)
                slot = index.find(np.where(keys == 0, np.uint64(1), keys))
                hit = slot >= 0
                found, owner = slot[hit], rows[hit]
                rare = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(rows[~hit], np.arange(rows_n + 1)).astype(np.int32)), pa.array(keys[~hit].view(np.int64)))
                yield pa.record_batch([
                    pa.array(row_id + np.arange(rows_n)), batch.column(0).slice(i, rows_n), batch.column(2).slice(i, rows_n),
                    pa.array(np.bincount(rows, minlength=rows_n) + 1),
                    pa.array((np.bincount(owner, top_c[found] > 0, minlength=rows_n) + (ends > 0)).astype(np.int64)),
                    pa.array(np.bincount(owner, base[found], minlength=rows_n) + end_base),
                    pa.array(np.bincount(owner, top_p[found], minlength=rows_n) + end_score), rare],
                    names=["row_id", "doc_id", "train", "n_tokens", "n_known", "base_score", "score", "rare"])
                row_id += rows_n

    # the rows' numbers hold only for this materialisation
    rows = cut(docs.mapInArrow(run, "row_id bigint, doc_id bigint, train boolean, n_tokens bigint, n_known bigint, "
                                    "base_score double, score double, rare array<bigint>"))
    rest = rows.select("row_id", F.explode("rare").alias("key")).join(rated, "key").groupBy("row_id").agg(
        F.sum((F.col("c") > 0).cast("long")).alias("more_known"),
        F.sum(F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("more_base"), F.sum("log10p").alias("more"))
    none = F.lit(0)
    return rows.drop("rare").join(rest, "row_id", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", none)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more_base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("more", none)).alias("score"))
