"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from townloom.llm.bytesops import lower_ascii, mix, release_caches, spans_hash, text_bytes, word_spans
from townloom.llm.labelled import SAMPLE_DOCS, fold, labelled_sample, sigmoid
from townloom.llm.wordcodes import batches_by_bytes

PASSAGE_WORDS = 64
SAMPLE_PASSAGES = 2_000  # a training document with more passages is left out of the sample
FEATURES = 14


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (PASSAGE_WORDS words) of every row, and the row of each passage.

    A row without words has one passage of zeros.
    """
    n = len(offsets) - 1
    starts, ends, rows = word_spans(raw, offsets)
    words = np.bincount(rows, minlength=n)
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    per = np.maximum(-(-words // PASSAGE_WORDS), 1)
    first = np.cumsum(per) - per
    passage = first[rows] + nth // PASSAGE_WORDS
    total = int(per.sum())
    size = np.bincount(passage, minlength=total).astype(np.float64)

    def counted(mask: np.ndarray) -> np.ndarray:
        """Occurrences of a kind of byte in each word."""
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return sums[ends] - sums[starts]

    letters = counted((raw >= 65) & (raw <= 90) | (raw >= 97) & (raw <= 122) | (raw >= 128))
    upper = counted((raw >= 65) & (raw <= 90))
    digits = counted((raw >= 48) & (raw <= 57))
    stops = counted((raw == 46) | (raw == 44) | (raw == 59) | (raw == 58))
    marks = counted(((raw >= 33) & (raw <= 47) | (raw >= 58) & (raw <= 64) | (raw >= 91) & (raw <= 96)
                     | (raw >= 123) & (raw <= 126)) & (raw != 46) & (raw != 44))
    length = ends - starts
    keys = spans_hash(lower_ascii(raw), starts, ends)
    before = np.concatenate([np.zeros(1, np.uint64), keys[:-1]]) if len(keys) else keys
    pair = mix(keys ^ mix(before + np.uint64(1)))
    in_row = mix(rows.astype(np.uint64) + np.uint64(11))

    def seen(values: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether the value occurred before in its group."""
        out = np.ones(len(values), bool)
        out[np.unique(values ^ group, return_index=True)[1]] = False
        return out

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, values, minlength=total) / np.maximum(size, 1)

    chars = np.maximum(mean(length), 1e-9)
    newline = np.concatenate([[0], np.cumsum(raw == 10, dtype=np.int64)])
    lines = newline[starts] - newline[np.concatenate([[0], ends[:-1]])] if len(starts) else starts
    out = np.stack([
        mean(upper) / chars, mean(digits) / chars, mean(stops) / chars, mean(marks) / chars,
        mean(letters) / chars, np.log1p(chars), mean((letters > 0) & (upper == letters) & (letters > 1)),
        mean(marks >= 2), mean(marks == length), mean(seen(keys, in_row)), mean(seen(pair, in_row)),
        mean(seen(keys, mix(passage.astype(np.uint64) + np.uint64(7)))), mean(lines > 0), np.log1p(size) / 4], axis=1)
    out[size == 0] = 0
    return out.astype(np.float32), np.repeat(np.arange(n), per)


def attend(model: dict, x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logit of every bag: passages are encoded, weighted by gated attention, summed and scored."""
    x = (x - model["mean"]) / model["scale"]
    h = np.tanh(x @ model["w1"] + model["b1"])
    v, u = np.tanh(h @ model["v"]), sigmoid(h @ model["u"])
    s = (v * u) @ model["a"]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    s = s - np.repeat(np.maximum.reduceat(s, first), np.diff(np.append(first, len(s))))
    e = np.exp(s)
    weight = e / np.repeat(np.add.reduceat(e, first), np.diff(np.append(first, len(s))))
    z = np.add.reduceat(weight[:, None] * h, first, axis=0)
    return z @ model["w2"] + model["b2"], {"x": x, "h": h, "v": v, "u": u, "weight": weight, "z": z, "first": first}


def gradients(model: dict, kept: dict, error: np.ndarray) -> dict:
    """Derivatives of the summed loss; `error` is that of each bag's logit."""
    h, v, u, weight, first = (kept[k] for k in ("h", "v", "u", "weight", "first"))
    sizes = np.diff(np.append(first, len(h)))
    dz = np.repeat(error[:, None] * model["w2"], sizes, axis=0)
    dw = (dz * h).sum(axis=1)
    ds = weight * (dw - np.repeat(np.add.reduceat(weight * dw, first), sizes))
    dv, du = ds[:, None] * model["a"] * u * (1 - v * v), ds[:, None] * model["a"] * v * u * (1 - u)
    dh = (weight[:, None] * dz + dv @ model["v"].T + du @ model["u"].T) * (1 - h * h)
    return {"w2": kept["z"].T @ error, "b2": error.sum(), "a": (v * u).T @ ds, "v": h.T @ dv, "u": h.T @ du,
            "w1": kept["x"].T @ dh, "b1": dh.sum(axis=0)}


def train(x: np.ndarray, rows: np.ndarray, y: np.ndarray, hidden: int = 16, epochs: int = 30, batch: int = 256,
          rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> dict:
    """Adam on the logistic loss of the bags. Without both labels the model is the smoothed share of label 1."""
    rng = np.random.default_rng(seed)
    model = {"mean": x.mean(axis=0) if len(x) else np.zeros(FEATURES), "scale": x.std(axis=0) + 1e-3 if len(x) else np.ones(FEATURES),
             "w1": rng.normal(0, FEATURES ** -0.5, (FEATURES, hidden)), "b1": np.zeros(hidden),
             "v": rng.normal(0, hidden ** -0.5, (hidden, hidden)), "u": rng.normal(0, hidden ** -0.5, (hidden, hidden)),
             "a": np.zeros(hidden), "w2": np.zeros(hidden), "b2": np.log((y.sum() + 1) / (len(y) - y.sum() + 1))}
    if len(np.unique(y)) < 2:
        return model
    names, steps = ["w1", "b1", "v", "u", "a", "w2", "b2"], 0
    model["a"], model["w2"] = rng.normal(0, 0.1, hidden), rng.normal(0, 0.1, hidden)
    m, s = ({k: np.zeros_like(model[k]) for k in names} for _ in range(2))
    ends = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            bags = order[i:i + batch]
            sizes = ends[bags + 1] - ends[bags]
            take = np.repeat(ends[bags] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            logits, kept = attend(model, x[take], np.repeat(np.arange(len(bags)), sizes))
            grad, steps = gradients(model, kept, (sigmoid(logits) - y[bags]) / len(bags)), steps + 1
            for k in names:
                g = grad[k] + decay * model[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                model[k] = model[k] - rate * (m[k] / (1 - 0.9 ** steps)) / (np.sqrt(s[k] / (1 - 0.999 ** steps)) + 1e-8)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1,
                limit: int = SAMPLE_DOCS) -> dict:
    """A model from at most `limit` labelled documents outside the held-out fold (see labelled_sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in batches_by_bytes(offsets):
                x, rows = passages(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ends = np.cumsum(np.bincount(rows, minlength=j - i))
                data = [x[a:b].tobytes() for a, b in zip((ends - np.bincount(rows, minlength=j - i)).tolist(), ends.tolist())]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(data, pa.binary()),
                                       batch.column(2).slice(i, j - i)], names=["doc_id", "x", "y"])

    found = labelled_sample(docs, labels, label, folds, held, limit).mapInArrow(run, "doc_id bigint, x binary, y int")
    bags = sorted(found.where(F.octet_length("x") <= 4 * FEATURES * SAMPLE_PASSAGES).limit(limit).collect(),
                  key=lambda r: (r.doc_id, bytes(r.x)))
    x = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in bags]
    rows = np.repeat(np.arange(len(x)), [len(b) for b in x])
    return train(np.concatenate(x) if x else np.zeros((0, FEATURES)), rows, np.array([r.y for r in bags], np.float64))


def score_quality(docs: DataFrame, model: dict, score_col: str = "quality_score") -> DataFrame:
    """Adds a column with the probability of good quality to every row, from all passages of its whole text.

    Null and empty texts count as one empty passage. Rows and other columns are kept as they are.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            raw, offsets = text_bytes(batch.column(at))
            scores = [np.zeros(0)]
            for i, j in batches_by_bytes(offsets):
                x, rows = passages(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                scores.append(sigmoid(attend(model, x, rows)[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def keep_good(df: DataFrame, docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """The rows of `df` with a score of at least 0.5 under a model fitted to the labelled ones of `docs`."""
    own = max([*df.columns, ""], key=len) + "_score"  # no column of df has this name
    scored = score_quality(df, fit_quality(docs, labels, "quality", folds, held), own)
    return scored.where(F.col(own) >= 0.5).drop(own)


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fit_quality(docs, labels, "quality", folds, held)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"),
                         F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
