"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear support vector machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townloom.llm.bytesops import HashSlots, lower_ascii, spans_hash, text_bytes, texts_of, word_spans, worker_store
from townloom.llm.labelled import SAMPLE_DOCS, fold, labelled_sample, sigmoid
from townloom.llm.wordcodes import batches_by_bytes

DECAY = 0.7  # weight of each place that a subsequence spans
SPAN = 7  # places that a subsequence of three letters may span
UNIT_BYTES = 24  # longer words are read in windows of this size that overlap by half
PREFIXES = (4, 6)  # the first bytes of words that are longer by three are units of their own: stems
TOXIC_LANDMARKS, PLAIN_LANDMARKS = 64, 12
ALIKE = 0.35  # landmarks are no more alike than this
ALPHABET = 32
FLOOR = 0.2  # kernel values below count as no match
CACHE_UNITS = 1_500_000
# digits and signs often written for letters
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


def letter_codes() -> np.ndarray:
    """0 to 25 for letters and what stands for them, up to 31 for letters beyond ASCII by their last byte,
    -1 for bytes that only fill a gap."""
    codes = np.full(256, -1, np.int64)
    codes[128:192] = 26 + np.arange(64) % 6
    codes[97:123] = codes[65:91] = np.arange(26)
    for sign, letter in LOOKALIKES.items():
        codes[ord(sign)] = ord(letter) - 97
    return codes


def subsequences(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For units of one length (n x L letter codes): numbers of all letter triples and their weights."""
    length = units.shape[1]
    numbers, weights = [], []
    for span in range(3, min(SPAN, length) + 1):
        for mid in range(1, span - 1):
            a, b, c = units[:, :length - span + 1], units[:, mid:length - span + 1 + mid], units[:, span - 1:]
            numbers.append((a * ALPHABET + b) * ALPHABET + c)
            weights.append(np.where((a >= 0) & (b >= 0) & (c >= 0), np.float32(DECAY ** span), np.float32(0)))
    if not numbers:
        return np.zeros((len(units), 0), np.int64), np.zeros((len(units), 0), np.float32)
    numbers, weights = np.concatenate(numbers, axis=1), np.concatenate(weights, axis=1)
    return np.where(weights > 0, numbers, 0), weights


def by_length(units: list[bytes]):
    """Positions and letter codes of the units of each length."""
    sizes, codes = np.array([len(u) for u in units]), letter_codes()
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        if n:
            yield at, codes[np.frombuffer(b"".join(units[i] for i in at.tolist()), np.uint8)].reshape(-1, n)


def feature_rows(landmarks: list[bytes]) -> np.ndarray:
    """Triples x landmarks: each landmark's unit-length vector of weighted subsequences."""
    out = np.zeros((ALPHABET ** 3, len(landmarks)), np.float32)
    for at, codes in by_length(landmarks):
        numbers, weights = subsequences(codes)
        for j, i in enumerate(at.tolist()):
            np.add.at(out[:, i], numbers[j], weights[j])
    return out / np.maximum(np.sqrt((out ** 2).sum(axis=0)), 1e-9)


def kernel(units: list[bytes], rows: np.ndarray) -> np.ndarray:
    """Squared normalised kernel of every unit with every landmark."""
    out = np.zeros((len(units), rows.shape[1]), np.float32)
    for at, codes in by_length(units):
        for i in range(0, len(at), 4000):
            numbers, weights = subsequences(codes[i:i + 4000])
            if not numbers.shape[1]:
                continue
            dots = np.zeros((len(numbers), rows.shape[1]), np.float32)
            for t in range(numbers.shape[1]):
                dots += weights[:, t, None] * rows[numbers[:, t]]
            # squared length: weights of equal triples add up first
            order = np.argsort(numbers, axis=1)
            n, w = np.take_along_axis(numbers, order, 1), np.take_along_axis(weights, order, 1)
            fresh = np.concatenate([np.ones((len(n), 1), bool), n[:, 1:] != n[:, :-1]], axis=1).ravel()
            sums = np.add.reduceat(w.ravel(), np.flatnonzero(fresh)) ** 2
            owner = np.repeat(np.arange(len(n)), n.shape[1])[fresh]
            norm = np.sqrt(np.bincount(owner, sums, minlength=len(n)))
            out[at[i:i + 4000]] = dots / np.maximum(norm, 1e-9)[:, None]
    return out ** 2


def unit_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without the signs around them, in windows if long: starts, ends and rows, ascending."""
    starts, ends, rows = word_spans(raw, offsets)
    codes = letter_codes()
    solid = (codes[raw] >= 0) | (raw >= 128)
    at = np.arange(len(raw))
    nxt = np.minimum.accumulate(np.where(solid, at, len(raw))[::-1])[::-1] if len(raw) else at
    prv = np.maximum.accumulate(np.where(solid, at, -1)) if len(raw) else at
    starts, ends = nxt[starts] if len(starts) else starts, (prv[ends - 1] + 1 if len(ends) else ends)
    good = starts < ends
    starts, ends, rows = starts[good], ends[good], rows[good]
    step = UNIT_BYTES // 2
    windows = np.maximum(-(-(ends - starts - UNIT_BYTES) // step) + 1, 1)
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    s, e = np.repeat(starts, windows) + nth * step, np.repeat(ends, windows)
    return s, np.minimum(s + UNIT_BYTES, e), np.repeat(rows, windows)


def unit_groups(raw: np.ndarray, offsets: np.ndarray):
    """The words' units and those of their stems; spans ascend within each group."""
    starts, ends, rows = unit_spans(raw, offsets)
    yield starts, ends, rows
    for n in PREFIXES:
        longer = ends - starts >= n + 3
        yield starts[longer], starts[longer] + n, rows[longer]


def spelled_units(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Runs of three or more one-letter words of a row, read as one unit (in windows)."""
    single = (ends - starts) == 1
    if not single.any():
        return [], []
    joined = single & np.concatenate([[False], single[:-1] & (rows[1:] == rows[:-1])])
    group = np.cumsum(~joined)[single]
    letters, owner = raw[starts[single]], rows[single]
    units, owners = [], []
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(cuts, len(group)))
    for a, n in zip(cuts[sizes >= 3].tolist(), sizes[sizes >= 3].tolist()):
        text = letters[a:a + n].tobytes()
        for i in range(0, max(n - UNIT_BYTES, 0) + 1, UNIT_BYTES // 2):
            units.append(text[i:i + UNIT_BYTES])
            owners.append(int(owner[a]))
        if n > UNIT_BYTES:
            units.append(text[-UNIT_BYTES:])
            owners.append(int(owner[a]))
    return units, owners


class Matcher:
    """Best match of each landmark in every row; the distinct units are compared once per worker."""

    def __init__(self, landmarks: list[bytes]):
        self.rows = feature_rows(landmarks)
        self.width = len(landmarks)
        self.clear()

    def clear(self) -> None:
        self.known = HashSlots(21)
        self.where = np.zeros(1 << 16, np.int32)  # row of `values` by slot, -1 without any match
        self.values = np.zeros((1 << 12, self.width), np.float32)
        self.used = 0

    def compare(self, units: list[bytes]) -> np.ndarray:
        found = kernel(units, self.rows)
        return np.where(found >= FLOOR, found, 0)

    def learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        found = self.compare(units)
        hit = found.any(axis=1)
        slots = self.known.add(keys)
        while self.known.size > len(self.where):
            self.where = np.resize(self.where, 2 * len(self.where))
        while self.used + int(hit.sum()) > len(self.values):
            self.values = np.resize(self.values, (2 * len(self.values), self.width))
        self.where[slots] = np.where(hit, self.used + np.cumsum(hit) - 1, -1)
        self.values[self.used:self.used + int(hit.sum())] = found[hit]
        self.used += int(hit.sum())

    def slots(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = spans_hash(raw, starts, ends)
        keys[keys == 0] = 1
        out = self.known.find(keys)
        if (new := np.flatnonzero(out < 0)).size:
            fresh, at = np.unique(keys[new], return_index=True)
            for i in range(0, len(fresh), 20_000):
                chosen = new[at[i:i + 20_000]]
                self.learn(fresh[i:i + 20_000], texts_of(raw, starts[chosen], ends[chosen]))
            out[new] = self.known.find(keys[new])
        return out

    def best(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        low = lower_ascii(raw)
        if self.known.size > CACHE_UNITS:
            self.clear()
        out = np.zeros((len(offsets) - 1, self.width), np.float32)
        for starts, ends, rows in unit_groups(low, offsets):
            slots = self.slots(low, starts, ends)  # before `where` is read: it may grow
            at = self.where[slots]
            hit = at >= 0
            if hit.any():
                owner = rows[hit]
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                top = np.maximum.reduceat(self.values[at[hit]], first, axis=0)
                out[owner[first]] = np.maximum(out[owner[first]], top)
        units, owners = spelled_units(low, *unit_spans(low, offsets))
        if units:
            np.maximum.at(out, np.array(owners), self.compare(units))
        return out


def worker_matcher(landmarks: list[bytes]) -> Matcher:
    store = worker_store("matchers")
    key = tuple(landmarks)
    if key not in store:
        store.clear()
        store[key] = Matcher(landmarks)
    return store[key]


def choose_landmarks(sample: DataFrame) -> list[bytes]:
    """Units of the labelled texts that mark toxic ones most clearly, and the commonest others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            marks = np.asarray(batch.column(2))
            for i, j in batches_by_bytes(offsets):
                low = lower_ascii(raw[offsets[i]:offsets[j]])
                for starts, ends, rows in unit_groups(low, offsets[i:j + 1] - offsets[i]):
                    fit = (ends - starts >= 4) & (ends - starts <= 16)
                    starts, ends, rows = starts[fit], ends[fit], rows[fit]
                    keys = spans_hash(low, starts, ends) ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    once = np.sort(np.unique(keys, return_index=True)[1])
                    units = texts_of(low, starts[once], ends[once])
                    yield pa.record_batch([pa.array(units, pa.binary()), pa.array(marks[i:j][rows[once]].astype(np.int32))],
                                          names=["unit", "y"])

    counts = sample.mapInArrow(run, "unit binary, y int").groupBy("unit").agg(
        F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("plain")).where("toxic + plain >= 3")
    totals = sample.agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("p")).first()
    if not totals.t or not totals.p:
        return []
    share = (F.col("toxic") + 0.5) / (totals.t + 1), (F.col("plain") + 0.5) / (totals.p + 1)
    clear = F.log(share[0] / share[1]) * F.sqrt(share[0])
    toxic = counts.where("toxic >= 3").orderBy(clear.desc(), "unit").limit(20 * TOXIC_LANDMARKS).collect()
    plain = counts.orderBy(F.col("plain").desc(), "unit").limit(20 * PLAIN_LANDMARKS).collect()
    chosen: list[bytes] = []
    for candidates, most in ((toxic, TOXIC_LANDMARKS), (plain, TOXIC_LANDMARKS + PLAIN_LANDMARKS)):
        units = [bytes(r.unit) for r in candidates]
        if units:
            like = kernel(units, feature_rows(units))
            taken = kernel(units, feature_rows(chosen)).max(axis=1) if chosen else np.zeros(len(units))
            for i, unit in enumerate(units):
                if len(chosen) < most and taken[i] <= ALIKE:
                    chosen.append(unit)
                    taken = np.maximum(taken, like[:, i])
    return chosen


def train_machine(z: np.ndarray, y: np.ndarray, cost: float = 1.0, steps: int = 600) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, balanced classes) by accelerated gradient descent."""
    sign = np.where(y > 0, 1.0, -1.0)
    each = np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    each = each * cost / len(y) * 100
    x = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    rate = 1 / (1 + 2 * each.max() * np.linalg.eigvalsh(x.T @ x)[-1])
    w = ahead = np.zeros(x.shape[1])
    for k in range(steps):
        slack = np.maximum(1 - sign * (x @ ahead), 0)
        grad = np.append(ahead[:-1], 0) - 2 * x.T @ (each * sign * slack)
        new = ahead - rate * grad
        ahead, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the margins: smoothed targets, the rarer class counts more."""
    ones, zeros = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    each = np.sqrt(np.where(y > 0, len(y) / (2 * max(ones, 1)), len(y) / (2 * max(zeros, 1))))
    x, w = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        hess = (x * (each * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (each * (p - target)))
        w = w - step / max(1.0, np.abs(step).max())
    return float(w[0]), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0,
                 limit: int = SAMPLE_DOCS) -> dict:
    """Landmarks, weights and calibration from at most `limit` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, folds, held, limit)
    landmarks = choose_landmarks(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = worker_matcher(landmarks)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in batches_by_bytes(offsets):
                best = matcher.best(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([b.tobytes() for b in best], pa.binary()),
                                       batch.column(2).slice(i, j - i)], names=["doc_id", "best", "y"])

    rows = sample.mapInArrow(run, "doc_id bigint, best binary, y int").limit(limit).collect() if landmarks else []
    if not rows:
        counts = sample.agg(F.sum("y").alias("t"), F.count("y").alias("n")).first()
        return {"landmarks": [], "shift": float(np.log(((counts.t or 0) + 0.5) / (counts.n - (counts.t or 0) + 1)))}
    rows.sort(key=lambda r: (r.doc_id, bytes(r.best)))
    best = np.stack([np.frombuffer(r.best, np.float32) for r in rows]).astype(np.float64)
    y = np.array([r.y for r in rows], np.float64)
    # Nystroem: the landmarks' own kernel matrix to the power -1/2
    own, vectors = np.linalg.eigh(kernel(landmarks, feature_rows(landmarks)).astype(np.float64))
    keep = own > 1e-4
    inverse = (vectors[:, keep] / np.sqrt(own[keep])) @ vectors[:, keep].T
    w, b = train_machine(best @ inverse, y)
    slope, shift = calibrate(best @ (inverse @ w) + b, y)
    return {"landmarks": landmarks, "weights": slope * (inverse @ w), "shift": slope * b + shift}


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score, the probability of toxicity, of every row by its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = worker_matcher(model["landmarks"]) if model["landmarks"] else None
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            margins = [np.zeros(0)]
            for i, j in batches_by_bytes(offsets):
                margin = np.full(j - i, model["shift"])
                if matcher:
                    best = matcher.best(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                    margin = margin + best.astype(np.float64) @ model["weights"]
                margins.append(margin)
            yield pa.record_batch([batch.column(0), pa.array(sigmoid(np.concatenate(margins)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    A text stands for its best match with every landmark over all its units: words without the signs around
    them, windows of long words, and runs of single letters. The kernel compares weighted letter
    subsequences with gaps, so that inserted characters lower a match only a little. Null and empty texts
    match nothing and get the score of a text without matches; rows repeat as they do in the table.
    """
    scored = score_toxicity(docs, fit_toxicity(docs, labels, "toxic", folds, held))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
