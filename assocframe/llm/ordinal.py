"""Cumulative-link ordinal regression on sparse text features.

Grades 0 .. K-1 have ordered thresholds t_1 < ... < t_{K-1}; a text's score is
one weighted sum of its features, shared by all thresholds, and
P(grade >= k) = sigmoid(score - t_k). The expected grade is the sum of these
tail probabilities.

Features are 64-bit hashes of words (folded to lower case), of the first four
characters of longer words, which inflected forms share, and of word shapes:
the classes of a word's characters, runs cut to two. Values are presence, or
the root of the share of the text's words. Of the features in at least `min_docs` training
rows, those are kept whose score test against the model without features
exceeds `z`; hashes aren't folded into buckets.

The fit is Newton's method by coordinates, on the exact likelihood with a ridge
penalty, in numpy, from a bounded sample of labelled rows: those with the
smallest hash of doc_id. Its bound is the parameter `sample`. Scoring reads
every row, whole text by whole text, in passes over Arrow's buffers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assocframe.llm.text import buffers, byte_values, slices, span_hashes, word_spans

#: Labelled rows that a fit takes at most.
SAMPLE = 8_000
_SHAPE, _STEM = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def shape_classes() -> np.ndarray:
    """For each byte the byte that stands for its class: letters of either case,
    digits, bytes of other characters; symbols stand for themselves."""
    c = np.arange(256, dtype=np.uint8)
    c[ord("a") : ord("z") + 1] = ord("a")
    c[ord("A") : ord("Z") + 1] = ord("A")
    c[ord("0") : ord("9") + 1] = ord("0")
    c[128:] = ord("a")
    return c


_CLASSES = shape_classes()


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words' shapes: classes, with runs longer than two cut."""
    c = _CLASSES[data]
    same = np.zeros(len(c), bool)
    same[2:] = (c[2:] == c[1:-1]) & (c[1:-1] == c[:-2])
    first = np.zeros(len(c), bool)
    first[starts] = True
    if len(c) > 1:
        first[starts[starts + 1 < len(c)] + 1] = True  # a word's first two bytes stay
    keep = ~same | first
    place = np.append(0, np.cumsum(keep))
    return span_hashes(c[keep], place[starts], place[ends], byte_values(fold=False)) ^ _SHAPE


def _stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first characters of longer words, and which words these are."""
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    until = chars[np.minimum(np.searchsorted(chars, starts) + length, len(chars) - 1)]
    longer = np.flatnonzero(until < ends)
    return span_hashes(data, starts[longer], until[longer], byte_values(fold=True)) ^ _STEM, longer


def features(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all features with their texts' indices, and each text's number
    of words."""
    data, at = buffers(part.column(text))
    starts, ends, first = word_spans(data, at)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    stems, longer = _stems(data, starts, ends)
    return np.concatenate([span_hashes(data, starts, ends, byte_values(fold=True)), _shapes(data, starts, ends), stems]), np.concatenate([owner, owner, owner[longer]]), count


@dataclass(frozen=True)
class Model:
    """keys: sorted feature hashes; weights; thresholds, ascending; share:
    whether values are roots of shares of the words, or presence."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    share: bool

    def scores(self, part: pa.RecordBatch, text: str) -> np.ndarray:
        hashes, owner, count = features(part, text)
        out = np.zeros(len(count))
        if not len(self.keys):
            return out
        spot = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[spot] == hashes
        d, f = owner[hit], spot[hit]
        pair, times = np.unique(d * len(self.keys) + f, return_counts=True)
        d, f = pair // len(self.keys), pair % len(self.keys)
        return np.bincount(d, self.weights[f] * (np.sqrt(times / count[d]) if self.share else 1.0), len(count))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def sample_rows(docs: DataFrame, graded: DataFrame, text: str, grade: str, sample: int) -> DataFrame:
    """(doc_id, text, grade) of the `sample` labelled rows with the smallest
    hash of doc_id. Labels with a null, and rows without a label, are left out;
    of several labels of a document the largest counts."""
    chosen = graded.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(grade).cast("int").alias("_grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows of two numbers
    return docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")


def collect_sample(rows: DataFrame, text: str, share: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sample's features as flat arrays: hashes, values, row starts, grades
    and ids. Rows come in order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                hashes, owner, count = features(part, text)
                hashes = hashes[np.argsort(owner, kind="stable")]
                order = np.append(0, np.cumsum(np.bincount(owner, minlength=len(count))))
                raw, vals = [], []
                for words, a, b in zip(count.tolist(), order[:-1].tolist(), order[1:].tolist(), strict=True):
                    w, n = np.unique(hashes[a:b], return_counts=True)
                    raw.append(w.tobytes())
                    vals.append((np.sqrt(n / words) if share else np.ones(len(n))).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("_grade").cast(pa.int32()), pa.array(raw, pa.binary()), pa.array(vals, pa.binary())], names=["doc_id", "grade", "keys", "vals"])

    got = rows.mapInArrow(run, "doc_id long, grade int, keys binary, vals binary").toArrow().sort_by([("doc_id", "ascending")])
    keys = [np.frombuffer(v.as_buffer(), np.uint64) for v in got.column("keys")]
    vals = [np.frombuffer(v.as_buffer(), "<f4") for v in got.column("vals")]
    at = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, "<f4"), *vals]).astype(float), at, np.asarray(got.column("grade")), np.asarray(got.column("doc_id"))


def fit(keys: np.ndarray, vals: np.ndarray, at: np.ndarray, grades: np.ndarray, grade_count: int, share: bool, ridge: float = 1e-3, min_docs: int = 8, z: float = 5.0, rounds: int = 15) -> Model:
    """The model of flat features. Without rows, or without a feature that
    matters, there are no weights."""
    n, cuts = len(grades), grade_count - 1
    if not n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.arange(cuts, dtype=float), share)
    base = np.array([np.clip((grades >= k).mean(), 1e-4, 1 - 1e-4) for k in range(1, grade_count)])
    theta = np.log((1 - base) / base) + 1e-3 * np.arange(cuts)
    vocabulary, col, met = np.unique(keys, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), np.diff(at))
    slope, _ = _derivatives(theta, np.zeros(n), grades)
    mean = np.bincount(col, vals, len(vocabulary)) / n
    spread = np.bincount(col, vals**2, len(vocabulary)) / n - mean**2
    centred = np.bincount(col, vals * slope[row], len(vocabulary)) - n * mean * slope.mean()
    test = np.abs(centred) / np.sqrt(np.maximum(n * spread * slope.var(), 1e-300))
    kept = np.flatnonzero((met >= min_docs) & (test > z))
    where = np.full(len(vocabulary), -1)
    where[kept] = np.arange(len(kept))
    use = where[col] >= 0
    order = np.argsort(where[col[use]], kind="stable")
    row, scale = row[use][order], 1 / np.sqrt(spread[kept])
    first = np.append(0, np.cumsum(np.bincount(where[col[use]], minlength=len(kept))))
    x = vals[use][order] * np.repeat(scale, np.diff(first))
    w, score = np.zeros(len(kept)), np.zeros(n)
    for _ in range(rounds):
        slope, bend = _derivatives(theta, score, grades)
        moved, old = np.zeros(n), w.copy()
        for _ in range(2):
            for j in range(len(kept)):
                r, v = row[first[j] : first[j + 1]], x[first[j] : first[j + 1]]
                up = v @ (slope[r] - bend[r] * moved[r]) - n * ridge * w[j]
                step = min(1.0, max(-1.0, up / (v @ (v * bend[r]) + n * ridge)))
                w[j] += step
                moved[r] += step * v
        before, share_of = _fitness(theta, score, grades) - ridge * (old @ old) / 2, 1.0
        while share_of > 1e-4:
            new = old + share_of * (w - old)
            if _fitness(theta, score + share_of * moved, grades) - ridge * (new @ new) / 2 >= before:
                break
            share_of /= 2
        else:
            break
        w, score = new, score + share_of * moved
        for _ in range(5):
            theta = _thresholds(theta, score, grades)
    return Model(vocabulary[kept], w * scale, theta, share)


def _derivatives(theta: np.ndarray, score: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's log-likelihood by its score: the first, and minus the second."""
    upper, lower = _sigmoid(np.append(theta, np.inf)[grades] - score), _sigmoid(np.append(-np.inf, theta)[grades] - score)
    return upper + lower - 1, np.maximum(upper * (1 - upper) + lower * (1 - lower), 1e-6)


def _thresholds(theta: np.ndarray, score: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """One scoring step for the thresholds, which stay in order."""
    upper, lower = _sigmoid(np.append(theta, np.inf)[grades] - score), _sigmoid(np.append(-np.inf, theta)[grades] - score)
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    step = np.zeros(len(theta))
    for k in range(len(theta)):
        by = np.where(grades == k, du, 0) - np.where(grades == k + 1, dl, 0)
        step[k] = np.clip(by.mean() / max((by**2).mean(), 1e-9), -1, 1)
    before = _fitness(theta, score, grades)
    for _ in range(12):
        out = np.maximum.accumulate(theta + step + 1e-6 * np.arange(len(theta)))
        if _fitness(out, score, grades) >= before:
            return out
        step /= 2
    return theta


def _fitness(theta: np.ndarray, score: np.ndarray, grades: np.ndarray) -> float:
    """Mean log-likelihood."""
    upper, lower = _sigmoid(np.append(theta, np.inf)[grades] - score), _sigmoid(np.append(-np.inf, theta)[grades] - score)
    return float(np.log(np.maximum(upper - lower, 1e-12)).mean())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, expected, tails) of every row: the expected grade and
    P(grade >= k) for k = 1, 2, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                tails = model.tails(model.scores(part, text))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(tails.sum(axis=1)), flat], names=["doc_id", "expected", "tails"])

    return docs.select(key, text).mapInArrow(run, "doc_id long, expected double, tails array<double>")


def strong_terms(keys: np.ndarray, at: np.ndarray, positive: np.ndarray, min_docs: int = 8, odds: float = 3.0) -> np.ndarray:
    """Features whose smoothed log-odds of occurring in positive rather than in
    other rows exceed `odds`."""
    n, p = len(positive), int(positive.sum())
    if not p or p == n:
        return np.zeros(0, np.uint64)
    vocabulary, inverse, met = np.unique(keys, return_inverse=True, return_counts=True)
    with_ = np.bincount(inverse, np.repeat(positive, np.diff(at)).astype(float), len(vocabulary))
    a, b = (with_ + 0.5) / (p + 1), (met - with_ + 0.5) / (n - p + 1)
    return vocabulary[(met >= min_docs) & (np.log(a / (1 - a)) - np.log(b / (1 - b)) > odds)]
