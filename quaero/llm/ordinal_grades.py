"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is 0 (poor), 1 (good, but toxic) or 2 (good). One score, a sum of shared weights over hashed text features, stands against ordered thresholds:
P(grade <= k) = logistic(threshold_k - score). That gives every document an expected grade and the probability of a grade or better, by which documents are
selected.

Features are the distinct words of the whole text (runs of letters, digits and non-ASCII characters, A-Z lower-cased), their first bytes, and the bins of four shares of it, hashed into a table of
fixed size. The model is fitted on the driver on a bounded sample of labelled rows, by full-batch gradient steps from zero, so refitting gives the same model; features of few
sampled documents, or whose grades do not differ from the sample's, keep weight 0. Scoring is a pass over Arrow batches with the weights (1 MB) beside the function, and nothing is shuffled.

Defined results: null text counts as empty and has the bins of an empty text; labels with a null id or grade are left out, and of several the lowest grade holds; without two different grades
in the sample the score is 0 and the probabilities are the sample's shares; rows that share an id are scored each on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Bound of the labelled sample.
MOST_ROWS = 6000
#: Bytes of a word's beginnings that are features beside the word.
PREFIXES = (4, 6, 8)
_P = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>!")] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of lower-cased bytes and of their beginnings: each byte is mixed with its place in its word, and a word is the sum of its bytes."""
    inside = _WORD[data]
    turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = turns[::2], turns[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(data)]])))
    mixed = _mix((data.astype(np.uint64) + np.uint64(1)) * _P + place.astype(np.uint64))
    mixed[~inside] = 0
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    found = [_mix(sums[end] - sums[start])]
    for k in PREFIXES:
        long = end - start > k
        found.append(_mix((sums[start[long] + k] - sums[start[long]]) ^ np.uint64(k)))
    return np.concatenate(found)


def features(text: bytes) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text, a piece at a time."""
    ids, n_words, n_symbols, n_upper, at = [], 0, 0, 0, 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        if end < len(text):  # a piece ends at white space: its last, or if it has none, the next one
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            later = [x for x in (text.find(b" ", end), text.find(b"\n", end)) if x >= 0] if cut < at else [cut]
            end = min(later, default=len(text) - 1) + 1
        raw = np.frombuffer(text, np.uint8, end - at, at)
        hashes = _words(_LOWER[raw])
        n_words += len(hashes)
        n_symbols += int(_SYMBOL[raw].sum())
        n_upper += int(((raw >= 65) & (raw < 91)).sum())
        ids.append(np.unique((hashes >> np.uint64(64 - BITS)).astype(np.int64)))
        at = end
    found = np.unique(np.concatenate(ids)) if ids else np.zeros(0, np.int64)
    shares = (n_symbols / max(1, n_words), n_upper / max(1, len(text)), len(found) / max(1, n_words), n_words / 50)
    edges = ((0.02, 0.05, 0.1, 0.2, 0.4, 0.8), (0.01, 0.03, 0.06, 0.12, 0.25, 0.5), (0.05, 0.1, 0.2, 0.35, 0.5), (0.2, 0.5, 1, 2, 8, 32))
    bins = [k * 16 + int(np.digitize(s, e)) for k, (s, e) in enumerate(zip(shares, edges, strict=True))]
    extra = (_mix(np.array(bins, np.uint64) + _P) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.unique(np.concatenate([found, extra]))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score."""
        below = _logistic(self.thresholds[None, :] - scores[:, None])
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], 1), axis=1)


def _telling(flat: np.ndarray, grade: np.ndarray, totals: np.ndarray, least: int, evidence: float) -> np.ndarray:
    """Features of ``least`` documents or more whose grades differ from the sample's with a likelihood ratio of ``evidence`` or more."""
    found = np.stack([np.bincount(flat[grade == k], minlength=1 << BITS) for k in range(len(totals))], 1).astype(float)
    n, share = found.sum(1, keepdims=True), totals / totals.sum()
    with_ = found * np.log(np.maximum(found, 1e-9) / np.maximum(n * share, 1e-9))
    rest = totals - found
    without = rest * np.log(np.maximum(rest, 1e-9) / np.maximum((totals.sum() - n) * share, 1e-9))
    return (n[:, 0] >= least) & (2 * (with_ + without).sum(1) >= evidence)


def train(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, least: int = 6, evidence: float = 40.0, steps: int = 300, rate: float = 0.08, penalty: float = 1e-4) -> Model:
    """Maximum penalised likelihood by Adam steps on all rows at once; thresholds stay ordered by stepping on the logarithms of their gaps."""
    shares = (np.bincount(grades, minlength=n_grades) + 0.5) / (len(grades) + 0.5 * n_grades)
    cuts = np.cumsum(shares)[:-1]
    thresholds = np.log(cuts / (1 - cuts))
    weights = np.zeros(1 << BITS)
    if len(set(grades.tolist())) < 2:
        return Model(weights.astype(np.float32), thresholds)
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    keep = _telling(flat, grades[row], np.bincount(grades, minlength=n_grades), least, evidence)[flat]
    columns, dense = np.unique(flat[keep], return_inverse=True)
    row = row[keep]
    p = np.concatenate([np.zeros(len(columns)), [thresholds[0]], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    m, v, n = np.zeros_like(p), np.zeros_like(p), len(columns)
    at = np.arange(len(rows))
    for t in range(1, steps + 1):
        theta = p[n] + np.concatenate([[0], np.cumsum(np.exp(p[n + 1 :]))])
        score = np.bincount(row, p[:n][dense], len(rows))
        below = np.concatenate([np.zeros((len(rows), 1)), _logistic(theta[None, :] - score[:, None]), np.ones((len(rows), 1))], 1)
        slope = below * (1 - below)
        chance = np.maximum(below[at, grades + 1] - below[at, grades], 1e-9)
        to_score = (slope[at, grades + 1] - slope[at, grades]) / chance
        grad = np.zeros_like(p)
        grad[:n] = np.bincount(dense, to_score[row], n) / len(rows) + penalty * p[:n]
        to_theta = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            to_theta[k] = (np.where(grades == k + 1, slope[:, k + 1], 0) - np.where(grades == k, slope[:, k + 1], 0)).dot(1 / chance) / len(rows)
        grad[n] = to_theta.sum()
        for k in range(1, n_grades - 1):
            grad[n + k] = to_theta[k:].sum() * np.exp(p[n + k])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[columns] = p[:n]
    return Model(weights.astype(np.float32), p[n] + np.concatenate([[0], np.cumsum(np.exp(p[n + 1 :]))]))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fits on the labelled documents with the least hashes of their id, ``most_rows`` of them at most."""
    graded = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)).alias("grade"))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features((t or "").encode()).astype(np.int32).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["doc_id", "grade", "features"])

    rows = chosen.mapInArrow(run, "doc_id long, grade int, features binary").groupBy("doc_id", "grade").agg(F.min("features").alias("features")).collect()
    rows.sort(key=lambda r: r.doc_id)
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), np.log(np.array([0.5, 2.0])))
    return train([np.frombuffer(r.features, np.int32) for r in rows], np.array([r.grade for r in rows]))


def grade(docs: DataFrame, model: Model, tail: int = 2, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected): selected are documents whose chance of grade ``tail`` or better is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.array([float(model.weights[features((t or "").encode())].sum(dtype=np.float64)) for t in b.column(1).to_pylist()])
            p = model.probabilities(scores)
            above = p[:, tail:].sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(above), pa.array(above >= least)], ["doc_id", "expected_grade", "tail_probability", "selected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, selected boolean")
