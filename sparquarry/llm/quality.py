"""Quality by Bradley-Terry ranking of preference pairs.

A document's strength is a linear function of features of its whole text.  For
pairs of a preferred (label 1) and another (label 0) labelled document the
logistic loss of the difference of strengths is least at the fitted weights, as
in the Bradley-Terry model; only differences of features enter, so there is no
intercept.  Features are what the text says (its words, each for itself, and its
runs of three bytes, hashed into WORD_CELLS and GRAM_CELLS signed cells, damped and
brought to unit length) and how it is written (shares of kinds of characters and of
words).  The cut is the quantile of the training rows' strengths at the share of
them that is labelled 0, halfway to the next strength; strengths are then mapped to
0..1 so that the cut comes to lie at THRESHOLD.

The model is fitted on the driver on SAMPLE labelled rows at most (a documented
bound) and PAIRS pairs; only their features are computed for it.  Every document is
scored where it is read, without a shuffle of texts.

Defined results: a null text counts as empty; empty texts get a score like any
other text; without rows of both labels nothing can be learnt and every score is
1.0; rows that repeat are scored alike; labels that repeat count each time; null
labels count for nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, utf8_column
from .words import LOWER, chunks, prefix_hash, slice_hash, words

SAMPLE, PAIRS, THRESHOLD = 20_000, 50_000, 0.7
#: Weights of squared weights in the loss, of rates and of cells.
RIDGE, CELL_RIDGE = 1e-3, 1e-3
WORD_CELLS, GRAM_CELLS = 128, 128
#: Pairs whose differences are held at once.
TOGETHER = 4096

#: Classes of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 stop, 7 mark, 8 bar, 9 exclamation, 10 symbol, 11 start of a wider character.
CLASS = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((b"", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b",;:?'\"-()", b"|", b"!", b"$%&*#@<>{}[]\\/^~_+=`", bytes(range(0xC2, 0xF5)))):
    CLASS[list(_bytes)] = _kind
N_CLASS = 12
RATES = 18
N_RATES = 2 * RATES + 1
N_FEATURES = N_RATES + WORD_CELLS + GRAM_CELLS


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES per text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(text * N_CLASS + CLASS[data], minlength=n * N_CLASS).reshape(n, N_CLASS).astype(float)
    starts, ends, of = words(data, offsets)
    per = np.bincount(of, minlength=n).astype(float)
    some, many = np.maximum(per, 1), np.maximum(sizes, 1)
    length = ends - starts
    h = slice_hash(prefix_hash(LOWER[data]), starts, ends) if len(data) else np.zeros(0, np.uint64)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    keyed = np.sort((of.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.r_[True, keyed[1:] != keyed[:-1]] if len(keyed) else np.zeros(0, bool)
    unique = np.bincount((keyed[new] >> np.uint64(44)).astype(np.int64), minlength=n)
    last, first = CLASS[data[ends - 1]] if len(ends) else length, CLASS[data[starts]] if len(ends) else length

    def share(which: np.ndarray) -> np.ndarray:
        return np.bincount(of[which], minlength=n) / some

    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 11], 1)
    rates = np.column_stack([
        kinds[:, 2] / letters, kinds[:, 3] / many, kinds[:, 10] / many, kinds[:, 8] / many, kinds[:, 9] / many, kinds[:, 7] / many,
        kinds[:, 6] / many, kinds[:, 4] / many, kinds[:, 5] / many, kinds[:, 11] / many, kinds[:, 0] / many,
        share(same), 1 - unique / some, share(length <= 2), share(length >= 16), share(last == 6),
        share((last >= 8) & (last <= 10)), share(first == 2),
    ])
    lower = LOWER[data].astype(np.uint64)
    grams = np.zeros(0, np.uint64)
    if len(lower) > 2:
        grams = mix64(lower[:-2] | lower[1:-1] << np.uint64(8) | lower[2:] << np.uint64(16))
    inside = np.flatnonzero(text[2:] == text[:-2]) if len(grams) else np.zeros(0, np.int64)
    return np.column_stack([rates, np.log1p(100 * rates), np.log1p(per), _cells(of, h, n, WORD_CELLS), _cells(text[inside], grams[inside], n, GRAM_CELLS)])


def _cells(of: np.ndarray, h: np.ndarray, n: int, cells: int) -> np.ndarray:
    """Signed counts of hashes by text, damped, as unit vectors."""
    at = of * cells + ((h >> np.uint64(8)) % np.uint64(cells)).astype(np.int64)
    odd = (h & np.uint64(1)).astype(bool)
    size = n * cells
    x = (np.bincount(at[odd], minlength=size) - np.bincount(at[~odd], minlength=size)).reshape(n, cells).astype(float)
    x = np.sign(x) * np.log1p(np.abs(x))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def of_column(column: pa.Array) -> np.ndarray:
    data, offsets = utf8_column(column)
    parts = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    return np.vstack(parts).astype(np.float32) if parts else np.zeros((0, N_FEATURES), np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [row.tobytes() for row in of_column(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class BradleyTerry:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, known: bool = True):
        self.mean, self.scale, self.weights, self.cut, self.known = mean, scale, weights, cut, known

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.ones(len(x))
        return sigmoid(self.strength(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 0) -> BradleyTerry:
        """x: features; y: 1 for preferred rows, 0 for the others."""
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return cls(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, False)
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        scale[N_RATES:] = 0.1  # cells are on one scale already
        ridge = np.where(np.arange(x.shape[1]) < N_RATES, RIDGE, CELL_RIDGE)
        z = (x - mean) / scale
        rng = np.random.default_rng(seed)
        left, right = rng.choice(good, pairs), rng.choice(bad, pairs)
        w = np.zeros(z.shape[1])
        for _ in range(30):  # Newton steps on the convex loss
            gradient, hessian = ridge * w, np.diag(ridge)
            for at in range(0, pairs, TOGETHER):
                d = z[left[at : at + TOGETHER]] - z[right[at : at + TOGETHER]]
                p = sigmoid(-(d @ w))
                gradient = gradient - d.T @ p / pairs
                hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d / pairs
            step = np.linalg.solve(hessian, gradient)
            step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        ranked = np.sort(z @ w)
        i = len(bad)  # the quantile: as many lie below as are labelled 0
        return cls(mean, scale, w, float((ranked[i - 1] + ranked[i]) / 2))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BradleyTerry:
    """labels: doc_id and quality.  Rows with held_out() are never seen."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    # at most sample labels, the first in the order of a hash; that many rows are few enough to send to every task
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_features, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, x binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample).collect()
    y = np.array([r.y for r in rows], np.int64)
    x = np.frombuffer(b"".join([bytes(r.x) for r in rows]), np.float32).reshape(-1, N_FEATURES)
    del rows
    return BradleyTerry.fit(x.astype(np.float64), y)


def score_table(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, score for every row."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(of_column(batch.column("text"))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scores, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = score_table(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """The rows of documents that the model doesn't reject, their columns as they are."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(of_column(batch.column("text"))) >= THRESHOLD))

    columns = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return columns.mapInArrow(keep, columns.schema)
