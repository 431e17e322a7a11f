"""Quality of documents by regularised quadratic discriminant analysis of their statistics.

Each class has the mean and the shrunken covariance of transformed statistics, widened for texts of
few words, whose statistics are left to chance. A document's score
is the logistic of the difference of the two Gaussian log-densities (and the log prior odds); the
Mahalanobis terms use Cholesky factors that are inverted once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_drift.llm.common import append_columns
from spark_drift.llm.labels import held_out, training_labels

#: Share of the covariance that gives way to its diagonal, the least variance kept, and the variance that
#: statistics of one word have by chance (a text of n words: one n-th of it).
SHRINKAGE, FLOOR, CHANCE = 0.05, 1e-3, 1.0
#: Texts are told apart by the power of two of their number of words, up to this.
LENGTHS = 16

FEATURES = ("log_words", "log_word_length", "word_length_spread", "symbols", "uppercase", "exclamations", "digits", "full_stops",
            "commas", "non_ascii", "log_line_words", "distinct_lines", "distinct_words", "ends_in_symbol", "shortest_words")

# classes of bytes: 0 other, 1 white space, 2 lower case, 3 upper case, 4 digit, 5 full stop, 6 comma, 7 exclamation mark, 8 symbol, 9 above ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 0
_CLASS[46], _CLASS[44], _CLASS[33] = 5, 6, 7
_CLASS[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 8
_CLASS[128:] = 9


def _odds(part: float, whole: float, prior: float = 1.0) -> float:
    """Log odds of a share, smoothed so that 0 of few is not far from a little of many."""
    return float(np.log((part + 0.5) / (max(0.0, whole - part) + prior + 0.5)))


def statistics_of(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text; a null counts as empty."""
    raw = (text or "").encode()
    if not raw.strip():
        raw = b""
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    count = np.bincount(kinds, minlength=10)
    words = raw.split()
    n, size = len(words), len(raw) - int(count[1])
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = count[2] + count[3]
    gap = np.flatnonzero(kinds == 1)
    ends = int((kinds[gap[gap > 0] - 1] == 8).sum()) + int(bool(raw) and kinds[-1] == 8)
    mean = lengths.mean() if n else 0.0
    return np.array([
        np.log1p(n),
        np.log1p(mean),
        lengths.std() / (1 + mean) if n else 0.0,
        _odds(count[8], size),
        _odds(count[3], letters),
        _odds(count[7], n),
        _odds(count[4], size),
        _odds(count[5], n),
        _odds(count[6], n),
        _odds(count[9], size),
        np.log1p(n / max(1, len(lines))),
        _odds(len(set(lines)), len(lines)),
        np.log((len(set(words)) + 1) / (n + 1)) / np.log(n + 2),
        _odds(ends, n),
        _odds(int((lengths <= 3).sum()), n),
    ])


@dataclass
class QualityModel:
    """Means of the classes 0 and 1, for each power of two of the number of words the inverted Cholesky
    factors and log determinants of both classes, and the log prior odds. Without two rows of both
    classes the model is ``constant``."""

    mean: np.ndarray
    factor: np.ndarray  # (length, class, d, d)
    log_det: np.ndarray  # (length, class)
    log_odds: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics, the first of which is log(1 + words)."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        length = np.clip(np.log2(np.maximum(np.expm1(x[:, 0]), 1)).astype(int), 0, LENGTHS - 1)
        odds = np.zeros(len(x))
        for n in np.unique(length):
            own = length == n
            density = []
            for c in (0, 1):
                z = (x[own] - self.mean[c]) @ self.factor[n, c].T
                density.append(-0.5 * ((z * z).sum(1) + self.log_det[n, c]))
            odds[own] = density[1] - density[0] + self.log_odds
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def model_of(n: Sequence[float], total: Sequence[np.ndarray], square: Sequence[np.ndarray], shrinkage: float = SHRINKAGE) -> QualityModel:
    """The model from each class's number of rows, sum of x and sum of x xᵀ."""
    if min(n) < 2:
        share = n[1] / (n[0] + n[1]) if sum(n) else 0.0
        return QualityModel(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, float(share))
    d = len(total[0])
    mean, factor, log_det = np.zeros((2, d)), np.zeros((LENGTHS, 2, d, d)), np.zeros((LENGTHS, 2))
    for c in (0, 1):
        mean[c] = total[c] / n[c]
        cov = square[c] / n[c] - np.outer(mean[c], mean[c])
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.maximum(np.diag(cov), 0))
        for length in range(LENGTHS):
            low = np.linalg.cholesky(cov + (FLOOR + CHANCE / 2**length) * np.eye(d))
            factor[length, c] = np.linalg.inv(low)
            log_det[length, c] = 2 * np.log(np.diag(low)).sum()
    return QualityModel(mean, factor, log_det, float(np.log(n[1] / n[0])))


def features(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` and x, the statistics of each whole text."""
    return append_columns(docs, text, keep, [T.StructField("x", T.ArrayType(T.DoubleType()))], lambda: lambda texts: [[statistics_of(t) for t in texts]])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", shrinkage: float = SHRINKAGE) -> QualityModel:
    """Model from all labelled rows that are not held out. Texts are not shuffled, only their
    statistics; the driver gets one row of sums per label and task. A document that comes several
    times counts as often."""
    rows = features(docs, [key], text).join(training_labels(labels, label, key), key).select("y", "x")
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            y = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                n[c], total[c], square[c] = n[c] + len(own), total[c] + own.sum(0), square[c] + own.T @ own
        for c in (0, 1):
            if n[c]:
                i = np.arange(1 + d + d * d)
                v = np.concatenate([[n[c]], total[c], square[c].reshape(-1)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), c), pa.int32()), pa.array(i, pa.int32()), pa.array(v)], ["y", "i", "v"])

    got = rows.mapInArrow(sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for r in got:
        flat[r.y, r.i] = r.v
    return model_of(flat[:, 0], flat[:, 1:1 + d], flat[:, 1 + d:].reshape(2, d, d), shrinkage)


def score(docs: DataFrame, model: QualityModel, keep: Sequence[str], text: str = "text", threshold: float = 0.3,
          key: str = "doc_id", out: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """``keep``, held_out, score in [0, 1] and predicted (1 from ``threshold`` on) of each whole text.

    A null text scores as an empty one. Rows are independent: equal rows give equal rows, an empty
    table an empty one; kept columns named like a result (``out``) give way to it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: [m.score(np.array([statistics_of(t) for t in texts]).reshape(-1, len(FEATURES)))]

    kept = [c for c in keep if c not in out]
    rows = append_columns(docs, text, list(dict.fromkeys([*kept, key])), [T.StructField(out[1], T.DoubleType())], make)
    return rows.select(*kept, held_out(key).alias(out[0]), out[1], (F.col(out[1]) >= threshold).cast("int").alias(out[2]))
