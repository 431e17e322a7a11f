"""Toxicity of documents from character n-grams.

A word's vector is the mean of the vectors of its character n-grams (hashed), a window of words has
the mean of its words' vectors, and a linear softmax over it gives the window's probability. A
document scores as its most toxic window. Vectors and softmax are trained together; a misspelling
never seen shares n-grams with words that were."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_drift.llm.common import WordCache, append_columns
from spark_drift.llm.labels import held_out, training_labels

WORD = re.compile(r"[^\W_]+")
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSION = 8
#: Words of a window.
WINDOW = 4
#: Training documents of each label: a bounded sample, the ids of least hash.
SAMPLE = 1000
EPOCHS, BATCH, RATE, SEED = 12, 50, 1.5, 17


def grams_of(word: str) -> list[int]:
    """Buckets of the n-grams of a word between its marks of begin and end."""
    marked = f"<{word}>"
    return [zlib.crc32(marked[i:i + n].encode()) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)] or [zlib.crc32(marked.encode()) % BUCKETS]


@dataclass
class ToxicModel:
    """``weight`` of a bucket: its vector times the softmax's difference of classes; ``bias`` likewise.
    Without both labels among the training rows the model is ``constant``."""

    weight: np.ndarray
    bias: float
    constant: float | None = None

    def word(self, word: str) -> float:
        return float(self.weight[grams_of(word)].mean())

    def scorer(self):
        """Function from a text to its probability of being toxic."""
        if self.constant is not None:
            return lambda text: self.constant
        words = WordCache(self.word).__getitem__

        def score(text: str | None) -> float:
            found = WORD.findall((text or "").lower())
            n = len(found)
            if not n:
                top = 0.0
            elif n <= WINDOW:
                top = sum(map(words, found)) / n
            else:
                values = np.fromiter(map(words, found), np.float64, n)
                starts = np.arange(0, n - WINDOW // 2, WINDOW)  # a last piece under half a window joins the one before
                top = float((np.add.reduceat(values, starts) / np.diff(np.append(starts, n))).max())
            return float(1 / (1 + np.exp(-np.clip(top + self.bias, -30, 30))))

        return score


def train(texts: Sequence[str | None], y: Sequence[int], share: float) -> ToxicModel:
    """Fit on whole texts with labels 0 and 1; ``share``: of label 1 among all labelled rows.

    In the first two rounds every window has its document's label, later only a document's most
    toxic window takes part. Adagrad on the touched vectors, in an order drawn from SEED."""
    # texts as numbers of distinct words, and the buckets of all words one after another: the lists are not kept
    number: dict[str, int] = {}
    rows, label = [], []
    for t, one in zip(texts, y):
        found = WORD.findall((t or "").lower())
        if found:
            rows.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
            label.append(int(one))
    if len(set(label)) < 2:
        return ToxicModel(np.zeros(0), 0.0, float(share))
    label = np.array(label)
    flat, size = array("i"), np.zeros(len(number), np.int64)
    for i, w in enumerate(number):
        grams = grams_of(w)
        flat.extend(grams)
        size[i] = len(grams)
    flat = np.frombuffer(flat, np.int32)
    begin = np.cumsum(size) - size
    del number
    rnd = np.random.default_rng(SEED)
    vectors = (rnd.uniform(-1, 1, (BUCKETS, DIMENSION)) / DIMENSION).astype(np.float32)
    soft, bias = rnd.normal(0, 0.5, (DIMENSION, 2)), np.zeros(2)
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-8), np.full((DIMENSION, 2), 1e-8), np.full(2, 1e-8)
    for epoch in range(EPOCHS):
        order = rnd.permutation(len(rows))
        for low in range(0, len(order), BATCH):
            batch = order[low:low + BATCH]
            used, place = np.unique(np.concatenate([rows[i] for i in batch]), return_inverse=True)
            n_words = np.array([len(rows[i]) for i in batch])
            n_windows = np.maximum(1, (n_words + WINDOW // 2 - 1) // WINDOW)
            ends = np.cumsum(n_words)
            starts = np.concatenate([e - n + WINDOW * np.arange(k) for e, n, k in zip(ends, n_words, n_windows)])
            of = np.repeat(np.arange(len(batch)), n_windows)
            length = np.diff(np.append(starts, ends[-1]))
            # forward: buckets → words → windows → softmax
            own = size[used]
            cut = np.cumsum(own) - own
            at = flat[np.repeat(begin[used] - cut, own) + np.arange(int(own.sum()))]
            word_vectors = np.add.reduceat(vectors[at], cut) / own[:, None]
            window_vectors = np.add.reduceat(word_vectors[place], starts) / length[:, None]
            logits = window_vectors @ soft + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            target = label[batch][of]
            weight = np.ones(len(of)) / n_windows[of]
            if epoch >= 2:
                by = np.lexsort((p[:, 1], of))
                top = by[np.append(np.flatnonzero(np.diff(of[by])), len(by) - 1)]
                weight = np.zeros(len(of))
                weight[top] = 1
            slope = (p - np.eye(2)[target]) * weight[:, None] / len(batch)
            # backward
            grad_s, grad_b = window_vectors.T @ slope, slope.sum(0)
            per_window = slope @ soft.T / length[:, None]
            live = weight > 0
            spread = np.repeat(np.where(live[:, None], per_window, 0), length, axis=0)
            word_grad = np.stack([np.bincount(place, spread[:, d], len(used)) for d in range(DIMENSION)], 1) / own[:, None]
            word_of = np.repeat(np.arange(len(used)), own)
            touched, back = np.unique(at, return_inverse=True)
            grad_v = np.stack([np.bincount(back, word_grad[word_of, d], len(touched)) for d in range(DIMENSION)], 1)
            seen_v[touched] += (grad_v**2).mean(1)
            seen_s += grad_s**2
            seen_b += grad_b**2
            vectors[touched] -= (RATE * grad_v / np.sqrt(seen_v[touched])[:, None]).astype(np.float32)
            soft -= RATE / 3 * grad_s / np.sqrt(seen_s)
            bias -= RATE / 3 * grad_b / np.sqrt(seen_b)
    # the sample holds both labels alike: back to their share among all rows
    shift = np.log(share / (1 - share)) - np.log(label.mean() / (1 - label.mean())) if 0 < share < 1 else 0.0
    return ToxicModel(vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0] + shift))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicModel:
    """Model from the labelled rows of ``docs`` that are not held out.

    At most ``sample`` documents of each label reach the driver, those whose ids hash least: the
    same rows on any cluster. Only ids and labels are shuffled; the chosen ids, a bounded table, go
    to the documents. Labels of documents that are not there play no part."""
    known = training_labels(labels, label, key).join(docs.select(key).distinct(), key, "left_semi")
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    at = F.xxhash64(F.col(key))
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(at, key).limit(sample).collect()]
    if not chosen:
        return ToxicModel(np.zeros(0), 0.0, float(share))
    y = {r[key]: r.y for r in chosen}
    wanted = docs.sparkSession.createDataFrame([(k,) for k in y], f"{key} {docs.schema[key].dataType.simpleString()}")
    rows = docs.select(key, text).join(F.broadcast(wanted), key).dropDuplicates([key, text]).collect()
    rows = sorted({r[key]: r[text] for r in sorted(rows, key=lambda r: (r[key], r[text] or ""))}.items())
    return train([t for _, t in rows], [y[k] for k, _ in rows], share)


def score(docs: DataFrame, model: ToxicModel, keep: Sequence[str], text: str = "text", threshold: float = 0.5,
          key: str = "doc_id", out: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """``keep``, held_out, score in [0, 1] and predicted (1 from ``threshold`` on) of each whole text.

    A null or empty text scores as one without words. Rows are independent: equal rows give equal
    rows, an empty table an empty one; kept columns named like a result (``out``) give way to it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of = shared.value.scorer()
        return lambda texts: [[of(t) for t in texts]]

    kept = [c for c in keep if c not in out]
    rows = append_columns(docs, text, list(dict.fromkeys([*kept, key])), [T.StructField(out[1], T.DoubleType())], make)
    return rows.select(*kept, held_out(key).alias(out[0]), out[1], (F.col(out[1]) >= threshold).cast("int").alias(out[2]))
