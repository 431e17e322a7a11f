"""Token counts under a unigram model, without making the tokens.

A best path through the pieces is found by dynamic programming over the places where an automaton
finds a piece; only the best score and the number of its pieces are carried. Ties go as in the
sentencepiece library: of paths with equal scores to a place, the one whose last piece starts first.
Sums are exact here. The library rounds them in single precision: with scores off a coarse grid
(see ``unigram_model``) paths of nearly equal scores in texts of millions of symbols can differ."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spark_drift.llm.common import WordCache, append_columns

#: Scores of ``unigram_model`` are multiples of this, so that ties are common and the tie rule counts.
GRID = 1 / 16
#: The library scores a symbol that is no piece this much under its worst piece.
UNKNOWN = 10.0
WORDS = re.compile(" +[^ ]*|[^ ]+")


def unigram_model(model: bytes, grid: float = GRID) -> bytes:
    """The vocabulary of a merge-type model file as a unigram model: a piece of rank r among the
    ordinary pieces scores −ln(r + 2), rounded to ``grid``. Nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(model)
    proto.trainer_spec.model_type = 1
    rank = 0
    for p in proto.pieces:
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = -round(math.log(rank + 2) / grid) * grid
            rank += 1
    return proto.SerializeToString()


class UnigramCounter:
    """Counts the pieces of a text's best path, for a unigram model with identity normalisation."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        kind, norm = pb.ModelProto.SentencePiece, proto.normalizer_spec
        if proto.trainer_spec.model_type != 1 or norm.name != "identity" or not norm.escape_whitespaces or norm.remove_extra_whitespaces:
            raise ValueError("a unigram model with identity normalisation is needed")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.scores = {p.piece.replace("▁", " "): p.score for p in proto.pieces if p.type == kind.NORMAL}
        self.loose = min(self.scores.values()) - UNKNOWN
        self.by_bytes = proto.trainer_spec.byte_fallback
        self.single = {t for t in self.scores if len(t) == 1}
        # without byte pieces a run of unknown symbols is one piece, which may go on after a space
        by_word = not any(" " in t.lstrip(" ") for t in self.scores) and self.by_bytes
        # Single-precision scores add up in double precision without rounding while the sum is under 2**53
        # times the finest step of a score; so long, a text's best path is that of its words put together.
        finest = min(math.ulp(abs(s)) * 2.0**29 for s in self.scores.values() if s)
        self.exact_length = 2.0**53 * finest / max(map(abs, [self.loose, *self.scores.values()])) if by_word else 0
        self.automaton = ahocorasick.Automaton()
        for t, s in self.scores.items():
            self.automaton.add_word(t, (s, len(t)))
        self.automaton.make_automaton()
        self.words = WordCache(self._path)

    def _matches(self, text: str):
        """(end, (score, length)) by end and then from the longest; loose symbols have length 0."""
        if self.single.issuperset(text):
            return self.automaton.iter(text)
        found = list(self.automaton.iter(text))
        found += [(i, (self.loose, 0)) for i, c in enumerate(text) if c not in self.single]
        return sorted(found, key=lambda m: (m[0], -m[1][1]))

    def _path(self, text: str) -> tuple[int, float]:
        """Number of pieces and score of the best path of a text without its leading space."""
        best, count, loose = [None] * len(text), [0] * len(text), [0] * len(text)
        for end, (score, length) in self._matches(text):
            before = end - (length or 1)
            if before >= 0:
                if best[before] is None:
                    continue
                total = best[before] + score
            else:
                total = score
            if best[end] is None or total > best[end]:
                best[end], n = total, count[before] if before >= 0 else 0
                if length:
                    count[end], loose[end] = n + 1, 0
                else:  # loose symbols become bytes, or a run of them one unknown piece
                    run = before >= 0 and loose[before]
                    count[end], loose[end] = n + (len(text[end].encode()) if self.by_bytes else 0 if run else 1), 1
        return count[-1], best[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        """Number of tokens and score of the best path; (0, 0.0) for a null or empty text."""
        if not text:
            return 0, 0.0
        text = self.prefix + text.replace("▁", " ")
        if len(text) >= self.exact_length:
            return self._path(text)
        counts, scores = zip(*map(self.words.__getitem__, WORDS.findall(text)))
        return sum(counts), math.fsum(scores)


_LOADED: dict[bytes, UnigramCounter] = {}


def counter(model: bytes) -> UnigramCounter:
    """The counter of a model, made once per Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = UnigramCounter(model)
    return _LOADED[key]


def token_counts(docs: DataFrame, model: bytes, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep``, n_tokens and path_score of each whole text.

    A null or empty text has no tokens and score 0. Rows are independent: equal rows give equal
    rows, an empty table an empty one; kept columns named like a result give way to it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        c = counter(shared.value)
        return lambda texts: zip(*[c.count(t) for t in texts]) if texts else ([], [])

    return append_columns(docs, text, keep, [T.StructField("n_tokens", T.LongType()), T.StructField("path_score", T.DoubleType())], make)
