"""Encoding and decoding with a merge-type SentencePiece model, by a table of last tokens.

The merges of a text's prefix never depend on what follows its last token, so every prefix has one
encoding and that encoding one last token. A token t ends the prefix p exactly when the last token
of p without t, followed by t, is what merging their joined characters gives. The table holds for
each prefix its last token: an automaton lists the pieces that end at a place, the pair test picks
the one that fits, and the ids are read from the table backwards. No heap of merges is kept."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spark_drift.llm.common import WordCache, append_columns

#: Symbols that are no piece are numbered from here by their code point.
LOOSE = 1 << 20
#: Bits of the largest token: a loose symbol of the last plane.
PAIR_BITS = (LOOSE + 0x10FFFF).bit_length()
#: Tested pairs that a Python worker keeps.
KEPT_PAIRS = 300_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A text cut before spaces, and cut after letters too where no letter or digit follows.
WORDS = re.compile(" +[^ ]*|[^ ]+")
LETTER_RUNS = re.compile(f" *[{LETTERS}]+(?![^\\W_])| *[^ ]+| +")


class PieceCodec:
    """Ids of whole texts for a merge-type model with byte pieces and identity normalisation."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kind, norm = sentencepiece_model_pb2.ModelProto.SentencePiece, proto.normalizer_spec
        plain = norm.name == "identity" and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if proto.trainer_spec.model_type != 2 or not plain or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with identity normalisation and byte pieces is needed")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.library = SentencePieceProcessor(model_proto=model)
        # a space stands for the visible space of the pieces
        self.texts = [p.piece.replace("▁", " ") for p in proto.pieces]
        self.scores = {self.texts[i]: p.score for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.ids = {self.texts[i]: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.single = {t for t in self.ids if len(t) == 1}
        # no merge can cross a cut between two symbols that stand side by side in no piece
        beside = {(a, b) for t in self.ids for a, b in zip(t, t[1:])}
        letter = re.compile(f"[{LETTERS}]").match
        by_word = not any(b == " " != a for a, b in beside)
        by_run = by_word and not any(letter(a) and not b.isalnum() for a, b in beside)
        self.cut = LETTER_RUNS.findall if by_run else WORDS.findall if by_word else lambda whole: [whole]
        self.code = "H" if len(self.texts) <= 1 << 16 else "I"
        self.width = np.dtype(self.code)
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) == 1 or self._merged(t) == [t]:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.words = WordCache(self._packed)

    def _merged(self, text: str) -> list[str]:
        """Merging by its definition: the best-scored pair first, the leftmost of equals. For short texts."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        return chr(token - LOOSE) if token >= LOOSE else self.texts[token]

    def _pair_fits(self, left: int, right: int) -> bool:
        a, b = self._text(left), self._text(right)
        return self._merged(a + b) == [a, b]

    def _matches(self, text: str):
        """(end, (token, length)) by end; symbols that are no piece come as tokens of their own."""
        if self.single.issuperset(text):
            return self.automaton.iter(text)
        found = list(self.automaton.iter(text))
        found += [(i, (LOOSE + ord(c), 1)) for i, c in enumerate(text) if c not in self.single]
        return sorted(found, key=lambda m: m[0])

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a text in which spaces stand as they are, without the leading space of whole texts."""
        n = len(text)
        # by the place of a prefix's last symbol; places of symbols that have no token yet hold -1
        last, begin, fits = [-1] * n, [0] * n, self.fits
        done = -1
        for end, (token, length) in self._matches(text):
            if end == done:
                continue
            before = end - length
            if before >= 0:
                pair = last[before] << PAIR_BITS | token
                if pair not in fits:
                    if len(fits) >= KEPT_PAIRS:
                        fits.clear()
                    fits[pair] = self._pair_fits(last[before], token)
                if not fits[pair]:
                    continue
            last[end], begin[end] = token, before
            done = end
        out, at, loose = [], n - 1, False
        while at >= 0:
            token = last[at]
            out.append(token)
            loose = loose or token >= LOOSE
            at = begin[at]
        out.reverse()
        if loose:
            out = [i for t in out for i in ([t] if t < LOOSE else [self.bytes[b] for b in chr(t - LOOSE).encode()])]
        return out

    def _packed(self, segment: str) -> bytes:
        return array(self.code, self.encode_segment(segment)).tobytes()

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a whole text as unsigned integers of ``width``; a null counts as empty."""
        if not text:
            return b""
        return b"".join(map(self.words.__getitem__, self.cut(self.prefix + text.replace("▁", " "))))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), self.width).tolist()

    def decode(self, ids: Sequence[int]) -> str:
        return self.library.decode(list(ids))


_LOADED: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The codec of a model, made once per Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = PieceCodec(model)
    return _LOADED[key]


def encode_texts(docs: DataFrame, model: bytes, keep: Sequence[str], text: str = "text", ids: str = "ids") -> DataFrame:
    """``keep`` and the ids (array of int) of each whole text. A null text counts as empty: no ids.

    Rows are independent: equal rows give equal rows, an empty table an empty one. A kept column
    called ``ids`` gives way to the result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        c = codec(shared.value)
        return lambda texts: [[c.encode(t) for t in texts]]

    return append_columns(docs, text, keep, [T.StructField(ids, T.ArrayType(T.IntegerType(), False))], make)


def decode_ids(rows: DataFrame, model: bytes, keep: Sequence[str], ids: str = "ids", text: str = "text") -> DataFrame:
    """``keep`` and the text of each row's ids; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        c = codec(shared.value)
        return lambda lists: [[c.decode(x or []) for x in lists]]

    return append_columns(rows, ids, keep, [T.StructField(text, T.StringType())], make)


def piece_digests(docs: DataFrame, model: bytes, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of each whole text, ids and text being made and
    digested in one pass. Cases as in ``encode_texts``; kept columns with those names give way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        c = codec(shared.value)
        names = [str(i) for i in range(len(c.texts))].__getitem__

        def work(texts):
            counts, digests, decoded = [], [], []
            for t in texts:
                ids = c.encode(t)
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            return counts, digests, decoded

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return append_columns(docs, text, keep, fields, make)
