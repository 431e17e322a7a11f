"""Token ids in compact files: a canonical, length-limited Huffman code in blocks that decode alone.

A folder holds ``codebook`` (id, code length), written once from the counts of the whole corpus, and
``blocks``: rows of whole documents in ascending order of their ids, each with the coded bits, the
documents' lengths, and the bit at which every CHECKPOINT-th symbol starts. A block needs only the
codebook to be read; inside it all checkpoints are decoded side by side with one table."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_drift.llm.common import append_columns, gathered, remove, scratch, words_of

#: Longest code; 2**MAX_BITS table entries must hold the vocabulary.
MAX_BITS = 18
#: A block is closed after the document that fills it to this many ids.
BLOCK_IDS = 1 << 16
#: Symbols between two noted bit positions.
CHECKPOINT = 64

# White space as the tokenizer's pattern takes it (Python's also has four control characters).
_SPACE, _OTHER, _LETTER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]", "[A-Za-zÀ-ÖØ-öø-ÿ]"
CHUNK = re.compile(f"{_SPACE}*{_OTHER}+|{_SPACE}+")
LETTERS_FIRST = re.compile(f"{_LETTER}+(?![^\\W\\d_])")
#: A space after white space, or white space that is rare (for Arrow's regular expressions).
UNEVEN = r"[ \t\n\r] |[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words, and other chunks, whose ids a Python worker keeps.
KEPT_WORDS, KEPT_CHUNKS = 800_000, 200_000


class ByteBpe:
    """Ids by the tokenizers library, which gets each distinct word and other chunk once.

    The byte-level pattern takes letters in runs with at most one space before them and never joins
    white space to what stands before it: texts cut where white space starts, or after a run of
    letters, are tokenised like the whole."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it has
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model.decode())
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        # the vocabulary spells a printable byte as itself and the others as the symbols from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.spelling = {b: b if b in printable else next(others) for b in range(256)}
        self.words: dict[str, bytes] = {}  # ids of a space and the word
        self.chunks: dict[str, bytes] = {}  # ids of the chunk as it stands

    def _made(self, parts: list[str], before: str) -> dict[str, bytes]:
        made = self.library.encode_batch_fast([before + p for p in parts], add_special_tokens=False)
        return {p: array(self.width.char, e.ids).tobytes() for p, e in zip(parts, made)}

    def _of_letters(self, words: Iterable[str]) -> dict[str, bytes]:
        """As ``_made`` for words of letters, each of which is one piece of the pattern with its space:
        the merges are all that is left to do."""
        merged, char, spelling, space = self.library.model.tokenize, self.width.char, self.spelling, chr(self.spelling[32])
        return {w: array(char, [t.id for t in merged(space + (w if w.isascii() else w.encode().decode("latin-1").translate(spelling)))]).tobytes() for w in words}

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.chunks.get, chunks))
        if None not in found:
            return found
        new = self._made(list({c for c, v in zip(chunks, found) if v is None}), "")
        if len(self.chunks) < KEPT_CHUNKS:
            self.chunks.update((c, v) for c, v in new.items() if len(c) <= 64)
        return [new[c] if v is None else v for c, v in zip(chunks, found)]

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before each; the words are distinct."""
        kept, match = self.words, LETTERS_FIRST.match
        found = list(map(kept.get, words))
        letters, others, parts = set(), [], []
        for w in (w for w, v in zip(words, found) if v is None):
            m = match(w)
            end = m.end() if m else 0
            if end == len(w) and end:
                letters.add(w)
            elif end:  # its letters may be known as a word, and what follows them as a chunk
                parts.append((w, w[:end], w[end:]))
                if w[:end] not in kept:
                    letters.add(w[:end])
            else:
                others.append(w)
        made = self._of_letters(letters) | self._made(others, " ")
        tails = list({b for _, _, b in parts})
        tail = dict(zip(tails, self._of_chunks(tails)))
        whole = {w: (made[a] if a in letters else kept[a]) + tail[b] for w, a, b in parts}
        made.update(whole)
        if len(kept) < KEPT_WORDS:
            kept.update(made)
            for w in [w for w in made if len(w) > 64]:
                del kept[w]
        return [made[w] if v is None else v for w, v in zip(words, found)]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after another, and where each text's ids end. A null counts as
        empty; ``end`` is put after each text."""
        uneven = pc.match_substring_regex(texts, UNEVEN)
        words, number, starts = words_of(pc.if_else(uneven, "", texts))
        # the first word of a text has no space before it; uneven texts are cut with care
        begin = starts[:-1]
        values = self._of_words(words)
        first = [words[i] for i in number[begin]]
        distinct = list(dict.fromkeys(first))
        at = {w: len(values) + i for i, w in enumerate(distinct)}
        values += self._of_chunks(distinct)
        number = number.astype(np.int64)
        number[begin] = [at[w] for w in first]
        for i in np.flatnonzero(uneven.to_numpy(zero_copy_only=False).astype(bool)):
            number[begin[i]] = len(values)
            values.append(b"".join(self._of_chunks(CHUNK.findall(texts[i].as_py()))))
        last = starts[1:]
        if end is not None:
            values.append(np.array([end], self.width).tobytes())
            number, last = np.insert(number, last, len(values) - 1), last + np.arange(1, len(last) + 1)
        ids, ends = gathered(values, number, self.width)
        return ids, ends[last - 1]


_LOADED: dict[bytes, ByteBpe] = {}


def byte_bpe(model: bytes) -> ByteBpe:
    """The encoder of a model, made once per Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(model)
    return _LOADED[key]


def encode_corpus(docs: DataFrame, model: bytes, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``: the ids of the whole text with ``end_id`` appended, as packed bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        enc = byte_bpe(shared.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids, ends = enc.encode(texts, end_id)
            offsets = np.concatenate([[0], ends * enc.width.itemsize]).astype(np.int32)
            return [pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])]

        return work

    return append_columns(docs, text, [key], [T.StructField("ids", T.BinaryType())], make, arrow=True)


def id_counts(rows: DataFrame, width: np.dtype) -> DataFrame:
    """id and n: how often each id occurs in the packed column ``ids``. One array of counts per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            one = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), width))
            total = np.concatenate([total, np.zeros(max(0, len(one) - len(total)), np.int64)])
            total[:len(one)] += one
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    parts = rows.select("ids").mapInArrow(run, "id long, n long")
    return parts.groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of a code of least total length in which none is over ``most`` bits, by package-merge.

    In each round packages of two from the round before are merged with the symbols; the 2n − 2
    cheapest of the last round tell how many bits each symbol gets. A single symbol gets one bit."""
    counts = np.asarray(counts, np.float64)
    n = len(counts)
    if n > 1 << most:
        raise ValueError(f"{n} symbols do not fit in codes of {most} bits")
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weights = counts[order]
    rounds: list[np.ndarray] = []  # for each round, which of its sorted entries are symbols
    level = weights
    for _ in range(most):
        single = np.ones(len(level), bool) if not rounds else flags
        rounds.append(single)
        packed = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, packed])
        place = np.argsort(merged, kind="stable")
        level, flags = merged[place], place < n
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(rounds):
        symbols = int(single[:take].sum())
        lengths[:symbols] += 1  # symbols come in ascending order of weight
        take = 2 * (take - symbols)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of ids from their lengths: shorter first, then by id."""

    def __init__(self, ids: Sequence[int], lengths: Sequence[int]):
        ids, lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order], lengths[order]
        self.bits = int(lengths.max()) if len(lengths) else 1
        step = np.left_shift(1, self.bits - self.lengths)
        first = np.concatenate([[0], np.cumsum(step)[:-1]]) if len(step) else step
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids], self.length[self.ids] = first >> (self.bits - self.lengths), self.lengths
        self.symbol_at = np.repeat(self.ids, step).astype(np.uint32)  # by the next ``bits`` bits
        self.length_at = np.repeat(self.lengths, step).astype(np.uint8)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ``ids`` and the position of every CHECKPOINT-th symbol."""
        length = self.length[ids]
        ends = np.cumsum(length)
        at = ends - length
        # a code of up to 32 bits lies in one or two of the 32-bit words it touches
        shifted = self.code[ids] << (64 - length - (at & 31)).astype(np.uint64)
        words = np.zeros(int(ends[-1] + 31) // 32 + 1, np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] |= np.add.reduceat(shifted >> np.uint64(32), first)
        words[word[first] + 1] |= np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes(), at[::CHECKPOINT].astype(np.uint32 if ends[-1] < 1 << 32 else np.uint64)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids; runs between checkpoints go side by side, symbol by symbol."""
        words = np.frombuffer(payload, ">u4").astype(np.uint64)
        pairs = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
        at = checkpoints.astype(np.int64)
        out = np.zeros((CHECKPOINT, len(at)), np.uint32)
        mask = np.uint64((1 << self.bits) - 1)
        full, rest = divmod(n, CHECKPOINT)
        for k in range(CHECKPOINT):
            if k == rest and rest:
                at = at[:full]  # the last run is shorter
            if not len(at):
                break
            window = (pairs[at >> 5] >> (64 - self.bits - (at & 31)).astype(np.uint64)) & mask
            out[k, :len(at)] = self.symbol_at[window]
            at = at + self.length_at[window]
        return out.T.reshape(-1)[:n]


BLOCK = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("wide", T.BooleanType()), T.StructField("checkpoints", T.BinaryType()), T.StructField("payload", T.BinaryType()),
])


def write_ids(rows: DataFrame, folder: str, width: np.dtype, key: str = "doc_id") -> None:
    """Write ``key`` and packed ``ids`` to ``folder`` in ascending order of ``key`` (nulls first).

    ``rows`` is read twice, for the counts and for the order: give a stored table. The codebook
    passes through the driver; it has one row per id of the vocabulary, whatever the input. Rows
    with equal keys follow each other in the order of their ids."""
    spark = rows.sparkSession
    counts = sorted((r.id, r.n) for r in id_counts(rows, width).collect())
    ids = [c[0] for c in counts]
    lengths = code_lengths(np.array([c[1] for c in counts], np.float64)).tolist()
    spark.createDataFrame(list(zip(ids, lengths)), "id long, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast((ids, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        book, part = Codebook(*shared.value), TaskContext.get().partitionId()
        keys: list = []
        held: list = []
        state = {"n": 0, "start": 0, "block": 0}

        def block() -> pa.RecordBatch:
            codes = np.frombuffer(b"".join(held), width).astype(np.int64)
            payload, checkpoints = book.encode(codes)
            sizes = [len(h) // width.itemsize for h in held]
            row = [part, state["block"], state["start"], len(codes), list(keys), sizes, checkpoints.itemsize == 8, checkpoints.tobytes(), payload]
            state.update(n=0, start=state["start"] + len(codes), block=state["block"] + 1)
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], BLOCK.names)

        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys.append(k)
                held.append(packed)
                state["n"] += len(packed) // width.itemsize
                if state["n"] >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()

    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.binary(), pa.binary()]
    ordered = rows.select(F.col(key).cast("long").alias("key"), "ids").repartitionByRange("key").sortWithinPartitions("key", "ids")
    ordered.mapInArrow(run, BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, fields: Sequence[T.StructField], digest, key: str = "doc_id") -> DataFrame:
    """One row per stored document: ``key``, start (ids of all documents before it), n_tokens and the
    ``fields`` that ``digest(ids)`` returns for its ids (an array of unsigned 32-bit integers).

    Starts are summed over parts of the store, of which there are as many as it had writing tasks."""
    book = [(r.id, r.length) for r in spark.read.schema("id long, length int").parquet(f"{folder}/codebook").collect()]
    shared = spark.sparkContext.broadcast(book)
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_start"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codebook(*zip(*shared.value)) if shared.value else None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(j)[i].as_py() for j, c in enumerate(BLOCK.names)}
                ids = code.decode(r["payload"], np.frombuffer(r["checkpoints"], np.uint64 if r["wide"] else np.uint32), r["n_ids"])
                ends = np.cumsum(r["lengths"])
                starts = ends - r["lengths"]
                made = zip(*[digest(ids[s:e]) for s, e in zip(starts, ends)])
                n = len(ends)
                cols = [[r["part"]] * n, r["keys"], starts + r["start"], r["lengths"], *made]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow, strict=True)], schema.names)

    docs = blocks.mapInArrow(run, schema)
    joined = docs.join(parts, "part")
    return joined.select(key, (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", *[f.name for f in fields])


def store_corpus(docs: DataFrame, model: bytes, folder: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the store to ``folder``; a null text is an empty one.

    The ids are tokenised once, into a scratch table that is removed at the end. Columns other than
    ``key`` and ``text`` play no part, repeated rows are stored as often as they come, and an empty
    table makes an empty store."""
    spark = docs.sparkSession
    width = byte_bpe(model).width
    raw = scratch(spark, "ids")
    encode_corpus(docs, model, end_id, key, text).write.option("compression", "zstd").parquet(raw)
    rows = spark.read.schema(T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.BinaryType())])).parquet(raw)
    write_ids(rows, folder, width, key)
    remove(spark, raw)


def crc_of(ids: np.ndarray) -> tuple[int]:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


CRC = [T.StructField("ids_crc32", T.LongType())]
