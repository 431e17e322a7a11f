"""Near-duplicate documents by SimHash fingerprints within a few bits of each other.

Fingerprints of 64 bits are cut into two segments: of fingerprints that differ in at most three bits
one segment differs in at most one. Each segment is indexed as it is and with each of its bits
deleted, the deleted bit telling the side of the join it goes to, so that two segments that differ
in exactly one bit meet in exactly one key, and equal segments in one more. Candidates that meet are
verified on all 64 bits; each linked pair comes out once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_drift.llm.common import append_columns, stored
from spark_drift.llm.components import components

#: Words of a shingle, seed of its hash, and the most bits in which linked fingerprints differ.
SHINGLE, HASH_SEED, MOST_BITS = 3, 42, 3
#: Hashes whose bits are counted at a time.
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text; 0 if it has no words or is null."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)] + [b""] * (SHINGLE - 1)
        hashes = [xxh64_intdigest(words[0], HASH_SEED)]
    else:
        hashes = [xxh64_intdigest(b"%b %b %b" % s, HASH_SEED) for s in zip(words, words[1:], words[2:])]
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), HASHES_AT_ONCE):
        part = np.array(hashes[low:low + HASHES_AT_ONCE], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and fp, the fingerprint of each whole text as a signed long."""

    def make():
        return lambda texts: [[f - (1 << 64) if f >> 63 else f for f in map(fingerprint, texts)]]

    return append_columns(docs, text, keep, [T.StructField("fp", T.LongType())], make)


def _entries(prints: DataFrame, side: int) -> DataFrame:
    """k and fp: the index entries of one side of the join.

    A key is the segment's number, the deleted bit (32: none) and the segment without it. Side 0
    holds deleted bits that were 0, side 1 those that were 1; both hold the undeleted segments."""

    def keys(number: int, segment: Column) -> list[Column]:
        deleted = [F.when(segment.bitwiseAND(F.lit(1 << p)) == side << p, segment - F.lit(side << p) + F.lit((p + 33 * number) << 32)) for p in range(32)]
        return [*deleted, segment + F.lit((32 + 33 * number) << 32)]

    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col("fp"), 32)
    return prints.select(F.explode(F.array_compact(F.array(*keys(0, low), *keys(1, high)))).alias("k"), "fp")


def links(prints: DataFrame) -> DataFrame:
    """a and b: each pair of the distinct fingerprints ``fp`` that differ in at most MOST_BITS bits, once.

    All pairs are found, without a cap on what meets in a key: copies of a fingerprint are one row
    here, and the fingerprints that share 31 given bits are few beside their copies."""
    a = _entries(prints, 0).withColumnRenamed("fp", "a")
    b = _entries(prints, 1).select(F.col("k").alias("k1"), F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    in_low = F.bit_count(differ.bitwiseAND(F.lit(0xFFFFFFFF)))
    whole = F.shiftright("k", 32)
    # undeleted segments meet both ways round: take one; both segments can meet: the low one counts
    once = ((whole % 33 != 32) | (F.col("a") < F.col("b"))) & ((whole < 33) | (in_low > 1))
    return a.join(b, (F.col("k") == F.col("k1")) & (F.bit_count(differ) <= MOST_BITS) & once).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, fingerprint (16 hex digits) and component_id, the least
    ``key`` of all documents reachable by links.

    Null and wordless texts have the fingerprint 0 and are linked like others. A null key is never
    a component's id unless its component has no other; rows with equal keys each come out. The
    table may be empty, and other columns play no part."""
    prints = stored(fingerprints(docs, [key], text), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    found = components(links(prints.select("fp").distinct()))
    member = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    member = member.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # fingerprints outside all links are their own component; the others get their component's least key
    alone = member.groupBy("component").agg(F.min("least").alias("component_id"))
    class_id = member.join(alone, "component").select("fp", "component_id")
    out = prints.join(class_id, "fp")
    return out.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
