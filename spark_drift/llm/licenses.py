"""License scans: phrases at their places, and text blocks that hold a license template.

Blocks are overlapping windows of words; a template lies in a block if the block holds at least
THRESHOLD of its distinct words. This set-similarity join is exact and compares no block with
templates it shares nothing rare with: words are ordered by how many texts have them, the rarest
first, and a block that holds enough of a template has one of the template's first words (its prefix)
among its own first ones. Length and place in the order bound the overlap before it is counted."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_drift.llm.common import stored

#: Letters of a word, phrases and their labels.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.9
#: Usual wordings of public licenses.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in "
            "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """Words of a template or phrase, as ``words`` takes them from a column."""
    return [w for w in re.split(GAP, text.translate(str.maketrans(_CAPITALS, _SMALL))) if w]


def words(text: Column) -> Column:
    """Words of a whole text with A-Z in lower case; none for a null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), GAP), lambda w: w != "")


def template_table(templates: Sequence[tuple[str, str]], threshold: float = THRESHOLD) -> list[dict]:
    """label, tokens (distinct words), need (words that a block must share) and reach: a stretch of
    ``reach`` words, a power of two not under the template's length, lies whole in some block of twice as many."""
    out = []
    for label, text in templates:
        listed = words_of(text)
        if listed:
            tokens = list(dict.fromkeys(listed))
            out.append({"label": label, "tokens": tokens, "need": max(1, math.ceil(threshold * len(tokens) - 1e-9)),
                        "reach": 1 << max(2, (len(listed) - 1).bit_length())})
    return out


def word_order(docs: DataFrame, text: str, tokens: Sequence[str]) -> list[str]:
    """``tokens`` by the number of whole texts that hold them, the rarest first (ties: by the word).

    One row per token comes back, whatever the size of the corpus."""
    if not tokens:
        return []
    held = docs.select(F.explode(F.filter(F.array_distinct(words(F.col(text))), lambda w: w.isin(list(tokens)))).alias("w"))
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(tokens, key=lambda w: (counts.get(w, 0), w))


def _starts(w: Column, phrase: Sequence[str]) -> Column:
    """Where the phrase's words stand side by side."""

    def here(x: Column, i: Column) -> Column:
        same = x == phrase[0]
        for k, own in enumerate(phrase[1:], 1):
            same = same & (F.get(w, i + k) == own)
        return F.when(same, i.cast("long"))

    return F.filter(F.transform(w, here), lambda i: i.isNotNull())


def _places(w: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """start and label of each place of a phrase."""
    labelled = lambda label: lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))
    found = [F.transform(_starts(w, words_of(phrase)), labelled(label)) for phrase, label in phrases]
    return F.concat(*found) if found else F.array().cast("array<struct<start:bigint,label:string>>")


def _blocks_of(w: Column, reach: int, templates: Sequence[dict], order: Sequence[str]) -> Column:
    rank = {t: i for i, t in enumerate(order)}
    known = sorted({x for t in templates for x in t["tokens"]}, key=rank.get)
    rare = sorted({x for t in templates for x in sorted(t["tokens"], key=rank.get)[:len(t["tokens"]) - t["need"] + 1]}, key=rank.get)
    least = min(t["need"] for t in templates)
    seeds = F.filter(F.transform(w, lambda x, i: F.when(x.isin(rare), F.floor(i / reach).cast("int"))), lambda i: i.isNotNull())
    # a seed lies in the block that begins with its stretch and in the one before
    starts = F.filter(F.array_distinct(F.flatten(F.transform(seeds, lambda i: F.array(i - 1, i)))), lambda i: i >= 0)

    def numbers(i: Column) -> Column:
        held = F.filter(F.array_distinct(F.slice(w, i * reach + 1, F.lit(2 * reach))), lambda x: x.isin(known))
        return F.array_sort(F.transform(held, lambda x: (F.array_position(F.lit(list(order)), x) - 1).cast("int")))

    blocks = F.filter(F.transform(starts, numbers), lambda b: F.size(b) >= least)
    return F.transform(blocks, lambda b: F.struct(F.lit(reach).alias("reach"), b.alias("tokens")))


def _blocks(w: Column, templates: Sequence[dict], order: Sequence[str]) -> Column:
    """reach and tokens (numbers in the order, ascending) of the blocks that can hold a template: those
    with a word of a template's prefix, and enough of the templates' words."""
    reaches = sorted({t["reach"] for t in templates})
    found = [_blocks_of(w, reach, [t for t in templates if t["reach"] == reach], order) for reach in reaches]
    return F.concat(*found) if found else F.array().cast("array<struct<reach:int,tokens:array<int>>>")


def template_blocks(blocks: DataFrame, templates: Sequence[dict], order: Sequence[str]) -> DataFrame:
    """id, label and containment of each block (id, reach, tokens) that holds a template of its reach.

    Prefix, length and positional filters, then the exact overlap; a pair may come out more than once."""
    rank = {t: i for i, t in enumerate(order)}
    index = []
    for t in templates:
        tokens = sorted(rank[x] for x in t["tokens"])
        for i, token in enumerate(tokens[:len(tokens) - t["need"] + 1]):
            index.append({"reach": t["reach"], "token": token, "_i": i, "label": t["label"], "_need": t["need"], "_template": tokens})
    kinds = pa.schema([("reach", pa.int32()), ("token", pa.int32()), ("_i", pa.int32()), ("label", pa.string()), ("_need", pa.int32()), ("_template", pa.list_(pa.int32()))])
    index = blocks.sparkSession.createDataFrame(pa.Table.from_pylist(index, kinds))
    least = {r: min(t["need"] for t in templates if t["reach"] == r) for r in {t["reach"] for t in templates}}
    need = F.coalesce(*[F.when(F.col("reach") == r, n) for r, n in least.items()], F.lit(1))
    size = F.size("tokens")
    prefix = blocks.select("id", "reach", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.greatest(size - need + 1, F.lit(0)))).alias("_j", "token"))
    whole = F.size("_template")
    long_enough = size >= F.col("_need")
    in_prefix = F.col("_j") <= size - F.col("_need")
    bound = 1 + F.least(whole - F.col("_i") - 1, size - F.col("_j") - 1) >= F.col("_need")
    met = prefix.join(index, ["reach", "token"]).where(long_enough & in_prefix & bound)
    shared = F.size(F.array_intersect("tokens", "_template"))
    return met.withColumn("_shared", shared).where(F.col("_shared") >= F.col("_need")).select("id", "label", (F.col("_shared") / whole).alias("containment"))


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES,
         templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``keep``, n_words, n_base (places of phrases), first_word and last_word
    (least and largest start of one, words from 0; else null), base_labels, labels (with those of the
    templates found) and score: 1 where a phrase stands, else the largest containment found, else 0.

    Labels are distinct, sorted and joined by commas; none give an empty string. A template counts where a
    block of the text holds ``threshold`` of its distinct words, in any order. Null and empty texts have no
    words. Equal rows each come out; an empty table gives no rows; kept columns named like a result give
    way. Texts are read twice (order of words, scan) and not shuffled; only blocks with a rare word of a
    template travel. Templates are a list given by the caller: their table is as small as that."""
    listed = template_table(templates, threshold)
    order = word_order(docs, text, sorted({x for t in listed for x in t["tokens"]}))
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [c for c in dict.fromkeys(keep) if c not in made]

    def marks(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _places(w, phrases).alias("places"), _blocks(w, listed, order).alias("blocks"))

    # the words are made once per text and looked at by name
    rows = docs.select(*[f"`{c}`" for c in kept], F.transform(F.array(words(F.col(text))), marks)[0].alias("_m"))
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "license-marks")
    blocks = rows.select(F.col("_id").alias("id"), F.explode("_m.blocks").alias("b")).select("id", "b.reach", "b.tokens")
    held = template_blocks(blocks, listed, order).groupBy(F.col("id").alias("_id")).agg(F.collect_set("label").alias("_found"), F.max("containment").alias("_best"))
    rows = rows.join(held, "_id", "left")
    places = F.col("_m.places")
    base = F.array_distinct(F.transform(places, lambda p: p["label"]))
    both = F.array_union(base, F.coalesce("_found", F.array().cast("array<string>")))
    comma = lambda labels: F.array_join(F.array_sort(labels), ",")
    return rows.select(*[f"`{c}`" for c in kept], F.col("_m.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
                       F.array_min(F.transform(places, lambda p: p["start"])).alias("first_word"), F.array_max(F.transform(places, lambda p: p["start"])).alias("last_word"),
                       comma(base).alias("base_labels"), comma(both).alias("labels"),
                       F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))
