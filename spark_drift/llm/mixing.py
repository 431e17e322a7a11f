"""Mixing sources to target weights by fitting word budgets.

Targets are shares by weight under a ceiling per source. A source's budget is filled by counts of
documents by exact length: whole rounds, then the long documents by a bounded-knapsack dynamic
programme in coarse units, a like share of every short length, and an exact programme over the
lengths left for the last words. Which documents of a length are taken is decided by seeded hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_drift.llm.common import stored

#: Weights of the sources in the order of their names, repeating; share of all words; most copies.
WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
#: Words that the dynamic programme fits at the end of a source's budget.
LAST_WORDS = 1 << 14
#: Bundles and units of the programme over longer documents; choices of them that are filled up and compared.
LONG_BUNDLES, LONG_UNITS, LONG_CHOICES = 512, 1 << 20, 16
SEED = 11
#: Rows of a group of equal length that are ranked together.
RANKED = 1000


def word_count(text: Column) -> Column:
    """Number of words (runs without ASCII white space); 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _bundles(numbers: Sequence[int], counts: Sequence[int]) -> list[tuple[int, int]]:
    """(i, n): the counts of ``numbers`` in powers of two and a rest."""
    out = []
    for i in numbers:
        left, size = counts[i], 1
        while left > 0:
            n = min(size, left)
            out.append((i, n))
            left, size = left - n, size * 2
    return out


def _long_takes(sizes: Sequence[int], counts: Sequence[int], budget: int, last: int) -> Iterator[list[int]]:
    """Choices of the documents of more than ``last`` words, the likeliest to fit first: sums that the
    short documents can complete, from the nearest to the like share on; then the nearest others.

    Bundles beyond LONG_BUNDLES are shared out evenly over the lengths, for a sum in the middle of
    what the programme can reach. Its words are in units such that it has at most LONG_UNITS."""
    long = sorted((i for i, s in enumerate(sizes) if s > last), key=lambda i: -sizes[i])
    total = sum(s * c for s, c in zip(sizes, counts))
    own = sum(sizes[i] * counts[i] for i in long)
    least = max(0, budget - (total - own))  # what the short ones cannot cover
    aim = min(max(budget * own // total, least), budget)
    bundles, ahead = _bundles(long, counts), [0] * len(sizes)
    if len(bundles) > LONG_BUNDLES:
        chosen = {k * (len(bundles) - 1) // (LONG_BUNDLES - 1) for k in range(LONG_BUNDLES)}
        others = [b for k, b in enumerate(bundles) if k not in chosen]
        bundles = [b for k, b in enumerate(bundles) if k in chosen]
        rest = sum(sizes[i] * n for i, n in others)
        share = min(rest, max(0, aim - sum(sizes[i] * n for i, n in bundles) // 2))
        seen = 0
        for i, n in others:
            ahead[i] += (seen + n) * share // rest - seen * share // rest
            seen += n
    spent = sum(s * t for s, t in zip(sizes, ahead))
    limit = min(sum(sizes[i] * n for i, n in bundles), max(0, budget - spent) + sizes[long[0]])
    unit = -(-limit // LONG_UNITS) or 1
    mask = (1 << (limit // unit + 1)) - 1
    before, reached = [], 1
    for i, n in bundles:
        before.append(reached)
        reached |= (reached << (sizes[i] * n + unit // 2) // unit) & mask
    at = np.flatnonzero(np.unpackbits(np.frombuffer(reached.to_bytes(limit // unit // 8 + 1, "little"), np.uint8), bitorder="little"))
    words = at * unit + spent
    outside = np.maximum(np.maximum(least - words, words - budget), 0)
    for x in at[np.lexsort((np.abs(words - aim), outside))[:LONG_CHOICES]].tolist():
        take = list(ahead)
        for (i, n), without in zip(reversed(bundles), reversed(before)):
            if not without >> x & 1:
                take[i] += n
                x -= (sizes[i] * n + unit // 2) // unit
        yield take


def fit_budget(sizes: Sequence[int], counts: Sequence[int], budget: int, last: int = LAST_WORDS) -> list[int]:
    """How many documents of each size to take, at most ``counts``, for words as near to ``budget`` as
    the programme gets (of two as near, the fewer); ``budget`` is at most the sum of all.

    Documents longer than ``last`` words are decided first. What the budget then has beyond the
    ``last`` words is shared out over the short sizes alike and filled from the longest of them; the
    programme fits the rest. A budget within the ``last`` words is left to the programme alone, which
    is then the best there is."""
    if budget <= last or max(sizes, default=0) <= last:
        return _fill(sizes, counts, budget, last, [0] * len(sizes))
    best, nearest = [0] * len(sizes), budget
    for chosen in _long_takes(sizes, counts, budget, last):
        take = _fill(sizes, counts, budget, last, chosen)
        off = abs(budget - sum(s * t for s, t in zip(sizes, take)))
        if off < nearest:
            best, nearest = take, off
        if not off:
            break
    return best


def _fill(sizes: Sequence[int], counts: Sequence[int], budget: int, last: int, chosen: Sequence[int]) -> list[int]:
    """``chosen`` (of the long sizes) and what brings it to the budget."""
    take = list(chosen)
    rest = budget - sum(s * t for s, t in zip(sizes, take))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    short = [i for i in order if sizes[i] <= last]
    total = sum(sizes[i] * counts[i] for i in short)
    ahead = min(total, max(0, rest - last))
    for i in short:
        take[i] = counts[i] * ahead // total if total else 0
        rest -= take[i] * sizes[i]
    for i in short:  # from the longest down to the last words
        more = min(counts[i] - take[i], max(0, rest - last) // sizes[i])
        take[i] += more
        rest -= more * sizes[i]
    if rest <= 0 or rest >= 2 * last:  # no short document is left, and the long ones are decided
        return take
    # sums reachable with each bundle (a power of two copies of a size); via: the first bundle that reaches a sum
    bundles: list[tuple[int, int]] = []
    via: dict[int, int] = {}
    limit = 2 * rest
    reached, mask = 1, (1 << (limit + 1)) - 1
    for i in order:
        left, size = min(counts[i] - take[i], limit // sizes[i]), 1
        while left > 0 and not reached >> rest & 1:
            n = min(size, left)
            new = (reached << n * sizes[i]) & mask & ~reached
            reached |= new
            while new:
                low = new & -new
                via[low.bit_length() - 1] = len(bundles)
                new ^= low
            bundles.append((i, n))
            left, size = left - n, size * 2
    at = min((abs(x - rest), x) for x in [0, *via])[1]
    while at:
        i, n = bundles[via[at]]
        take[i] += n
        at -= n * sizes[i]
    return take


def source_targets(by_source: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size and target from source and source_size.

    Weights go round the sources in the order of code points, null last. The level that shares out
    ``share`` of all words is found along the sources in the order in which they reach their ceiling
    of ``most`` times their size. The windows run over one row per source."""
    every = Window.partitionBy()
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((order - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("ceiling", F.col("source_size") * float(most)).withColumn("_total", F.sum("source_size").over(every) * share)
    filling = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    rows = rows.withColumn("_full_at", F.col("ceiling") / F.col("weight"))
    capped = F.coalesce(F.sum("ceiling").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col("_total") - capped) / open_weight)
    # the first source that does not reach its ceiling sets the level
    level = F.min_by(F.when(F.col("_full_at") > F.col("_level"), F.col("_level")), F.when(F.col("_full_at") > F.col("_level"), F.col("_full_at"))).over(every)
    target = F.least(F.col("ceiling"), F.coalesce(level * F.col("weight"), F.col("ceiling")))
    return rows.select("source", "source_size", target.alias("target"))


def plan_mix(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The stored plan from key, source and size (words): for each (source, size) rounds (copies that
    every document gets) and bound: one more copy for documents whose seeded hash is at most that.
    And the sources with their sizes and targets.

    One task holds the distinct lengths of one source, never its documents. Ranks are taken in
    buckets of about RANKED rows of a length, so many documents of one length are no hot group."""
    lengths = stored(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    targets = stored(source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most), "targets")

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["size"] > 0].sort_values("size")
        out = pd.DataFrame({"source": rows["source"], "size": rows["size"], "n": rows["n"], "rounds": 0, "more": 0})
        if len(rows):
            total, budget = int(rows["source_size"].iloc[0]), int(rows["target"].iloc[0] + 0.5)
            rounds = min(most, budget // total)
            out["rounds"] = rounds
            if rounds < most:
                out["more"] = fit_budget(rows["size"].tolist(), rows["n"].tolist(), budget - rounds * total)
        return out

    with_target = lengths.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    counts = with_target.groupBy("source").applyInPandas(fill, "source string, size long, n long, rounds int, more long")
    counts = stored(counts, "counts")
    # the bound of a length is the hash of its document number ``more`` in the order of hashes
    some = counts.where((F.col("more") > 0) & (F.col("more") < F.col("n"))).withColumnRenamed("source", "_s").withColumnRenamed("size", "_z")
    hashed = sizes.withColumn("hash", seeded(seed)).join(some, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    part = F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("n") / RANKED)).cast("long")
    hashed = hashed.select("source", "size", "more", "hash", part.alias("part"))
    parts = hashed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("part").alias("_p"), "before", "in_part")
    edge = hashed.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("part") == F.col("_p"))
                       & (F.col("before") < F.col("more")) & (F.col("more") <= F.col("before") + F.col("in_part")))
    ranked = edge.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("hash")) + F.col("before"))
    bounds = ranked.where(F.col("rank") == F.col("more")).select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("hash").alias("edge"))
    plan = counts.join(bounds, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left").drop("_s", "_z")
    bound = F.when(F.col("more") == 0, F.lit(None)).when(F.col("more") >= F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.col("edge"))
    plan = plan.select(F.col("source").alias("plan_source"), F.col("size").alias("plan_size"), "rounds", bound.alias("bound"))
    return stored(plan, "mix_plan"), targets


def seeded(seed: int = SEED, key: str = "key") -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def mix(rows: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", keep: Sequence[str] = (), sizes: DataFrame | None = None,
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``keep``, size, source_size, target (the source's), copies and taken (words: copies × size).

    ``rows`` has the sizes in words; ``sizes`` is a cheaper table of key, source and size if there
    is one. A document is taken whole, at most ``most`` times. Documents without words are not
    taken. Rows with the same id are taken alike, as are those without one (a source's words then
    stray from the target by at most theirs). A null source is a source of its own, last in the
    order. The result is the same whenever it is made. Kept columns named like a result give way."""
    narrow = (sizes if sizes is not None else rows).select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).alias("size"))
    plan, targets = plan_mix(narrow, weights, share, most, seed)
    results = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in keep if c not in results]
    out = rows.select(*kept, F.col(size).alias("_size"), F.col(source).alias("_source"), seeded(seed, key).alias("_hash"))
    out = out.join(targets.withColumnRenamed("source", "_named"), F.col("_source").eqNullSafe(F.col("_named")), "left")
    out = out.join(plan, F.col("_source").eqNullSafe(F.col("plan_source")) & (F.col("_size") == F.col("plan_size")), "left")
    copies = F.coalesce(F.col("rounds"), F.lit(0)) + F.coalesce((F.col("_hash") <= F.col("bound")).cast("int"), F.lit(0))
    out = out.withColumn("copies", copies)
    return out.select(*kept, F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))
