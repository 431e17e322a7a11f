"""What each of several document filters removes in every order of applying them.

A document is a mask of the filters it fails. In lexicographic order the permutations that begin
with the same letters are one interval of ranks (its start is the Lehmer rank of the beginning), and a
mask is removed at step s exactly in the intervals whose first s - 1 letters lie outside the mask and
whose s-th lies in it. So each mask's count is added where such an interval begins and taken off
where it ends; a running sum over the ranks gives what every order removes at that step."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spark_drift.llm.common import stored

#: Letters of the text filters: A to D judge a text alone, E compares it with the others.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_SPACE = r"[\x20\x09-\x0D]+"


def lehmer_rank(begin: Sequence[int], n: int) -> int:
    """Rank of the first permutation of range(n) that begins with ``begin``."""
    rank, left = 0, list(range(n))
    for i, letter in enumerate(begin):
        rank += left.index(letter) * math.factorial(n - 1 - i)
        left.remove(letter)
    return rank


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last): where each mask of n filters is removed at each step."""
    out = []
    for step in range(1, n + 1):
        for begin in itertools.permutations(range(n), step):
            low = lehmer_rank(begin, n)
            rest = [f for f in range(n) if f not in begin]
            for inside in itertools.chain.from_iterable(itertools.combinations(rest, k) for k in range(len(rest) + 1)):
                mask = sum(1 << f for f in (begin[-1], *inside))
                out.append((mask, step, low, low + math.factorial(n - step)))
    return out


def _small(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A table of numbers made from the number of filters alone."""
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], pa.int32()) for i, name in enumerate(names)}))


def interactions(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per part, order of the filters and step, what the step's filter removes.

    ``masks`` has part, mask (bit i set: fails the filter ``letters[i]``), n, good and toxic (numbers of
    documents); rows may repeat. At most 6 filters, since there is a row for each of their orders.
    Parts are as many as the table has; each is a bounded number of rows (2 to the number of
    filters, then orders times steps), so no task holds more of one. An empty table gives no rows;
    null numbers count as 0."""
    n = len(letters)
    if not 1 <= n <= 6 or len(set(letters)) != n:
        raise ValueError("1 to 6 filters with different letters are needed")
    spark, ranks = masks.sparkSession, math.factorial(n)
    kinds = ["n", "good", "toxic"]
    totals = masks.groupBy("part", "mask").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in kinds])
    has = [F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(n)]
    per_filter = lambda test: F.array(*[F.sum(F.when(test(i), F.col("n")).otherwise(0)) for i in range(n)])
    parts = totals.groupBy("part").agg(F.sum("n").alias("_all"), per_filter(lambda i: has[i]).alias("_fails"),
                                       per_filter(lambda i: F.col("mask") == 1 << i).alias("_alone"))
    steps = _small(spark, removal_intervals(n), ["mask", "step", "low", "high"])
    ends = F.explode(F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign"))))
    changes = totals.join(steps, "mask").select("part", "step", ends.alias("e"), *kinds)
    changes = changes.select("part", "step", "e.rank", *[(F.col(c) * F.col("e.sign")).alias(c) for c in kinds])
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    grid = grid.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"))
    changes = changes.unionByName(grid.select("part", "step", "rank", *[F.lit(0).cast("long").alias(c) for c in kinds]))
    changes = changes.groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in kinds])
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = changes.select("part", "step", "rank", *[F.sum(c).over(upto).alias(c) for c in kinds]).where(F.col("rank") < ranks)
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(letters)])
    rows = removed.join(parts, "part").withColumn("filter_order", F.get(orders, F.col("rank")))
    rows = rows.withColumn("_f", F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    before = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "part", "filter_order", "step", (F.col("_all") - F.sum("n").over(before)).alias("kept"), F.col("n").alias("removed"),
        (F.get("_fails", "_f") - F.col("n")).alias("redundant"), F.get("_alone", "_f").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "_f")).alias("shapley"))


def text_mask(text: Column) -> Column:
    """The filters A to D that a text fails, as the bits 0 to 3; a null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    # one array, looked at twice
    few = F.transform(F.array(words), lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0)
                      + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w), 2).otherwise(0))[0]
    capitals = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text), 4).otherwise(0)
    return few + capitals + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def text_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n, good and toxic of whole ``docs``, for ``interactions``.

    A text fails E if a row of a smaller key has the same text (compared by SHA-256 and length). A null
    key is neither smaller nor larger than any: its rows never fail E and make none fail. Rows of
    one key and one text are one document several times and all pass or all fail. A null part is
    the empty string, a null text the empty text. A key counts as good or toxic if any of its rows in
    ``labels`` says 1; labels of no document and other columns play no part.

    Copies meet their first row by (text, key), so a text or a key that a third of all rows have is
    spread over tasks; texts themselves are read once and never shuffled."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(body, 256).alias("_digest"),
                       F.octet_length(body).alias("_bytes"), text_mask(F.col(text)).alias("mask"))
    rows = stored(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "filter-masks")
    first = rows.where("_key is not null").groupBy("_digest", "_bytes").agg(F.min("_key").alias("_key")).withColumn("_first", F.lit(True))
    rows = rows.join(first, ["_digest", "_bytes", "_key"], "left")
    rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("_key").isNotNull() & F.col("_first").isNull(), 16).otherwise(0))
    says = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    # rows without a key meet no label; their text spreads them over tasks
    rows = rows.withColumn("_spread", F.when(F.col("_key").isNull(), F.col("_digest")).otherwise(""))
    rows = rows.join(says.withColumn("_spread", F.lit("")), ["_key", "_spread"], "left")
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0)).alias(c[1:])
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("_good"), count("_toxic"))
