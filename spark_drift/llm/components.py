"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_drift.llm.common import remove, scratch


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (u, v), u > v.

    Large star: every neighbour above a node is linked to the least of the node and its neighbours.
    Small star: every neighbour below, and the node itself, likewise. Both keep the components."""
    both = edges.select("u", "v") if small else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")) if small else joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its least node) for every node of the links (a, b); links may repeat.

    Rounds of a large and a small star over written tables, until a round changes nothing; their
    number grows with the logarithm of the longest path. No node's links are gathered anywhere:
    each step is a minimum per node, summed up before the shuffle, and a join."""
    spark = links.sparkSession
    a, b = F.col("a"), F.col("b")
    edges = links.where("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    state, last = None, None
    for _ in range(most_rounds):
        folder = scratch(spark, "stars")
        edges.write.parquet(folder)
        edges = spark.read.schema("u long, v long").parquet(folder)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last:
            remove(spark, last)
        last = folder
        if now == state:
            break
        state = now
        edges = _star(_star(edges, small=False), small=True)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
