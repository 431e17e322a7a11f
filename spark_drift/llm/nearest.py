"""Approximate nearest neighbours by largest inner product, over low-dimensional projections.

One more coordinate gives all vectors the same norm, so that the largest inner product is the
smallest distance. Gaussian projections to a few dimensions are indexed by kd-trees: a tree made
from a bounded sample deals all rows to cells, and each cell's own tree is searched from the nearest
leaf on. A point at distance d has a projected distance whose square is d² times a chi-square
variable; the search of a query ends when even the next leaf is so far that a better point would
lie there with a chance under 1 − CONFIDENCE. Cells are passed over by the same test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_drift.llm.common import stored
from spark_drift.llm.vectors import by_group, dimension_of, map_vectors, packed, usable

#: Dimensions of the projection, chance with which a better point is seen, rows of a leaf.
PROJECTED, CONFIDENCE, LEAF = 8, 0.97, 128
#: Rows wanted in a cell, most cells (their boxes are broadcast), rows that shape the cells, queries searched together.
CELL, MOST_CELLS, SAMPLE, TOGETHER = 4096, 4096, 20_000, 256
SEED = 5


def chi_square_bound(dimensions: int, chance: float) -> float:
    """The value that a chi-square variable with an even number of degrees of freedom stays under with ``chance``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        term, tail = 1.0, 0.0
        for j in range(dimensions // 2):
            tail += term
            term *= (mid / 2) / (j + 1)
        low, high = (mid, high) if 1 - np.exp(-mid / 2) * tail < chance else (low, mid)
    return high


def split_tree(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """axis and value of the inner nodes of a balanced kd-tree (heap order) over ``points``; ``leaves`` is a power of two."""
    axis, value = np.zeros(max(1, leaves), np.int64), np.zeros(max(1, leaves))
    parts = {1: np.arange(len(points))}
    for node in range(1, leaves):
        own = parts.pop(node)
        if len(own):
            a = int(np.argmax(np.ptp(points[own], axis=0)))
            v = float(np.median(points[own, a]))
            axis[node], value[node] = a, v
            right = points[own, a] > v
        else:
            right = np.zeros(0, bool)
        parts[2 * node], parts[2 * node + 1] = own[~right], own[right]
    return axis, value


def leaf_of(points: np.ndarray, axis: np.ndarray, value: np.ndarray, leaves: int) -> np.ndarray:
    """The leaf (from 0) each point falls into."""
    node = np.ones(len(points), np.int64)
    while leaves > 1:
        right = points[np.arange(len(points)), axis[node]] > value[node]
        node = 2 * node + right
        leaves //= 2
    return node - (1 << (int(node[0]).bit_length() - 1)) if len(node) else node


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, as an array (points, boxes)."""
    gap = np.maximum(0, np.maximum(low[None] - points[:, None], points[:, None] - high[None]))
    return (gap * gap).sum(2)


class Cell:
    """A cell's vectors under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        leaves = 1
        while leaves * LEAF < len(ids):
            leaves *= 2
        leaf = leaf_of(points, *split_tree(points, leaves), leaves)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.vectors, points = ids[order], vectors[order].astype(np.float64), points[order]
        starts = np.flatnonzero(np.diff(leaf[order], prepend=-1))
        self.starts, self.ends = starts, np.append(starts[1:], len(ids))
        self.low, self.high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)

    def search(self, ids: np.ndarray, queries: np.ndarray, points: np.ndarray, known: np.ndarray, k: int, radius: float, bound: float):
        """(query number, row of the cell, score) of the best ``k`` per query, ties included; ``known``:
        the k-th best score so far (−inf: none)."""
        n, norm = len(ids), np.linalg.norm(queries, axis=1)
        scores = np.full((n, len(self.ids)), -np.inf)
        far = box_distance(points, self.low, self.high)
        visit = np.argsort(far, axis=1)
        active, done, step = np.arange(n), 0, 2
        kth = known.copy()
        while len(active) and done < visit.shape[1]:
            # the next leaf is out of reach: its distance over that of the k-th best passes the test
            reach = bound * np.maximum(0, 2 * radius * (radius - kth[active] / norm[active]))
            near = far[active, visit[active, done]] < np.where(np.isinf(kth[active]), np.inf, reach)
            active = active[near]
            if not len(active):
                break
            wanted = visit[active, done:done + step]
            for leaf in np.unique(wanted):
                rows = active[(wanted == leaf).any(1)]
                part = slice(self.starts[leaf], self.ends[leaf])
                got = queries[rows] @ self.vectors[part].T
                got[ids[rows][:, None] == self.ids[part][None]] = -np.inf
                scores[rows, part] = got
            if scores.shape[1] >= k:
                kth[active] = np.maximum(known[active], np.partition(scores[active], -k, axis=1)[:, -k])
            done, step = done + step, step * 2
        # sums in one order for all rows, so that equal vectors have equal scores
        at, row = np.nonzero((scores > -np.inf) & (scores >= kth[:, None] - 1e-9 * radius * norm[:, None]))
        exact = (queries[at] * self.vectors[row]).sum(1)
        order = np.lexsort((self.ids[row], -exact, at))
        at, row, exact = at[order], row[order], exact[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        return at[rank < k], row[rank < k], exact[rank < k]


def search_cells(cells: DataFrame, queries: DataFrame, width: int, k: int, radius: float) -> DataFrame:
    """query_id, vec_id and score: each cell's best for the queries sent to it.

    Rows of a cell come to its task before its queries, which are then streamed past its tree."""
    bound = chi_square_bound(PROJECTED, CONFIDENCE)
    columns = ["cell", "part", "kind", "vec_id", "vector", "point", "known"]
    both = cells.withColumn("kind", F.lit(0)).withColumn("known", F.lit(0.0)).select(columns)
    both = both.union(queries.withColumn("kind", F.lit(1)).select(columns))
    both = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell = None
        for opens, part in by_group(batches, ["cell", "part", "kind"]):
            kind = part.column(2)[0].as_py()
            if kind == 0:
                if opens:
                    held, cell = [], None
                held.append(part)
                continue
            if held:
                table = pa.Table.from_batches(held)
                cell = (tuple(part.column(i)[0].as_py() for i in (0, 1)), Cell(table["vec_id"].to_numpy(), packed(table, "vector", np.float32, width), packed(table, "point", np.float64, PROJECTED)))
                held = []
            if cell is None or cell[0] != tuple(part.column(i)[0].as_py() for i in (0, 1)):
                continue  # no rows in this cell
            for low in range(0, part.num_rows, TOGETHER):
                some = part.slice(low, TOGETHER)
                ids = some.column(3).to_numpy()
                at, row, score = cell[1].search(ids, packed(some, "vector", np.float32, width).astype(np.float64), packed(some, "point", np.float64, PROJECTED),
                                                some.column(6).to_numpy(), k, radius, bound)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(cell[1].ids[row]), pa.array(score)], ["query_id", "vec_id", "score"])

    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` largest inner products of each query found.

    Queries are the rows whose id is divisible by ``every``; candidates all rows with another id.
    Vectors that are null, zero, of another than the usual length, or with null or non-finite
    components take no part, nor do null ids; of rows with one id the least vector counts. Fewer
    candidates than ``k`` are all returned, ties go to the smaller id, and an empty table gives an
    empty result. Every row is indexed; only the tree that deals rows to cells comes from a sample,
    at most SAMPLE rows. A cell of many rows (copies of one vector, say) is cut into parts."""
    spark = rows.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    good = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>").alias("e")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    good = good.groupBy("vec_id").agg(F.min("e").alias("e"))
    width = dimension_of(good, "e")
    if width is None:
        return spark.createDataFrame([], empty)
    good = good.where(F.size("e") == width)
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, radius = good.agg(F.count(F.lit(1)), F.max(norm)).first()
    turn = np.random.default_rng(SEED).standard_normal((width + 1, PROJECTED))

    def project(x: np.ndarray, as_query: bool) -> np.ndarray:
        x = x.astype(np.float64)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        if as_query:
            return np.hstack([x * (radius / size), np.zeros_like(size)]) @ turn
        return np.hstack([x, np.sqrt(np.maximum(0, radius**2 - size**2))]) @ turn

    def vectors_of(b: pa.RecordBatch) -> np.ndarray:
        return b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)

    leaves = 1
    while leaves < MOST_CELLS and leaves * CELL < n:
        leaves *= 2
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    tree = split_tree(project(np.stack(sample["e"].to_numpy()), False), leaves)

    def binary(x: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in x], pa.binary())

    def index(b: pa.RecordBatch) -> dict:
        x = vectors_of(b)
        p = project(x, False)
        return {"vec_id": b.column(0), "vector": binary(x), "point": binary(p), "cell": leaf_of(p, *tree, leaves), **{f"p{i}": p[:, i] for i in range(PROJECTED)}}

    axes = [f"p{i}" for i in range(PROJECTED)]
    indexed = stored(map_vectors(good, index, "vec_id long, vector binary, point binary, cell long, " + ", ".join(f"{a} double" for a in axes)), "index")
    sizes = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"l{i}") for i, a in enumerate(axes)], *[F.max(a).alias(f"h{i}") for i, a in enumerate(axes)])
    boxes = sorted(sizes.collect(), key=lambda r: r.cell)  # at most MOST_CELLS rows
    cell_ids = np.array([r.cell for r in boxes])
    parts = np.array([-(-r.n // (2 * CELL)) for r in boxes])
    low, high = (np.array([[r[f"{c}{i}"] for i in range(PROJECTED)] for r in boxes]) for c in "lh")
    parts_of = spark.createDataFrame([(int(c), int(p)) for c, p in zip(cell_ids, parts)], "cell long, parts int")
    cells = indexed.drop(*axes).join(F.broadcast(parts_of), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    asked = good.where(F.col("vec_id") % every == 0)
    bound = chi_square_bound(PROJECTED, CONFIDENCE)

    def home(b: pa.RecordBatch) -> dict:
        x = vectors_of(b)
        p = project(x, True)
        nearest_box = box_distance(p, low, high).argmin(1)
        return {"vec_id": b.column(0), "vector": binary(x), "point": binary(p), "cell": cell_ids[nearest_box], "parts": parts[nearest_box]}

    first_at = stored(map_vectors(asked, home, "vec_id long, vector binary, point binary, cell long, parts long"), "queries")
    spread = F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))
    first = stored(best(search_cells(cells, first_at.withColumn("part", spread).withColumn("known", F.lit(float("-inf"))), width, k, radius), k), "first")
    known = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    rest = first_at.join(known, "vec_id", "left").select("vec_id", "vector", "point", "cell", F.coalesce("known", F.lit(float("-inf"))).alias("known"))

    def others(b: pa.RecordBatch) -> dict:
        x, p = packed(b, "vector", np.float32, width).astype(np.float64), packed(b, "point", np.float64, PROJECTED)
        kth = b.column(4).to_numpy()
        reach = np.where(np.isinf(kth), np.inf, bound * np.maximum(0, 2 * radius * (radius - kth / np.linalg.norm(x, axis=1))))
        at, cell = np.nonzero((box_distance(p, low, high) < reach[:, None]) & (cell_ids[None] != b.column(3).to_numpy()[:, None]))
        return {"vec_id": b.column(0).take(pa.array(at)), "vector": b.column(1).take(pa.array(at)), "point": b.column(2).take(pa.array(at)), "known": kth[at], "cell": cell_ids[cell], "parts": parts[cell]}

    again = map_vectors(rest, others, "vec_id long, vector binary, point binary, known double, cell long, parts long").withColumn("part", spread)
    found = first.select("query_id", "vec_id", "score").union(search_cells(cells, again, width, k, radius))
    return best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
