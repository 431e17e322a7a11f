"""Near-duplicate vectors by NN-descent.

A graph of each vector's best known neighbours starts from small blocks of random hyperplanes and is
refined by joins of neighbours with neighbours of neighbours, in 8-bit precision. Edges near the
threshold are then verified on the original vectors; once verified, a link stays, whatever becomes of
the lists. A vector whose whole list lies above the threshold is saturated: it may have more neighbours
than the list holds. Components of saturated vectors get further lists, of neighbours outside the
component alone, until none joins another; then the lists of saturated vectors, and of these alone,
are doubled and refined until their last entry lies under the threshold. Where a list of LONGEST is
still saturated, the exact way for the rest is to compare its component in blocks, of which only the
numbers of links are kept. An audit compares vectors that have links with all rows; while too many
links are missing, the graph goes on from new blocks."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_drift.llm.common import stored
from spark_drift.llm.components import components
from spark_drift.llm.vectors import by_group, dimension_of, map_vectors, packed, usable
from spark_drift.util import skew_safe_join

THRESHOLD = 0.93
#: Neighbours of a list, sets of starting blocks, rows wanted in a block, most members compared at once.
NEIGHBOURS, TREES, BLOCK, MEMBERS = 10, 4, 64, 256
#: Lists of saturated vectors are doubled up to this many neighbours.
LONGEST = 40
#: Rounds end when fewer than SETTLED of all list entries change, or after ROUNDS.
SETTLED, ROUNDS = 0.02, 6
#: Rows of a side when a component is compared in full.
SIDE = 256
#: Vectors with links in the audit, share of each one's links that must be found on average, and the passes after which it is an error.
AUDITED, RECALL, PASSES = 256, 0.995, 40
#: Most vectors drawn for the audit, and most of them at a time.
DRAWN, AT_ONCE = 1 << 16, 1 << 12
#: Similarities in the graph are products of 8-bit components; an edge is verified from this much under the threshold on.
SCALE, SLACK = 127, 0.03
SEED = 23

LISTS = "label int, v long, u long, s int"


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct neighbours of each v, as arrays of (s, u)."""
    merged = pairs.groupBy("label", "v").agg(F.collect_set(F.struct("s", "u")).alias("near"))
    return merged.withColumn("near", F.slice(F.sort_array("near", asc=False), 1, k))


def _entries(lists: DataFrame) -> DataFrame:
    return lists.select("label", "v", F.explode("near").alias("n")).select("label", "v", F.col("n.u").alias("u"), F.col("n.s").alias("s"))


def _compare(block: np.ndarray, ids: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
    """(v, u, s) for each member's at most ``k`` best others of the block that exceed its ``floor``;
    members with the same ``own`` are not each other's."""
    x = block.astype(np.float32)
    s = (x @ x.T).astype(np.int64)  # exact: products of 8-bit numbers
    s[own[:, None] == own[None]] = -(1 << 30)
    if len(ids) > k:
        floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k] - 1)
    v, u = np.nonzero(s > floor[:, None])
    return ids[v], ids[u], s[v, u]


def _stream(rows: DataFrame, keys: list[str], width: int, k: int, mix: int) -> DataFrame:
    """Compare the members of each group (columns label, v, own, q, floor), at most MEMBERS at a time.

    A larger group is cut in the order of a hash that ``mix`` changes, so members that one round keeps apart
    meet in another."""
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.xxhash64("v", F.lit(mix)), "v")
    at = {c: i for i, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[tuple] = []

        def flush():
            table = pa.Table.from_batches(held)
            ids = table.column(at["v"]).to_numpy()
            if len(ids) > 1:
                v, u, s = _compare(packed(table, "q", np.int8, width), ids, table.column(at["own"]).to_numpy(), table.column(at["floor"]).to_numpy(), k)
                out.append((np.full(len(v), table.column(at["label"])[0].as_py()), v, u, s))
            held.clear()

        def emitted():
            cols = [np.concatenate(c) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int64, np.int64, np.int32))], ["label", "v", "u", "s"])

        n = 0
        for opens, part in by_group(batches, keys):
            if held and (opens or n + part.num_rows > MEMBERS):
                flush()
                n = 0
            for low in range(0, part.num_rows, MEMBERS):
                if held and n + min(MEMBERS, part.num_rows - low) > MEMBERS:
                    flush()
                    n = 0
                held.append(part.slice(low, MEMBERS))
                n += held[-1].num_rows
            if len(out) >= 512:
                yield emitted()
        if held:
            flush()
        if out:
            yield emitted()

    return sorted_rows.mapInArrow(run, LISTS)


def _sized(items: DataFrame) -> DataFrame:
    """Items with the number of items of their label, ``n_label``."""
    return skew_safe_join(items, items.groupBy("label").agg(F.count(F.lit(1)).alias("n_label")), ["label"])


def _start(items: DataFrame, width: int, n: int, turn: int, k: int) -> DataFrame:
    """Neighbours within blocks: rows of a label on the same side of random hyperplanes, of as many as the
    label's own number of rows asks for (``n``: that of the largest label). A block that
    comes out large is cut by hashes, so that no task gets an unbounded group."""
    bits = max(0, int(np.ceil(np.log2(max(1.0, n / BLOCK)))))
    planes = np.random.default_rng(SEED + turn).standard_normal((TREES * bits, width)) if bits else np.zeros((0, width))

    def keys(b: pa.RecordBatch) -> dict:
        x = packed(b, "q", np.int8, width).astype(np.float32)
        side = (x @ planes.T > 0).reshape(len(x), TREES, bits)
        code = side.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(x), TREES), np.int64)
        needed = np.ceil(np.log2(np.maximum(1.0, b.column(4).to_numpy() / BLOCK))).astype(np.int64)
        code &= ((1 << needed) - 1)[:, None]
        return {"label": b.column(0), "v": b.column(1), "own": b.column(2), "q": b.column(3), "codes": pa.array(list(code))}

    coded = map_vectors(_sized(items.select("label", "v", "own", "q")).select("label", "v", "own", "q", "n_label"), keys,
                        "label int, v long, own long, q binary, codes array<long>")
    rows = coded.select("label", "v", "own", "q", F.posexplode("codes").alias("tree", "code"))
    sizes = rows.groupBy("label", "tree", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * BLOCK)
    rows = rows.join(sizes, ["label", "tree", "code"], "left")
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("v", "tree", F.lit(turn)), F.ceil(F.coalesce("n", F.lit(1)) / BLOCK)))
    return _stream(rows.select("label", "tree", "code", "cut", "v", "own", "q", F.lit(-(1 << 30)).alias("floor")), ["label", "tree", "code", "cut"], width, k, turn)


def _met(lists: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """label, host and v: all in the lists of a host and all that list it. The lists ``beside`` bring
    members together too."""
    entries = _entries(lists) if beside is None else _entries(lists).union(_entries(beside))
    edges = entries.select("label", F.col("v").alias("host"), F.col("u").alias("v"))
    return edges.union(edges.select("label", F.col("v").alias("host"), F.col("host").alias("v"))).distinct()


def _refine(items: DataFrame, lists: DataFrame, width: int, k: int, mix: int, beside: DataFrame | None = None) -> DataFrame:
    """One round: for each vector, all that list it and all in its list are compared with each other."""
    both = _met(lists, beside)
    floors = lists.select("v", F.when(F.size("near") < k, F.lit(-(1 << 30))).otherwise(F.element_at("near", -1)["s"]).alias("floor"))
    members = items.select("v", "own", "q").join(floors, "v", "left")
    members = members.withColumn("floor", F.coalesce("floor", F.lit(-(1 << 30))))
    return _stream(both.join(members, "v").select("label", "host", "v", "own", "q", "floor"), ["label", "host"], width, k, mix)


def _cosines(pairs: DataFrame, vectors: DataFrame, width: int, threshold: float) -> DataFrame:
    """a and b of the pairs whose cosine in double precision reaches the threshold."""
    x = vectors.select(F.col("v").alias("a"), F.col("e").alias("x"))
    y = vectors.select(F.col("v").alias("b"), F.col("e").alias("y"))

    def check(b: pa.RecordBatch) -> dict:
        p, q = (packed(b, c, np.float32, width).astype(np.float64) for c in ("x", "y"))
        ok = np.flatnonzero((p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))) >= threshold)
        return {"a": b.column(0).take(pa.array(ok)), "b": b.column(1).take(pa.array(ok))}

    return map_vectors(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y"), check, "a long, b long")


def _in_full(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """v and links: numbers of links (rows, by ``m``) inside each component, compared block by block."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("n_blocks"))
    rows = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("v"), F.col("n_blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    asked = rows.select("component", F.col("block").alias("i"), F.explode(other).alias("j"), F.lit(1).alias("kind"), "v", "e", "m")
    stood = rows.select("component", F.explode(other).alias("i"), F.col("block").alias("j"), F.lit(0).alias("kind"), "v", "e", "m")
    keys = ["component", "i", "j", "kind"]
    both = stood.union(asked).repartition("component", "i", "j").sortWithinPartitions(*keys, "v")

    def unit(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for opens, part in by_group(batches, keys):
            if part.column(3)[0].as_py() == 0:
                if opens:
                    held = []
                held.append(part)
                continue
            table = pa.Table.from_batches(held)
            x, ids, m = unit(packed(table, "e", np.float32, width)), table["v"].to_numpy(), table["m"].to_numpy()
            own = part.column(4).to_numpy()
            linked = (unit(packed(part, "e", np.float32, width)) @ x.T >= threshold) & (own[:, None] != ids[None])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(linked @ m)], ["v", "links"])

    return both.mapInArrow(run, "v long, links long").groupBy("v").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row: links to other vectors of the same label
    with a cosine of at least ``threshold``.

    Equal vectors of a label are one item with its number of rows, so copies are counted, not
    paired. Rows without a label or with a vector that is null, empty, zero, of another than the
    usual length, or with null or non-finite components have no links and are their own component;
    so have rows without an id, whose component is null and which are not kept. Rows with equal ids
    count as so many vectors. An empty table gives an empty result."""
    spark = rows.sparkSession
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("e"), F.col(label).cast("int").alias("label"))
    good = base.where(F.col("label").isNotNull() & F.col("id").isNotNull() & usable(F.col("e")))
    width = dimension_of(good, "e")
    if width is None:
        return _result(base.select("id").withColumn("links", F.lit(0)).withColumn("component", F.col("id")))
    takes_part = F.col("label").isNotNull() & F.col("id").isNotNull() & usable(F.col("e")) & (F.size("e") == width)

    def pack(b: pa.RecordBatch) -> dict:
        x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width) + np.float32(0)  # one zero
        size = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
        q = np.clip(np.rint(x / size * SCALE), -SCALE, SCALE).astype(np.int8)
        return {"id": b.column(0), "label": b.column(1), "e": pa.array([r.tobytes() for r in x], pa.binary()), "q": pa.array([r.tobytes() for r in q], pa.binary())}

    packed_rows = stored(map_vectors(base.where(takes_part).select("id", "label", "e"), pack, "id long, label int, e binary, q binary"), "packed")
    items = stored(packed_rows.groupBy("label", "e").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("m"), F.min("q").alias("q")), "items")
    items = items.withColumn("own", F.col("v"))
    n = _most(items)
    audited = _audited(items, width, threshold)
    if not audited and items.count() > DRAWN:
        warnings.warn(f"none of {DRAWN} vectors drawn has a link: the recall of rarer links is not measured", stacklevel=2)
    lists, known, recall = None, None, 0.0
    for turn in range(PASSES):
        lists, near = _graph(items, lists, width, n, turn, threshold)
        found, known = _links(items, lists, near, known, width, threshold, turn)
        recall = _recall(found, audited)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"after {PASSES} passes {recall:.4f} of the links of the audited vectors are found, {RECALL} are asked for")
    members = packed_rows.select("id", "label", "e").join(found, ["label", "e"]).select("id", F.col("links").alias("links"), "component")
    aside = base.where(~takes_part).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return _result(members.union(aside))


def _result(rows: DataFrame) -> DataFrame:
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return rows.select(F.col("id").alias("vec_id"), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), kept.alias("kept"))


def _most(items: DataFrame) -> int:
    """Items of the largest label."""
    return items.groupBy("label").count().agg(F.max("count")).first()[0] or 0


def _least(threshold: float) -> int:
    """The least product of 8-bit components that can be a link."""
    return int((threshold - SLACK) * SCALE * SCALE)


def _near(lists: DataFrame, threshold: float) -> DataFrame:
    """label, a > b and s of the entries that can be links."""
    near = _entries(lists).where(F.col("s") >= _least(threshold))
    return near.select("label", F.greatest("v", "u").alias("a"), F.least("v", "u").alias("b"), "s").distinct()


def _saturated(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """v of the lists of ``k`` entries whose last one can still be a link."""
    return lists.where((F.size("near") >= k) & (F.element_at("near", -1)["s"] >= _least(threshold))).select("v")


def _grown(items: DataFrame, lists: DataFrame, across: DataFrame, full: DataFrame, width: int, threshold: float, mix: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that can be links out of the lists of the saturated vectors ``full``, doubled until they are not,
    or hold LONGEST; and the v that are saturated still.

    They start from the ``lists`` and the pairs found ``across`` components. Only hosts that bring a saturated vector
    together with others are looked at, and only saturated vectors collect, of those that can be links."""
    k, open_ = NEIGHBOURS, full
    entries = _entries(lists).where(F.col("s") >= _least(threshold)).union(
        across.select("label", F.col("a").alias("v"), F.col("b").alias("u"), "s")).union(
        across.select("label", F.col("b").alias("v"), F.col("a").alias("u"), "s"))
    wide = stored(_top(entries, NEIGHBOURS + LONGEST), "wide")
    near = _near(wide, threshold)
    turn = 0
    while k < LONGEST and open_.take(1):
        k = min(2 * k, LONGEST)
        for _ in range(max(1, ROUNDS)):
            both = _met(wide)
            hosts = both.join(open_, "v", "left_semi").select("host").distinct()
            floors = open_.select("v", F.lit(_least(threshold) - 1).alias("floor"))
            members = items.select("v", "own", "q").join(floors, "v", "left").withColumn("floor", F.coalesce("floor", F.lit(1 << 30)))
            rows = both.join(hosts, "host", "left_semi").join(members, "v").select("label", "host", "v", "own", "q", "floor")
            new = stored(_top(_stream(rows, ["label", "host"], width, k, mix + turn).union(_entries(wide).join(open_, "v", "left_semi").select("label", "v", "u", "s")), k), "grown")
            before = wide.join(open_, "v", "left_semi").select(F.slice("near", 1, k).alias("near"))
            size = [d.agg(F.sum(F.size("near")).alias("n"), F.sum(F.aggregate("near", F.lit(0).cast("long"), lambda a, e: a + e["s"])).alias("s")).first() for d in (before, new)]
            wide = stored(wide.join(open_, "v", "left_anti").select("label", "v", "near").union(new.select("label", "v", "near")), "wide")
            near = near.union(_near(new, threshold))
            turn += 1
            # entries only come or give way to nearer ones
            if size[1].n - size[0].n <= SETTLED * size[0].n and size[1].s - size[0].s <= SETTLED * size[0].s:
                break
        open_ = stored(_saturated(new, k, threshold), "open")
    return near.distinct(), open_


def _graph(items: DataFrame, lists: DataFrame | None, width: int, n: int, turn: int, threshold: float, beside: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph after new blocks and as many rounds as change it; and the pairs that can be links of
    all its rounds, since later rounds may push them out of the lists."""
    k = NEIGHBOURS
    pairs = _start(items, width, n, turn, k)
    lists = stored(_top(pairs if lists is None else pairs.union(_entries(lists)), k), "lists")
    near = _near(lists, threshold)
    entries = lists.agg(F.sum(F.size("near"))).first()[0] or 0
    for step in range(ROUNDS):
        new = stored(_top(_refine(items, lists, width, k, ROUNDS * turn + step, beside).union(_entries(lists)), k), "lists")
        near = near.union(_near(new, threshold))
        old = lists.select("v", F.col("near").alias("old"))
        changed = new.join(old, "v", "left").agg(F.sum(F.size(F.array_except("near", F.coalesce("old", F.array().cast("array<struct<s:int,u:bigint>>")))))).first()[0] or 0
        lists = new
        if changed <= SETTLED * entries:
            break
    return lists, near.distinct()


def _members(items: DataFrame, comp: DataFrame, of: DataFrame) -> DataFrame:
    """The items of the components that hold one of the vectors ``of``, with their component."""
    wide = of.join(comp.withColumnRenamed("node", "v"), "v").select("component").distinct()
    return comp.join(wide, "component", "left_semi").withColumnRenamed("node", "v").join(items.drop("own"), "v")


def _links(items: DataFrame, lists: DataFrame, near: DataFrame, known: DataFrame | None, width: int, threshold: float, turn: int) -> tuple[DataFrame, DataFrame]:
    """v, label, e, links and component of all items; and the verified links, with those ``known`` before."""
    links = _cosines(near, items, width, threshold)
    links = stored(links if known is None else links.union(known).distinct(), "links")
    full = stored(_saturated(lists, NEIGHBOURS, threshold), "full")
    step, pairs = 0, near.limit(0)
    while True:
        comp = stored(components(links), "components")
        inside = _members(items, comp, full)
        # a link that no list holds lies between two saturated ones: look for it between components, where no list
        # grows to, until none is found
        shared = inside.groupBy("label").agg(F.count_distinct("component").alias("n")).where(F.col("n") > 1)
        apart = stored(inside.join(shared, "label", "left_semi").withColumn("own", F.col("component")), "apart")
        n = _most(apart)
        if not n:
            break
        # planes of its own for each search
        across = stored(_graph(apart, None, width, n, PASSES + turn + PASSES * step, threshold, beside=lists)[1], "across")
        more = stored(_cosines(across, items, width, threshold), "more")
        if not more.take(1):
            break
        links = stored(links.union(more).distinct(), "links")
        pairs = stored(pairs.union(across.join(more, ["a", "b"], "left_semi").select("label", "a", "b", "s")).distinct(), "pairs")
        step += 1
    grown, open_ = _grown(items, lists, pairs, full, width, threshold, PASSES * ROUNDS + LONGEST * turn)
    links = stored(links.union(_cosines(grown.join(links, ["a", "b"], "left_anti"), items, width, threshold)), "links")
    comp = stored(components(links), "components")
    counted = _in_full(_members(items, comp, open_), width, threshold)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = both.join(items.select(F.col("v").alias("b"), "m"), "b").groupBy("a").agg(F.sum("m").alias("listed")).withColumnRenamed("a", "v")
    of = items.join(comp.withColumnRenamed("node", "v"), "v", "left").join(listed, "v", "left").join(counted, "v", "left")
    # items are named by their least id, so a component's least node is its least id
    found = of.select("v", "label", "e", (F.coalesce("links", "listed", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "v").alias("component"))
    return stored(found, "found"), links


def _audited(items: DataFrame, width: int, threshold: float) -> dict[int, tuple[int, int, int]]:
    """Of vectors drawn by hashes, those with links: their links to others and to copies of themselves,
    and their label.

    The hash is stretched by the root of the label's size, so a label is drawn from by the root of its size
    and small ones are seen beside a large one. Each draw is compared with all rows. Draws go on until AUDITED vectors with links are there, all
    are drawn, or DRAWN are."""
    spark = items.sparkSession
    # a number from 0 to 1 by the vector, times the root; a vector alone in its label has no links
    order = F.shiftrightunsigned(F.xxhash64("v"), 11).cast("double") / F.lit(float(1 << 53)) * F.sqrt("n_label")
    sized = _sized(items.select("label", "v", "e", "m")).where("n_label > 1")
    drawn, size, after, out = 0, AUDITED, None, {}
    while len(out) < AUDITED and drawn < DRAWN:
        rest = sized if after is None else sized.where((order > after[0]) | ((order == after[0]) & (F.col("v") > after[1])))
        sample = rest.select("label", "v", "e", "m", order.alias("h")).orderBy("h", "v").limit(size).toPandas()
        if not len(sample):
            break
        wanted = np.stack([np.frombuffer(e, np.float32) for e in sample["e"]])
        shared = spark.sparkContext.broadcast((wanted, sample["label"].to_numpy()))  # at most AT_ONCE rows

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x, own = shared.value
            x = x.astype(np.float64)
            x /= np.sqrt((x**2).sum(1, keepdims=True))
            total = np.zeros(len(x), np.int64)
            for whole in batches:
                for low in range(0, whole.num_rows, 1024):
                    b = whole.slice(low, 1024)
                    y = packed(b, "e", np.float32, width).astype(np.float64)
                    y /= np.sqrt((y * y).sum(1, keepdims=True))
                    for label in np.unique(labels := b.column(0).to_numpy()):
                        at, of = np.flatnonzero(own == label), labels == label
                        total[at] += (x[at] @ y[of].T >= threshold) @ b.column(2).to_numpy()[of]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(total)], ["i", "n"])

        true = {r.i: r.n for r in items.select("label", "e", "m").mapInArrow(compare, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
        shared.unpersist()
        out |= {int(v): (true[i] - int(m), int(m) - 1, int(of)) for i, (v, m, of) in enumerate(zip(sample["v"], sample["m"], sample["label"])) if true[i] > m}
        drawn += len(sample)
        after = float(sample["h"].iloc[-1]), int(sample["v"].iloc[-1])
        size = min(4 * size, AT_ONCE)
    return out


def _recall(found: DataFrame, audited: dict[int, tuple[int, int, int]]) -> float:
    """Share of their links to others that is found, as the mean of the audited vectors of each label and
    then of the labels."""
    if not audited:
        return 1.0
    asked = found.sparkSession.createDataFrame([(v,) for v in audited], "v long")
    have = {r.v: r.links for r in found.join(F.broadcast(asked), "v").select("v", "links").collect()}
    shares: dict[int, list[float]] = {}
    for v, (others, copies, label) in audited.items():
        shares.setdefault(label, []).append(min(1.0, (have[v] - copies) / others))
    return float(np.mean([np.mean(of) for of in shares.values()]))
