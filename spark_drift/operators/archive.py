"""Field archives that a join reads in place: nodes in the order of a curve, rows in buckets.

An archive is a table of field rows in folders of a day and a block of nodes, in buckets of (node, time)
and sorted by them. A join on (node, time) takes the buckets as they lie, so the archive is not
shuffled, and reads the folders of the days and blocks that its other side asks for. Nodes are numbered
along a space-filling curve first: the nodes of an element, and of elements close to each other, share a
block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spark_drift.operators.mesh import permute_nodes
from spark_drift.schema import Mesh
from spark_drift.util import cut_lineage, shuffled

#: Bits of a coordinate on the curve, and of a row's number inside its task (as Spark numbers rows).
CURVE_BITS, ROW_BITS = 16, 33
ARCHIVE_COLUMNS = ["variable", "time", "level", "node_id", "value"]


def _spread(df: DataFrame, c: str) -> DataFrame:
    """The 16 bits of ``c`` on the even places of 32."""
    for shift, keep in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        df = df.withColumn(c, F.col(c).bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(keep)))
    return df


def curve_permutation(nodes: DataFrame) -> DataFrame:
    """(node_id, place): nodes numbered 0, 1, … along a Z-curve over their bounding box.

    Rows are sorted by range over tasks; only the sizes of the tasks' parts meet in one place."""
    box = nodes.agg(*[f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    rows = nodes.select("node_id", "x", "y")
    low = {c: box.select(f"_lo{c}").scalar() for c in "xy"}
    high = {c: box.select(f"_hi{c}").scalar() for c in "xy"}
    steps = (1 << CURVE_BITS) - 1
    place = lambda c: F.coalesce(F.round((F.col(c) - low[c]) / F.nullif(high[c] - low[c], F.lit(0.0)) * steps), F.lit(0)).cast("long")
    rows = rows.select("node_id", place("x").alias("_x"), place("y").alias("_y"))
    rows = _spread(_spread(rows, "_x"), "_y")
    rows = rows.select("node_id", F.col("_x").bitwiseOR(F.shiftleft("_y", 1)).alias("_code"))
    rows = rows.repartitionByRange("_code", "node_id").sortWithinPartitions("_code", "node_id").withColumn("_at", F.monotonically_increasing_id())
    rows = cut_lineage(rows).select("node_id", F.shiftright("_at", ROW_BITS).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(sizes, "_part").select("node_id", (F.col("_first") + F.col("_row")).alias("place"))


def renumber_mesh(mesh: Mesh, permutation: DataFrame) -> Mesh:
    """The mesh with its nodes numbered by ``permutation`` (node_id, place); elements keep their ids."""
    nodes = permute_nodes(mesh.nodes, permutation).select(*mesh.nodes.columns)
    kept = [c for c in mesh.elements.columns if c != "nv"]
    corners = mesh.elements.select("element_id", F.posexplode("nv").alias("_slot", "node_id"))
    corners = permute_nodes(corners, permutation).groupBy("element_id").agg(*[F.max(F.when(F.col("_slot") == k, F.col("node_id"))).alias(f"_n{k}") for k in range(3)])
    elements = mesh.elements.select(*kept).join(shuffled(corners), "element_id").withColumn("nv", F.array("_n0", "_n1", "_n2"))
    return Mesh(nodes, elements.select(*mesh.elements.columns), mesh.cs)


def block_of(node: Column | str, nodes_per_block: int) -> Column:
    return F.floor((F.col(node) if isinstance(node, str) else node) / nodes_per_block).cast("int")


def write_archive(fields: DataFrame, table: str, path: str, nodes_per_block: int, buckets: int, mode: str = "errorifexists") -> DataFrame:
    """Write field rows (variable, time, level, node_id, value) as the bucketed ``table`` at ``path`` and read it.

    Each (day, block) has at most one file per bucket, sorted by node and time. A task of a join reads a
    bucket of all folders in use: choose ``buckets`` so that this fits a task and not under the session's
    number of shuffle partitions (else Spark deals the archive anew), and ``nodes_per_block`` so that files stay large. Rows meet in one task by (day, block, bucket) only, however many a day has."""
    rows = fields.select(*ARCHIVE_COLUMNS, F.col("time").cast("date").alias("date"), block_of("node_id", nodes_per_block).alias("block", metadata={"nodes": nodes_per_block}))
    file = F.pmod(F.hash("node_id", "time"), F.lit(buckets))
    (rows.repartition("date", "block", file).write.mode(mode).format("parquet").option("path", path).option("compression", "zstd")
     .partitionBy("date", "block").bucketBy(buckets, "node_id", "time").sortBy("node_id", "time").saveAsTable(table))
    return read_archive(fields.sparkSession, table)


def read_archive(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def is_archive(fields: DataFrame) -> bool:
    """Whether rows lie in folders that can be passed over."""
    return "date" in fields.columns or "block" in fields.columns


def pruned(fields: DataFrame, feeds: DataFrame) -> DataFrame:
    """Rows in the folders of ``fields`` that ``feeds`` (node_id, time) ask for; other tables as they are.

    Days and blocks in use come from a subquery that runs before the scan: as many values as there are
    folders, and nothing in between two times far apart is read."""
    if "date" in fields.columns:
        days = feeds.agg(F.collect_set(F.col("time").cast("date"))).scalar()
        fields = fields.where(F.array_contains(days, F.col("date")))
    if "block" in fields.columns and "nodes" in fields.schema["block"].metadata:
        blocks = feeds.agg(F.collect_set(block_of("node_id", fields.schema["block"].metadata["nodes"]))).scalar()
        fields = fields.where(F.array_contains(blocks, F.col("block")))
    return fields
