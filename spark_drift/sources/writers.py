"""Writers of trajectories, snapshots, seeds and meshes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_drift.functions.timecols import due, encode_time
from spark_drift.util import one_row

TRAJECTORY_COLUMNS = ["particle_id", "time", "x1", "x2", "x3", "error_status", "in_domain", "is_beached", "land_boundary_encounters"]


def write_trajectories(df: DataFrame, path: str, extra: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Fixes under ``path/fixes`` by (release, date), time as whole seconds since 1960; groups apart.

    Partitions are rebalanced by size before the write, so a hot day is split over tasks."""
    columns = [c for c in TRAJECTORY_COLUMNS if c in df.columns] + list(extra)
    out = df.select("release", F.col("time").cast("date").alias("date"), *columns)
    out = out.withColumn("time", encode_time("time"))
    out.hint("rebalance", "release", "date").write.mode(mode).partitionBy("release", "date").option(
        "compression", "zstd").parquet(f"{path}/fixes")
    if "group_id" in df.columns:
        groups = df.groupBy("release", "particle_id").agg(F.min("group_id").alias("group_id"))
        groups.write.mode(mode).option("compression", "zstd").parquet(f"{path}/groups")


def write_snapshot(df: DataFrame, path: str, every_s: int, start=None, mode: str = "errorifexists") -> None:
    """Group and position of every particle at each due instant, one folder per instant."""
    if start is None:
        start = one_row(df.agg(F.min("time").alias("t0")))["t0"]
    rows = df.where(due("time", start, every_s)).select("group_id", "x1", "x2", "x3", "time")
    rows = rows.withColumn("snapshot_time", F.date_format("time", "yyyyMMdd'T'HHmmss"))
    rows.hint("rebalance", "snapshot_time").write.mode(mode).partitionBy("snapshot_time").parquet(path)


def write_seeds(df: DataFrame, path: str, n: int | None = None, mode: str = "errorifexists", order: Sequence[str] = ()) -> None:
    """Seed text: the number of rows, then ``group x1 x2 x3`` by group and, inside a group, in the order of
    ``line`` (or the columns ``order``), as ``read_seeds`` gives it."""
    found = df.count()
    if n is not None and n != found:
        raise ValueError(f"{n} seeds declared, {found} given")
    order = list(order) or (["line"] if "line" in df.columns else ["x1", "x2", "x3"])
    head = df.sparkSession.range(1).select(F.lit(str(found)).alias("value"), F.lit(0).alias("_o"), F.lit(None).cast("int").alias("group_id"),
                                           *[F.lit(None).cast(df.schema[c].dataType).alias(f"_{c}") for c in order])
    text = F.concat_ws(" ", F.col("group_id").cast("string"), *[F.col(c).cast("string") for c in ("x1", "x2", "x3")])
    rows = df.select(text.alias("value"), F.lit(1).alias("_o"), F.col("group_id").cast("int").alias("group_id"), *[F.col(c).alias(f"_{c}") for c in order])
    head.unionByName(rows).orderBy("_o", "group_id", *[f"_{c}" for c in order]).select("value").write.mode(mode).text(path)


def write_mesh(nodes: DataFrame, elements: DataFrame, path: str, levels: DataFrame | None = None, is_global: bool = False,
               mode: str = "errorifexists") -> None:
    """Node, element and level tables; the flag ``is_global`` rides as column metadata."""
    tagged = nodes.withColumn("node_id", F.col("node_id").alias("node_id", metadata={"is_global": is_global}))
    tagged.write.mode(mode).parquet(f"{path}/nodes")
    elements.write.mode(mode).parquet(f"{path}/elements")
    if levels is not None:
        levels.write.mode(mode).parquet(f"{path}/levels")


def write_fields(fields: DataFrame, path: str, source: str = "source", mode: str = "errorifexists") -> None:
    """Field rows by (source, variable, date), rebalanced so that a large variable is split over tasks."""
    out = fields if "source" in fields.columns else fields.withColumn("source", F.lit(source))
    out = out.withColumn("date", F.col("time").cast("date"))
    out.hint("rebalance", "source", "variable", "date").write.mode(mode).partitionBy("source", "variable", "date").parquet(path)
