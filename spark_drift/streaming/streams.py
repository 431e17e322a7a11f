"""Streams of fixes: sampling, periodic counts, and draining a stream (state per particle: ``state``)."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_drift.operators.locate import TEST_COLUMNS, element_cells, phi_columns, with_position
from spark_drift.operators.time import asof_frames
from spark_drift.schema import LAND, Mesh
from spark_drift.streaming.state import STORE
from spark_drift.util import shuffled


def stream_locate(fixes: DataFrame, mesh: Mesh, keep: list[str]) -> DataFrame:
    """Hosts of streamed fixes by stream–static joins: host, n0..n2, φ0..φ2; fixes off the mesh drop out.

    The static side is one row per grid cell with the cell's elements (a cell is at most twice as
    wide as they are, so there are few), the element of lowest id is picked among them in place: a
    fix comes out once, whatever the number of elements that share its position."""
    cells, scales = element_cells(mesh)
    left = fixes
    g = mesh.geographic
    left = with_position(left, "x", "y", g)
    axes = range(3 if g else 2)
    found = None
    for s in scales:
        side = F.pow(F.lit(2.0), F.lit(s))
        at = [F.floor(F.col(f"_u{'xyz'[a]}") / side).cast("long").alias(f"_p{a}") for a in axes]
        own = cells.where(F.col("_scale") == s).select(*[F.col(f"_c{a}").alias(f"_c{a}_{s}") for a in axes], F.col("elements").alias(f"_elements_{s}"))
        left = left.select("*", *[c.alias(f"_p{a}_{s}") for a, c in enumerate(at)])
        on = functools.reduce(lambda p, q: p & q, [F.col(f"_p{a}_{s}") == F.col(f"_c{a}_{s}") for a in axes])
        left = left.join(shuffled(own), on, "left")
    several = F.concat(*[F.coalesce(F.col(f"_elements_{s}"), F.array().cast(cells.schema["elements"].dataType)) for s in scales])
    rows = left.select(*keep, *[c for c in left.columns if c.startswith("_u")], F.array_sort(several, lambda a, b: (a["host"] - b["host"]).cast("int")).alias("_e"))
    names = TEST_COLUMNS[g]

    def hit(e: Column) -> Column:
        phis = phi_columns(g, lambda c: e[c] if c in names else F.col(c))
        return (phis[0] >= 0) & (phis[1] >= 0) & (phis[2] >= 0)

    rows = rows.withColumn("_h", F.get(F.filter("_e", hit), F.lit(0))).where("_h is not null")
    phis = phi_columns(g, lambda c: F.col(f"_h.{c}") if c in names else F.col(c))
    return rows.select(*keep, F.col("_h.host").alias("host"), *[F.col("_h.nv")[k].alias(f"n{k}") for k in range(3)], *[p.alias(f"phi{k}") for k, p in enumerate(phis)],
                       F.col("_h.mask_c").alias("mask_c"))


def _watermarked(fixes: DataFrame, late: str) -> DataFrame:
    """Event time must be a timestamp with time zone for a watermark."""
    return fixes.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)


def stream_sample(fixes: DataFrame, fields: DataFrame, frames: DataFrame, mesh: Mesh, variable: str, key: str = "fix_id") -> DataFrame:
    """(fix_id, time, host, value): a surface field at each streamed fix in a sea or boundary element.

    Mesh, frames and fields are static for the run. Every join is stream–static and each fix meets
    one row in each, so there is no state, no watermark, and every fix comes out once, at once. On a
    shared side the lowest element id is the host, and a land host is none, as in ``locate_points``."""
    hosts = stream_locate(fixes.select(key, "time", "x", "y"), mesh, [key, "time"]).where(F.col("mask_c") != LAND)
    rows = asof_frames(hosts, frames, missing="drop")
    node = fields.where((F.col("variable") == variable) & (F.col("level") == 0)).select("node_id", F.col("time").alias("_frame"), "value")
    corners = mesh.elements.select(F.col("element_id").alias("host"), F.posexplode("nv").alias("_slot", "node_id"))
    # an element's three values in a frame, once for all fixes
    values = corners.join(shuffled(node), "node_id").groupBy("host", "_frame").agg(*[F.max(F.when(F.col("_slot") == k, F.col("value"))).alias(f"_v{k}") for k in range(3)])
    parts = []
    for frame, share in (("t_last", F.lit(1.0) - F.col("t_frac")), ("t_next", F.col("t_frac"))):
        own = values.withColumnsRenamed({"_frame": frame} | {f"_v{k}": f"_{frame}{k}" for k in range(3)})
        rows = rows.join(shuffled(own), ["host", frame])
        parts += [F.coalesce(F.col(f"_{frame}{k}"), F.lit(0.0)) * F.col(f"phi{k}") * share for k in range(3)]
    return rows.select(key, "time", "host", functools.reduce(lambda a, b: a + b, parts).alias("value"))


def stream_counts(fixes: DataFrame, every: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Status counts per output period: tumbling, or sliding with ``slide`` (sessions: ``state.stream_sessions``).

    Rows later than ``late`` behind the newest one are dropped; the progress of the query counts them
    (numRowsDroppedByWatermark)."""
    w = _watermarked(fixes, late)
    span = F.window("time", every, slide) if slide else F.window("time", every)
    out = w.groupBy(span.alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("in_domain").alias("n_in_domain"),
        F.sum("is_beached").alias("n_beached"),
        F.sum("error_status").alias("n_error"),
    )
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("t_start"), F.col("w.end").cast("timestamp_ntz").alias("t_end"),
                      "n", "n_in_domain", "n_beached", "n_error")


def run_to_parquet(stream: DataFrame, path: str, mode: str = "append", newest_by: Sequence[str] = (), batches: bool = False,
                   idle: bool = True) -> DataFrame:
    """Drain what the source holds into Parquet and read it back.

    ``update`` output is written by batch, each batch to its own folder so that a retried
    batch replaces itself; with ``newest_by`` the last value of each key is returned, so that
    windows still open at the end are there too; with ``batches`` the rows of all batches and their column
    ``batch``. State lives in the RocksDB store, which processors need and large states fit.
    Without ``idle`` there are no batches without rows: state that expires by the clock (``ttl_s``) would
    ask for them without end."""
    spark = stream.sparkSession
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/_state")
    if mode == "append":
        writer = writer.outputMode("append").format("parquet").option("path", f"{path}/rows")
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

        writer = writer.outputMode(mode).foreachBatch(save)
    with state_store(spark, idle):
        query = writer.start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    if batches:
        return rows
    if newest_by:
        last = rows.groupBy(*newest_by).agg(F.max("batch").alias("batch"))
        rows = rows.join(last, [*newest_by, "batch"], "left_semi")
    return rows.select(*stream.columns)


@contextlib.contextmanager
def state_store(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """Queries started inside keep their state in the RocksDB store, without ``idle`` they run no batches
    without rows; the session's own settings come back after."""
    own = dict([STORE, ("spark.sql.streaming.noDataMicroBatches.enabled", str(idle).lower())])
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
