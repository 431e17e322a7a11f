"""Seeds: depth rules and placement on a mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_drift.operators.locate import locate_points
from spark_drift.schema import INVALID_INT, Mesh
from spark_drift.util import number_rows


def resolve_seed_depth(seeds: DataFrame, mode: str, z: str = "x3", zmin: str = "zmin", zmax: str = "zmax") -> DataFrame:
    """Absolute z from a depth below the surface, a height above the bottom, or a restart."""
    v, lo, hi = F.col(z), F.col(zmin), F.col(zmax)
    if mode == "restart":
        return seeds
    if mode == "depth_below_surface":
        bad = F.raise_error(F.lit("seed lies above the free surface")).cast("double")
        return seeds.withColumn(z, F.when(v > 0, bad).otherwise(F.greatest(v + hi, lo)))
    if mode == "height_above_bottom":
        bad = F.raise_error(F.lit("seed lies below the sea floor")).cast("double")
        placed = F.when(lo > hi, lo).when(v + lo > hi, hi).otherwise(v + lo)
        return seeds.withColumn(z, F.when(v < 0, bad).otherwise(placed))
    raise ValueError(f"unknown depth mode {mode!r}")


def place_seeds(seeds: DataFrame, mesh: Mesh, wet: DataFrame | None = None, order: str = "line", x: str = "x", y: str = "y",
                check: bool = True) -> DataFrame:
    """Seeds numbered 1..n in input order with host, in_domain and is_beached.

    ``wet``: (element_id, wet) at the start time. Outside the mesh the host is −999."""
    numbered = number_rows(seeds, order, "particle_id")
    found = locate_points(numbered, mesh, x, y)
    if check and found.where("host is not null").isEmpty():
        raise ValueError("all seeds lie outside the mesh")
    out = found
    if wet is not None:
        out = out.join(wet.select(F.col("element_id").alias("host"), F.col("wet").alias("_wet")), "host", "left")
        beached = F.when(F.col("_wet") == 0, 1).otherwise(0)
    else:
        beached = F.lit(0)
    return out.select(*numbered.columns, F.coalesce("host", F.lit(INVALID_INT).cast("long")).alias("host"),
                      F.col("host").isNotNull().cast("int").alias("in_domain"), beached.cast("int").alias("is_beached"))
