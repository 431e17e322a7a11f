"""Values of gridded fields at arbitrary points and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_drift.operators.locate import locate_points
from spark_drift.operators.sample import adjust_boundary_phi, between_levels, is_wet, on_levels_of, values_on_layers
from spark_drift.operators.time import asof_frames, fields_around
from spark_drift.schema import PHI_EPS, Mesh
from spark_drift.util import ts_literal

KNOWN = ("uo", "vo", "thetao", "so")


def regrid(fields: DataFrame, mesh: Mesh, targets: DataFrame, times: Sequence, variables: Sequence[str],
           level_depths: Sequence[float] | None, frames: DataFrame, wet: DataFrame | None = None, layers: dict | None = None) -> DataFrame:
    """Chosen variables at every target (point_id, x, y, depth) for each time.

    Depth counts from the moving free surface (0 on top, negative below): z = depth + ζ.
    Null where the point is off the mesh, the host is dry, or z is outside [−h, ζ]. In
    boundary elements of geographic meshes the nearest sea node is used; over a masked lower
    level the level above counts alone. Every target is located once, before the times
    multiply the rows, and of the fields only the frames around the times are read."""
    unknown = [v for v in variables if v not in KNOWN]
    if unknown:
        raise ValueError(f"unknown variables {unknown}")
    found = locate_points(targets, mesh)
    at = F.array(*[ts_literal(t) for t in times])
    if mesh.geographic:
        found = adjust_boundary_phi(found, mesh)
    framed = asof_frames(found.select("*", F.explode(at).alias("time")), frames)
    framed = is_wet(framed, wet) if wet is not None else framed.withColumn("wet", F.lit(1))
    near = fields_around(fields, frames, F.array_min(at), F.array_max(at))
    framed = framed.withColumn("z", F.lit(0.0))
    if layers:
        out = values_on_layers(framed, near, mesh.nodes, variables, z=F.col("depth") + F.col("zeta_0"), every=True, **layers)
        value = F.col
    else:
        out = on_levels_of(framed, near, mesh.nodes, level_depths, variables, z=F.col("depth") + F.col("zmax"), every=True)
        value = lambda v: between_levels(F.col(f"{v}_a"), F.col(f"{v}_b"))
    slack = F.lit(PHI_EPS) * F.abs(F.col("zmax") - F.col("zmin"))  # depth 0 is the surface itself
    valid = F.col("host").isNotNull() & (F.col("wet") == 1) & F.col("z").between(F.col("zmin"), F.col("zmax") + slack)
    values = [F.when(valid, value(v)).alias(v) for v in variables]
    return out.select(*targets.columns, "time", "host", *values)
