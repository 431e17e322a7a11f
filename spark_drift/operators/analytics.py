"""Analysis of trajectories: densities, errors, survival and status."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_drift.functions.timecols import round_time
from spark_drift.operators.locate import locate_points
from spark_drift.operators.sample import adjust_boundary_phi, between_levels, on_levels_of, values_on_layers
from spark_drift.operators.time import asof_frames, elapsed_dates, fields_around
from spark_drift.schema import Mesh
from spark_drift.util import cut_lineage, one_row, shuffled, skew_safe_join, ts_literal

BLOCK = 16  # evaluation points summed per row


def sample_along_paths(fixes: DataFrame, fields: DataFrame, mesh: Mesh, frames: DataFrame, level_depths: Sequence[float] | None,
                       variables: Sequence[str] = (), surface: Sequence[str] = (), key: str = "fix_id", layers: dict | None = None) -> DataFrame:
    """h, ζ, 3-D ``variables`` and 2-D ``surface`` fields at every fix (fix_id, time, x, y, z).

    Every fix stays; off the mesh the samples are null. Only the key, position and time
    travel through the joins; wide trajectory rows are joined back by the key. In boundary elements
    of geographic meshes the nearest sea node is used; over a masked lower level the level above
    counts alone. Of the fields only the frames around the fixes are read. ``layers`` describes a
    terrain-following source instead of ``level_depths``, as in ``regrid``."""
    found = locate_points(fixes.select(key, "time", "x", "y", "z"), mesh).where("host is not null")
    if mesh.geographic:
        found = adjust_boundary_phi(found, mesh)
    framed = asof_frames(found.drop("mask_c", "flag"), frames)
    span = one_row(fixes.agg(F.min("time").alias("first"), F.max("time").alias("last")))  # of the time column alone
    first, last = (F.lit(span[c]).cast("timestamp_ntz") for c in ("first", "last"))
    flat = [s for s in surface if s != "zeta"]
    near = fields_around(fields, frames, first, last)
    if layers:
        placed = values_on_layers(framed, near, mesh.nodes, variables, flat, **layers)
        new = {v: F.col(v) for v in variables}
    else:
        placed = on_levels_of(framed, near, mesh.nodes, level_depths, variables, surface=flat)
        new = {v: between_levels(F.col(f"{v}_a"), F.col(f"{v}_b")) for v in variables}
    samples = placed.select(key, "host", (-F.col("zmin")).alias("h"), F.col("zmax").alias("zeta"), *[c.alias(name) for name, c in new.items()], *flat)
    return fixes.join(shuffled(samples), key, "left")


def select_group(fixes: DataFrame, group_ids: Sequence[int] | DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Fixes of chosen groups; ``groups`` (particle_id, group_id) where ids are kept apart."""
    if groups is not None:
        fixes = fixes.drop("group_id").join(groups.select("particle_id", "group_id"), "particle_id")
    if isinstance(group_ids, DataFrame):
        return fixes.join(group_ids.select("group_id").distinct(), "group_id", "left_semi")
    return fixes.where(F.col("group_id").isin(list(group_ids)))


def positions_at(fixes: DataFrame, time_of_flight_s: float | Sequence[float], release: str = "release",
                 time: str = "time") -> DataFrame:
    """Rows at the first time of their release plus the time of flight (adds delta_s)."""
    deltas = list(time_of_flight_s) if isinstance(time_of_flight_s, Sequence) else [time_of_flight_s]
    wanted = elapsed_dates(fixes, deltas, release, time)
    return skew_safe_join(fixes, wanted, [release, time])


def paths_until(fixes: DataFrame, t, key: str = "particle_id", time: str = "time") -> DataFrame:
    """Pathlines up to a time: fixes in (particle, time) order.

    A global sort on both columns: a long path is spread over several range partitions."""
    return fixes.where(F.col(time) <= ts_literal(t)).orderBy(key, time)


# --- densities -------------------------------------------------------------------


def _gauss(u: Column) -> Column:
    return F.exp(F.lit(-0.5) * u * u) / F.lit(math.sqrt(2 * math.pi))


def member_density_1d(fixes: DataFrame, levels: DataFrame, n_levels: int | None = None, release: str = "release",
                      time: str = "time", z: str = "z") -> DataFrame:
    """(release, time, level, z, density): Gaussian kernel density of depth with reflecting ends.

    ``levels``: (time, level, z, lo, hi). Count, bandwidth and levels of a member's date are one
    small row; fixes meet it in one join and each adds to one running sum per level, so nothing is
    paired and a hot member is summed before the shuffle. Bandwidth: Silverman, σ·(4/3n)^(1/5);
    a member of one depth has no density there (null)."""
    if n_levels is None:
        n_levels = one_row(levels.agg(F.max("level").alias("m")))["m"] + 1
    ks = range(n_levels)
    known = F.when(F.col("level") < n_levels, F.col("z")).otherwise(F.raise_error(F.lit("a level lies outside the given number of levels")).cast("double"))
    wide = levels.withColumn("_known", known).groupBy(time).agg(*[F.max(F.when(F.col("level") == k, F.col("_known"))).alias(f"e{k}") for k in ks],
                                                                F.max("_known").alias("_any"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    stats = fixes.groupBy(release, time).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(z).alias("s"))
    h = F.col("s") * F.pow(F.lit(4.0) / (F.col("n") * 3), F.lit(0.2))
    stats = stats.select(release, time, "n", F.when(h > 0, h).alias("h")).join(wide.where("_any is not null"), time)
    rows = skew_safe_join(shuffled(fixes.select(release, time, F.col(z).alias("_z"))), stats, [release, time])
    zc, hc = F.col("_z"), F.col("h")
    sums = []
    for k in ks:
        e = F.col(f"e{k}")
        images = _gauss((e - zc) / hc) + _gauss((e - (F.col("lo") * 2 - zc)) / hc) + _gauss((e - (F.col("hi") * 2 - zc)) / hc)
        sums.append(F.sum(F.when(e.between(F.col("lo"), F.col("hi")), images).otherwise(F.lit(0.0))).alias(f"d{k}"))
    summed = rows.groupBy(release, time, "n", "h").agg(*sums)
    cells = F.array(*[F.struct(F.lit(k).alias("level"), (F.col(f"d{k}") / (F.col("n") * hc)).alias("density")) for k in ks])
    out = summed.select(release, time, F.explode(cells).alias("c")).select(release, time, "c.level", "c.density")
    return out.join(levels.select(time, "level", "z"), [time, "level"]).select(release, time, "level", "z", "density")


def density_1d(fixes: DataFrame, levels: DataFrame, n_levels: int | None = None, rounding_s: int | None = None,
               release: str = "release", time: str = "time", z: str = "z") -> DataFrame:
    """(time, level, z, density): mean over the members."""
    if rounding_s:
        fixes = fixes.withColumn(time, round_time(time, rounding_s))
    members = member_density_1d(fixes, levels, n_levels, release, time, z)
    return members.groupBy(time, "level", "z").agg(F.avg("density").alias("density"))


def _kernel_2d(rows: DataFrame, evals: DataFrame, by: Sequence[str], key: Sequence[str], x: str, y: str) -> DataFrame:
    """Gaussian kernel density of ``rows`` per group ``by`` at ``evals`` (key…, slot, ex, ey).

    Bandwidth: sample covariance × n^(−1/3). Evaluation points sit in blocks of columns; a
    fix meets each block once and adds to its running sums, which combine before the shuffle."""
    n_slots = one_row(evals.agg(F.max("slot").alias("m")))["m"]
    blocks = 0 if n_slots is None else n_slots // BLOCK
    at = lambda k, c: F.max(F.when(F.pmod("slot", F.lit(BLOCK)) == k, F.col(c)))
    wide = evals.withColumn("_block", F.floor(F.col("slot") / BLOCK).cast("int")).groupBy(*key, "_block").agg(
        *[at(k, "ex").alias(f"ex{k}") for k in range(BLOCK)], *[at(k, "ey").alias(f"ey{k}") for k in range(BLOCK)])
    fixes = rows.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    stats = fixes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.var_samp("_x").alias("xx"), F.var_samp("_y").alias("yy"),
                                   F.covar_samp("_x", "_y").alias("xy"))
    shrink = F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3))
    stats = stats.withColumns({c: F.col(c) * shrink for c in ("xx", "yy", "xy")})
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    # fixes on a line have no plane density; rounding must not decide whether they are
    stats = stats.withColumn("det", F.when(det > F.lit(1e-9) * F.col("xx") * F.col("yy"), det)).where("det is not null")
    fixes = skew_safe_join(shuffled(fixes), stats, by).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks))))
    fixes = skew_safe_join(fixes, wide, [*key, "_block"])
    sums = []
    for k in range(BLOCK):
        dx, dy = F.col(f"ex{k}") - F.col("_x"), F.col(f"ey{k}") - F.col("_y")
        q = (F.col("yy") * dx * dx - F.lit(2.0) * F.col("xy") * dx * dy + F.col("xx") * dy * dy) / F.col("det")
        sums.append(F.sum(F.exp(F.lit(-0.5) * q)).alias(f"d{k}"))
    summed = fixes.groupBy(*by, "_block", "n", "det").agg(*sums)
    norm = F.col("n") * F.lit(2 * math.pi) * F.sqrt("det")
    cells = F.array(*[F.struct((F.col("_block") * BLOCK + k).alias("slot"), (F.col(f"d{k}") / norm).alias("density")) for k in range(BLOCK)])
    out = summed.select(*by, F.explode(cells).alias("c")).select(*by, "c.slot", "c.density").where("density is not null")
    return out


def density_2d(fixes: DataFrame, points: DataFrame, deltas_s: Sequence[float], group: int | None = None,
               rounding_s: int | None = None, release: str = "release", time: str = "time", x: str = "x", y: str = "y") -> DataFrame:
    """(delta_s, slot, density, members) at points (slot 0.., ex, ey): mean over the members, and how many
    they are. A member with one fix, or with all on a line at the elapsed time, has no density in the
    plane and is not among them."""
    if rounding_s:
        fixes = fixes.withColumn(time, round_time(time, rounding_s))
    rows = positions_at(fixes, list(deltas_s), release, time)
    if group is not None:
        rows = select_group(rows, [group])
    members = _kernel_2d(rows, points, [release, "delta_s"], [], x, y)
    return members.groupBy("delta_s", "slot").agg(F.avg("density").alias("density"), F.count(F.lit(1)).alias("members"))


def density_hovmoller(fixes: DataFrame, levels: DataFrame, start, end, mass: float = 1.0, rounding_s: int | None = None,
                      release: str = "release", time: str = "time", strict: bool = True) -> DataFrame:
    """(time, level, z, concentration) on the levels and dates of a profile between two dates.

    The dates of fixes and levels must be equal in that span."""
    if rounding_s:
        fixes = fixes.withColumn(time, round_time(time, rounding_s))
    span = F.col(time).between(ts_literal(start), ts_literal(end))
    f, p = fixes.where(span), levels.where(span)
    if strict:
        a, b = f.select(time).distinct(), p.select(time).distinct()
        if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
            raise ValueError("the dates of the trajectories and of the profile differ")
    out = density_1d(f, p, release=release, time=time)
    return out.select(time, "level", "z", (F.col("density") * F.lit(float(mass))).alias("concentration"))


def histogram_depth(fixes: DataFrame, edges: Sequence[float], time: str = "time", z: str = "z") -> DataFrame:
    """(time, bin, n) for every bin, empty ones too; the last bin is closed on the right."""
    edges = [float(e) for e in edges]
    last = len(edges) - 2
    zc = F.col(z)
    counts = [F.count_if((zc >= lo) & ((zc <= hi) if k == last else (zc < hi))).alias(f"b{k}")
              for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    wide = fixes.groupBy(time).agg(*counts)
    cells = F.array(*[F.struct(F.lit(k).alias("bin"), F.col(f"b{k}").alias("n")) for k in range(last + 1)])
    return wide.select(time, F.explode(cells).alias("c")).select(time, "c.bin", "c.n")


def mixing_check(density: DataFrame, n_particles: int, n_levels: int) -> DataFrame:
    """(level, mean, std, expected): concentration per level over members and times against the even value."""
    return density.groupBy("level").agg(
        F.avg("density").alias("mean"), F.stddev_pop("density").alias("std"), F.lit(n_particles / (n_levels - 1)).alias("expected"))


def survival_curve(fixes: DataFrame, rate_per_s: float | None = None, time: str = "time") -> DataFrame:
    """(time, n_alive, n) and, with a rate, the expected number n₀·exp(−rate·t) of the n₀ alive at the first time."""
    out = fixes.groupBy(time).agg(F.sum("is_alive").cast("long").alias("n_alive"), F.count(F.lit(1)).alias("n"))
    if rate_per_s is None:
        return out
    first = one_row(out.agg(F.min(time).alias("t0"), F.min_by("n_alive", time).alias("n0")))
    elapsed = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(ts_literal(first["t0"]).cast("timestamp"))) / F.lit(1e6)
    return out.withColumn("expected", F.lit(first["n0"]) * F.exp(F.lit(-rate_per_s) * elapsed))


def status_summary(fixes: DataFrame, time: str = "time", group: str = "group_id") -> DataFrame:
    """Counts per time and group with totals over either (null), from one cube."""
    return fixes.cube(time, group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("in_domain") == 1).alias("n_in_domain"),
        F.count_if(F.col("is_beached") == 1).alias("n_beached"),
        F.count_if(F.col("error_status") == 1).alias("n_error"),
        F.sum("land_boundary_encounters").cast("long").alias("land_encounters"),
    )


def depth_integral(field: DataFrame, interfaces: DataFrame, surface: DataFrame, nodes: DataFrame) -> DataFrame:
    """(time, node_id, value): Σ |Δσ|·(ζ + h)·value over the layers.

    ``field`` (time, node_id, level, value), ``interfaces`` (level, sigma), ``surface`` (time,
    node_id, zeta), ``nodes`` (node_id, h). One aggregate over the layers, then one join."""
    below = interfaces.select((F.col("level") - 1).cast("int").alias("level"), F.col("sigma").alias("_s"))
    thick = interfaces.join(below, "level").select("level", F.abs(F.col("_s") - F.col("sigma")).alias("_ds"))
    # one row per level; without the hint the field itself may be judged the smaller side
    sums = field.join(F.broadcast(thick), "level").groupBy("time", "node_id").agg(F.sum(F.col("_ds") * F.col("value")).alias("_v"))
    out = sums.join(shuffled(surface), ["time", "node_id"]).join(shuffled(nodes.select("node_id", "h")), "node_id")
    return out.select("time", "node_id", (F.col("_v") * (F.col("zeta") + F.col("h"))).alias("value"))


def rmse_profile(fixes: DataFrame, profile: DataFrame, mass: float = 1.0, n_levels: int | None = None,
                 rounding_s: int | None = None, release: str = "release", time: str = "time") -> DataFrame:
    """One row: √ of the mean squared difference over members, dates and levels.

    ``profile``: (time, level, z, lo, hi, value)."""
    if rounding_s:
        fixes = fixes.withColumn(time, round_time(time, rounding_s))
    members = member_density_1d(fixes, profile, n_levels, release, time)
    joined = members.join(profile.select(time, "level", "value"), [time, "level"])
    d = F.col("density") * F.lit(float(mass)) - F.col("value")
    return joined.agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def rmse_field(fixes: DataFrame, field: DataFrame, n_points: int, mass: float = 1.0, release: str = "release",
               time: str = "time", x: str = "x", y: str = "y") -> DataFrame:
    """One row: the same in the plane on the n nodes of highest value per date, and the number of
    (member, date, node) terms it rests on (members on a line have none, see ``density_2d``).

    ``field``: (time, node_id, x, y, value); the lower node id wins a tie."""
    w = Window.partitionBy(time).orderBy(F.desc("value"), "node_id")
    # filtered on the rank itself, so that each task keeps n rows per date; used three times: written once
    top = field.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n_points)
    top = cut_lineage(top.withColumn("slot", F.col("_rank") - 1).drop("_rank"))
    evals = top.select(time, "slot", F.col("x").alias("ex"), F.col("y").alias("ey"))
    members = _kernel_2d(fixes, evals, [release, time], [time], x, y)
    joined = members.join(top.select(time, "slot", "value"), [time, "slot"])
    d = F.col("density") * F.lit(float(mass)) - F.col("value")
    return joined.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def plan_extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def cartesian_offset(df: DataFrame, nodes: DataFrame, x: str = "x", y: str = "y", undo: bool = False) -> DataFrame:
    """Subtract the least x and y of the mesh, or add them back."""
    low = one_row(nodes.agg(F.min("x").alias("x"), F.min("y").alias("y")))
    sign = 1.0 if undo else -1.0
    return df.withColumns({x: F.col(x) + F.lit(sign * low["x"]), y: F.col(y) + F.lit(sign * low["y"])})
