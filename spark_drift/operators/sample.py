"""Field sampling at points: in the plane, in time and down the water column.

Points carry their host (``locate_points``) and, for time-dependent fields, their frames
(``asof_frames``). ``gather`` brings every wanted variable and level to each point in one
join; the vertical rules are then plain expressions over its columns ``<variable>_<level>``."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_drift.functions import geo
from spark_drift.functions.geo import nonzero
from spark_drift.functions.timecols import lerp
from spark_drift.operators.archive import is_archive, pruned
from spark_drift.operators.mesh import centre_columns, corner_vectors, element_corners, element_masks
from spark_drift.operators.time import nearest_time
from spark_drift.schema import BOUNDARY, EARTH_RADIUS, LAND, NOT_FOUND, PHI_EPS, SEA, Mesh
from spark_drift.util import cut_lineage, shuffled, skew_safe_join

PHI = ("phi0", "phi1", "phi2")


def level_columns(variable: str, n: int, suffix: str = "") -> list[Column]:
    return [F.col(f"{variable}_{k}{suffix}") for k in range(n)]


def pick(columns: Sequence[Column], k: Column) -> Column:
    """The k-th of a list of columns, null outside it."""
    return F.get(F.array(*columns), k)


# --- horizontal -------------------------------------------------------------------


def _known_levels(fields: DataFrame, variables: dict[str, int]) -> DataFrame:
    """Rows of the wanted variables; a level beyond a variable's number of levels is an error."""
    wanted = fields.where(F.col("variable").isin(list(variables)))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in variables.items() for x in pair]), F.col("variable"))
    checked = F.when(F.col("level") < limit, F.col("value")).otherwise(F.raise_error(F.format_string("%s has a level %d outside the given ones", "variable", "level")).cast("double"))
    return wanted.withColumn("value", checked)


def widen(fields: DataFrame, variables: dict[str, int], key: Sequence[str] = ("node_id", "time")) -> DataFrame:
    """Long rows to one row per (node, time) with a column per variable and level."""
    cells = []
    for v, n in variables.items():
        for k in range(n):
            at = (F.col("variable") == v) & (F.col("level") == k)
            cells.append(F.max(F.when(at, F.col("value"))).alias(f"{v}_{k}"))
    return _known_levels(fields, variables).groupBy(*key).agg(*cells)


def _in_use(fields: DataFrame, feeds: DataFrame, at: Sequence[str]) -> DataFrame:
    """The field rows that the feeds look at, before anything is grouped.

    An archive (``archive.write_archive``, or a table with a ``date``) is cut to the days and blocks of nodes in
    use and to their frames. Other tables, and constant fields, are taken whole: choosing rows of a
    table without folders costs one more shuffle and saves no reading."""
    if "time" not in at or not is_archive(fields):
        return fields
    return pruned(fields, feeds).join(shuffled(feeds.select(*at).distinct()), list(at), "left_semi")


def gather(points: DataFrame, fields: DataFrame, variables: dict[str, int], in_time: bool = True,
           weights: dict[str, Sequence[str]] | None = None, masks: bool = False, nodes: DataFrame | None = None,
           keep: Sequence[str] | None = None, every: bool = False) -> DataFrame:
    """Weighted node values of every variable and level at every point.

    ``weights`` maps a column suffix to the three weight columns; the default is φ without
    suffix. Masked values count as 0 in the sum; with ``masks``, ``<v>_<k>_masked`` is 1
    where a host node is masked in either frame. ``nodes`` (node_id, h) adds the depth ``_h``
    in the same pass. ``keep`` names the point columns to carry on (all by default).

    The values of a host's nodes in its two frames are brought together once per (host,
    frames) in use, and each point meets them in one join: no point row is repeated or
    aggregated, so equal rows stay separate rows. Points without a host drop out, unless ``every``."""
    weights = weights or {"": PHI}
    if in_time and is_archive(fields):
        points = cut_lineage(points)  # the folders in use, the hosts and the values are looked up from them
    keep = list(points.columns if keep is None else keep)
    key = ["n0", "n1", "n2", *(["t_last", "t_next"] if in_time else [])]
    frames = ["t_last", "t_next"] if in_time else [None]
    slots = [(f"n{slot}", frame) for frame in frames for slot in range(3)]
    feeds = [F.struct(F.lit(i).alias("_i"), F.col(n).alias("node_id"), *([F.col(t).alias("time")] if t else [])) for i, (n, t) in enumerate(slots)]
    hosts = points.select(*key).distinct().select(*key, F.explode(F.array(*feeds)).alias("_f")).select(*key, "_f.*")
    at = ["node_id", "time"] if in_time else ["node_id"]
    wide = widen(_in_use(fields, hosts, at), variables, at)
    cells = [f"{v}_{k}" for v, n in variables.items() for k in range(n)]
    if nodes is not None:
        wide = wide.join(shuffled(nodes.select("node_id", F.col("h").alias("_node_h"))), "node_id")
    values = [F.max(F.when(F.col("_i") == i, F.col(c))).alias(f"_{c}_at{i}") for c in cells for i in range(len(slots))]
    if nodes is not None:
        values += [F.max(F.when(F.col("_i") == i, F.col("_node_h"))).alias(f"_h_at{i}") for i in range(3)]
    around = hosts.join(shuffled(wide), at).groupBy(*key).agg(*values)
    joined = skew_safe_join(shuffled(points), around, key, "left" if every else "inner")
    shares = [F.lit(1.0) - F.col("t_frac"), F.col("t_frac")] if in_time else [F.lit(1.0)]

    def total(c: str, columns: Sequence[str]) -> Column:
        parts = [F.coalesce(F.col(f"_{c}_at{3 * f + slot}"), F.lit(0.0)) * (F.col(columns[slot]) * share)
                 for f, share in enumerate(shares) for slot in range(3)]
        return functools.reduce(Column.__add__, parts)

    out = [total(c, columns).alias(f"{c}{suffix}") for c in cells for suffix, columns in weights.items()]
    if masks:
        out += [F.greatest(*[F.col(f"_{c}_at{i}").isNull().cast("int") for i in range(len(slots))]).alias(f"{c}_masked") for c in cells]
    if nodes is not None:
        out.append((F.col("_h_at0") * F.col(PHI[0]) + F.col("_h_at1") * F.col(PHI[1]) + F.col("_h_at2") * F.col(PHI[2])).alias("_h"))
    return joined.select(*keep, *out)


def gather_levels(points: DataFrame, fields: DataFrame, variables: dict[str, int], weights: dict[str, Sequence[str]] | None = None,
                  keep: Sequence[str] | None = None) -> DataFrame:
    """Weighted node values on the two levels ``k_a`` and ``k_b`` of every point: ``<v>_a``, ``<v>_b`` (with
    the suffixes of ``weights``), and masked_a, masked_b: 1 where a host node of any of the variables is
    masked there in either frame.

    Only these two levels travel, whatever the number of levels of the source. Every point stays."""
    weights = weights or {"": PHI}
    keep = list(points.columns if keep is None else keep)
    key = ["n0", "n1", "n2", "t_last", "t_next", "k_a", "k_b"]
    slots = [(f"n{slot}", frame, level) for level in ("k_a", "k_b") for frame in ("t_last", "t_next") for slot in range(3)]
    feeds = [F.struct(F.lit(i).alias("_i"), F.col(n).alias("node_id"), F.col(t).alias("time"), F.col(k).alias("level")) for i, (n, t, k) in enumerate(slots)]
    hosts = points.select(*key).where("k_a is not null").distinct().select(*key, F.explode(F.array(*feeds)).alias("_f")).select(*key, "_f.*")
    at = ["node_id", "time", "level"]
    wide = _known_levels(_in_use(fields, hosts, at), variables).groupBy(*at).agg(*[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables])
    around = hosts.join(shuffled(wide), at).groupBy(*key).agg(*[F.max(F.when(F.col("_i") == i, F.col(v))).alias(f"_{v}_at{i}") for v in variables for i in range(len(slots))])
    joined = skew_safe_join(shuffled(points), around, key, "left")
    shares = [F.lit(1.0) - F.col("t_frac"), F.col("t_frac")]
    out = []
    for j, side in enumerate("ab"):
        for v in variables:
            for suffix, columns in weights.items():
                parts = [F.coalesce(F.col(f"_{v}_at{6 * j + 3 * f + slot}"), F.lit(0.0)) * (F.col(columns[slot]) * share)
                         for f, share in enumerate(shares) for slot in range(3)]
                out.append(functools.reduce(Column.__add__, parts).alias(f"{v}_{side}{suffix}"))
        gaps = [F.col(f"_{v}_at{6 * j + i}").isNull() for v in variables for i in range(6)]
        out.append(functools.reduce(Column.__or__, gaps).cast("int").alias(f"masked_{side}"))
    return joined.select(*keep, *out)


def on_levels_of(points: DataFrame, fields: DataFrame, mesh_nodes: DataFrame, level_depths: Sequence[float], variables: Sequence[str],
                 weights: dict[str, Sequence[str]] | None = None, surface: Sequence[str] = (), z: Column | None = None, every: bool = False) -> DataFrame:
    """Points on fixed depth levels: zmin, zmax, z (replaced by ``z`` if given, which may use ζ as zmax),
    ``surface`` variables, the vertical position, and the two levels' values of ``variables``.

    The free surface and the depth come first, then only the two levels around each point. A point
    over a masked lower level takes the level above alone; one in a boundary layer whose level is
    masked has no place. Points without a host or fields drop out, with ``every`` they stay."""
    n = len(level_depths)
    flat = {"zeta": 1} | {s: 1 for s in surface if s != "zeta"}
    got = gather(points, fields, flat, nodes=mesh_nodes, every=every)
    got = got.withColumn("zmin", -F.col("_h")).withColumnRenamed("zeta_0", "zmax").drop("_h")
    got = got.withColumnsRenamed({f"{s}_0": s for s in flat if s != "zeta"})
    if z is not None:
        got = got.withColumn("z", z)
    # written once: the next step looks at these rows twice, and depth rules repeat ζ many times
    got = cut_lineage(got)
    placed = locate_level(got, "node_levels", levels=[F.col("zmax") - F.lit(float(d)) for d in level_depths])
    if not variables:
        return placed
    edge = F.col("in_surface") | F.col("in_bottom")
    placed = placed.withColumn("k_a", F.col("k")).withColumn("k_b", F.when(edge, F.col("k")).otherwise(F.col("k") + 1))
    out = gather_levels(placed, fields, {v: n for v in variables}, weights)
    lost = edge & (F.col("masked_a") == 1)
    over = ~edge & (F.col("masked_a") == 0) & (F.col("masked_b") == 1)
    out = out.withColumns({"_lost": F.coalesce(lost, F.lit(False)), "_over": F.coalesce(over, F.lit(False))})
    out = out.withColumns({
        "k": F.when(~F.col("_lost"), F.col("k")),
        "in_surface": F.col("in_surface") & ~F.col("_lost"),
        "in_bottom": (F.col("in_bottom") & ~F.col("_lost")) | F.col("_over"),
        "level_flag": F.when(F.col("_lost"), NOT_FOUND).otherwise(F.col("level_flag")).cast("int"),
    })
    return out.drop("_lost", "_over", "masked_a", "masked_b", "k_a", "k_b")


def between_levels(a: Column, b: Column) -> Column:
    """Value in the host layer from the values on its two levels; null without a place."""
    inner = lerp(F.col("omega"), b, a)
    return F.when(F.col("level_flag") == 0, F.when(F.col("in_surface") | F.col("in_bottom"), a).otherwise(inner))


def interp_2d(points: DataFrame, field: DataFrame, value: str = "value", out: str = "value") -> DataFrame:
    """Σ φ·value over the host nodes of a constant field (node_id, value)."""
    long = field.select("node_id", F.lit(out).alias("variable"), F.lit(0).alias("level"), F.col(value).alias("value"))
    return gather(points, long, {out: 1}, in_time=False).withColumnRenamed(f"{out}_0", out)


def interp_2d_time(points: DataFrame, fields: DataFrame, variable: str) -> DataFrame:
    return gather(points, fields, {variable: 1}).withColumnRenamed(f"{variable}_0", variable)


def interp_level_time(points: DataFrame, fields: DataFrame, variable: str, k: int) -> DataFrame:
    level = fields.where((F.col("variable") == variable) & (F.col("level") == k)).withColumn("level", F.lit(0))
    return interp_2d_time(points, level, variable)


def adjust_boundary_phi(points: DataFrame, mesh: Mesh) -> DataFrame:
    """In BOUNDARY elements the sea node of largest φ gets weight 1 (nearest neighbour).

    With every sea φ at 0 the first sea node is taken. LAND hosts are an error."""
    masks = element_masks(mesh).select("element_id", *[F.col(f"m{k}").alias(f"_m{k}") for k in range(3)])
    joined = points.join(shuffled(masks), F.col("host") == F.col("element_id"), "left").drop("element_id")
    sea_phi = [F.when(F.col(f"_m{k}") == SEA, F.col(f"phi{k}")).otherwise(F.lit(-1.0)) for k in range(3)]
    best = F.greatest(*sea_phi)
    bad = F.raise_error(F.lit("host element is land, or has no sea node")).cast("int")
    slot = F.when((F.col("mask_c") == LAND) | (best < 0), bad)
    for k in range(3):
        slot = slot.when(sea_phi[k] == best, F.lit(k))
    edge = F.col("mask_c") == BOUNDARY
    joined = joined.withColumn("_slot", F.when(edge, slot))
    new = {f"phi{k}": F.when(edge, (F.col("_slot") == k).cast("double")).otherwise(F.col(f"phi{k}")) for k in range(3)}
    return joined.withColumns(new).select(*points.columns)


def basis_gradients(mesh: Mesh) -> DataFrame:
    """(element_id, gx0..2, gy0..2, area): gradients of φ, in the plane tangent at the centre on the sphere."""
    corners = element_corners(mesh)
    if mesh.geographic:
        xc, yc = centre_columns(True)
        corners = corners.withColumns({"_xc": F.radians(xc), "_yc": F.radians(yc)})
        a, b, c = corner_vectors(True)
        corners, v = geo.stage(corners, v0=a, v1=b, v2=c)
        corners, p = geo.stage(corners, **{f"p{k}": geo.rotate_axes(v[k], "_xc", "_yc") for k in range(3)})
        p = [(q[0] * EARTH_RADIUS, q[1] * EARTH_RADIUS) for q in p]
        area = geo.spherical_triangle_area(*v)
    else:
        p = [(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(3)]
        area = geo.triangle_area(*p)
    corners = corners.withColumn("_twice", geo.twice_signed_area(*p))
    twice = F.col("_twice")
    columns = []
    for k in range(3):
        a, b = p[(k + 1) % 3], p[(k + 2) % 3]
        columns += [((a[1] - b[1]) / twice).alias(f"gx{k}"), ((b[0] - a[0]) / twice).alias(f"gy{k}")]
    return corners.select("element_id", *columns, area.alias("area"))


def with_gradients(points: DataFrame, mesh: Mesh) -> DataFrame:
    return points.join(shuffled(basis_gradients(mesh)), F.col("host") == F.col("element_id")).drop("element_id")


GRADIENT_WEIGHTS = {"": PHI, "_dx": ("gx0", "gx1", "gx2"), "_dy": ("gy0", "gy1", "gy2")}


def grad_2d_time(points: DataFrame, fields: DataFrame, mesh: Mesh, variable: str, k: int = 0) -> DataFrame:
    """Adds d<variable>_dx and d<variable>_dy of level k."""
    level = fields.where((F.col("variable") == variable) & (F.col("level") == k)).withColumn("level", F.lit(0))
    weights = {s: w for s, w in GRADIENT_WEIGHTS.items() if s}
    out = gather(with_gradients(points, mesh), level, {variable: 1}, weights=weights)
    new = {f"d{variable}_d{a}": F.col(f"{variable}_0_d{a}") for a in "xy"}
    return out.withColumns(new).select(*points.columns, *new)


def idw_neighbours(points: DataFrame, elem_values: DataFrame, mesh: Mesh, values: Sequence[str] = ("value",),
                   in_time: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """Shepard 1/r² weights over the host element and its neighbours; r = 0 gives that value.

    ``elem_values``: (element_id, values…), with a time column when ``in_time``: then both
    frames of a point are weighted by their share of the time."""
    xc, yc = centre_columns(mesh.geographic)
    centres = element_corners(mesh).select(F.col("element_id").alias("_near"), xc.alias("_xc"), yc.alias("_yc"))
    around = mesh.elements.select(F.col("element_id").alias("host"), F.posexplode(
        F.concat(F.array("element_id"), F.filter("nbe", lambda e: e >= 0))).alias("_i", "_near"))
    frames = ["t_last", "t_next"] if in_time else [None]
    key = ["host", *(f for f in frames if f)]
    spots = around.join(shuffled(points.select(*key).distinct()), "host").join(shuffled(centres), "_near")
    if in_time:
        spots = spots.select("*", F.posexplode(F.array(*frames)).alias("_f", "_time"))
    else:
        spots = spots.withColumn("_f", F.lit(0))
    vals = elem_values.withColumnRenamed("element_id", "_near").withColumnsRenamed({v: f"_v_{v}" for v in values})
    if in_time:
        vals = vals.withColumnRenamed("time", "_time")
    spots = spots.join(shuffled(vals), ["_near", "_time"] if in_time else ["_near"])
    # at most four spots per host: itself and its neighbours
    cells = []
    for i in range(4):
        here = F.col("_i") == i
        cells += [F.max(F.when(here, F.col(c))).alias(f"{c}{i}") for c in ("_xc", "_yc")]
        cells += [F.max(F.when(here & (F.col("_f") == f), F.col(f"_v_{v}"))).alias(f"_v_{v}_{i}_{f}") for v in values for f in range(len(frames))]
        cells += [F.max((here & (F.col("_f") == f)).cast("int")).alias(f"_has_{i}_{f}") for f in range(len(frames))]
    rows = skew_safe_join(shuffled(points), spots.groupBy(*key).agg(*cells), key)
    for i in range(4):
        if mesh.geographic:
            r = geo.haversine(F.radians(x), F.radians(y), F.radians(f"_xc{i}"), F.radians(f"_yc{i}"))
        else:
            r = geo.euclid(x, y, f"_xc{i}", f"_yc{i}")
        rows = rows.withColumn(f"_r{i}", r)
    shares = [F.lit(1.0) - F.col("t_frac"), F.col("t_frac")] if in_time else [F.lit(1.0)]
    spot = [(i, f) for i in range(4) for f in range(len(frames))]
    weigh = lambda i, f: shares[f] / nonzero(F.col(f"_r{i}") * F.col(f"_r{i}"))
    add = lambda parts: functools.reduce(Column.__add__, [F.coalesce(p, F.lit(0.0)) for p in parts])
    # a point on a centre takes that spot's value
    on = F.coalesce(F.least(*[F.when(F.col(f"_r{i}") == 0, F.lit(i)) for i in range(4)]), F.lit(-1))
    rows = rows.withColumn("_on", on)
    out = []
    for v in values:
        value = lambda i, f: F.col(f"_v_{v}_{i}_{f}")
        mean = add([weigh(i, f) * value(i, f) for i, f in spot]) / nonzero(add([F.when(F.col(f"_has_{i}_{f}") == 1, weigh(i, f)) for i, f in spot]))
        best = F.lit(None).cast("double")
        for i in range(4):
            best = F.when(F.col("_on") == i, functools.reduce(Column.__add__, [shares[f] * value(i, f) for f in range(len(frames))])).otherwise(best)
        out.append(F.coalesce(best, mean).alias(v))
    return rows.select(*points.columns, *out)


# --- vertical -----------------------------------------------------------------------


def fraction(z: Column, lower: Column, upper: Column) -> Column:
    return (z - lower) / nonzero(upper - lower)


def _first_layer(z: Column, interfaces: Sequence[Column]) -> Column:
    """First k with interfaces[k+1] ≤ z ≤ interfaces[k]; interfaces run downwards."""
    return F.coalesce(*[F.when((z <= a) & (z >= b), F.lit(k)) for k, (a, b) in enumerate(zip(interfaces, interfaces[1:]))],
                      F.lit(None).cast("int"))


def zmin_zmax(points: DataFrame, nodes: DataFrame, fields: DataFrame) -> DataFrame:
    """Adds zmin = −h and zmax = ζ at (t, x, y)."""
    got = gather(points, fields, {"zeta": 1}, nodes=nodes)
    return got.withColumns({"zmin": -F.col("_h"), "zmax": F.col("zeta_0")}).drop("_h", "zeta_0")


def locate_level(df: DataFrame, layout: str, z: str = "z", levels: Sequence[Column] = (), layers: Sequence[Column] = (),
                 masked: Sequence[Column] = (), zmin: str = "zmin", zmax: str = "zmax") -> DataFrame:
    """Vertical host layer: k, omega, in_surface, in_bottom, level_flag [, k_upper, k_lower, omega_layers].

    layout ``node_levels``: values on depth levels; above the top level or over a masked lower
    level a point is in a boundary layer. ``layers``: values on layer centres between
    interfaces. ``surface``: data without depth. Levels run from the surface down."""
    zc = F.col(z)
    n = len(levels)
    if layout == "surface":
        return df.withColumns({"k": F.lit(0), "omega": F.lit(None).cast("double"), "in_surface": F.lit(True),
                               "in_bottom": F.lit(False), "level_flag": F.lit(0)})
    lo, hi = (levels[-1], levels[0]) if layout == "layers" else (F.col(zmin), F.col(zmax))
    slack = F.lit(PHI_EPS) * F.abs(hi - lo)
    # a point on the floor or the surface up to rounding lies on it
    zc = F.when((zc < lo) & (zc >= lo - slack), lo).when((zc > hi) & (zc <= hi + slack), hi).otherwise(zc)
    k = _first_layer(zc, levels)
    omega = fraction(zc, pick(levels, F.col("k") + 1), pick(levels, F.col("k")))
    if layout == "node_levels":
        no_mask = [F.lit(0)] * n
        m = list(masked) or no_mask
        above = (zc <= F.col(zmax)) & (zc >= levels[0]) & (m[0] == 0)
        below = (zc >= F.col(zmin)) & (zc <= levels[-1]) & (m[-1] == 0)
        found = k.isNotNull()
        over_mask = (pick(m, F.col("_k0")) == 0) & (pick(m, F.col("_k0") + 1) == 1)
        out = df.withColumn("_k0", k)
        found = F.col("_k0").isNotNull()
        out = out.withColumns({
            "k": F.when(found, F.col("_k0")).when(above, F.lit(0)).when(below, F.lit(n - 1)),
            "in_surface": ~found & F.coalesce(above, F.lit(False)),
            "in_bottom": F.when(found, over_mask).otherwise(F.coalesce(~above & below, F.lit(False))),
        })
        out = out.withColumn("omega", F.when(F.col("_k0").isNotNull(), omega)).drop("_k0")
        return out.withColumn("level_flag", F.when(F.col("k").isNull(), NOT_FOUND).otherwise(0).cast("int"))
    if layout != "layers":
        raise ValueError(f"unknown layout {layout!r}")
    n_layers = len(layers)
    out = df.withColumn("k", k).withColumn("omega", omega)
    kc = F.col("k")
    centre = pick(layers, kc)
    upper_half = zc >= centre
    out = out.withColumns({
        "in_surface": F.coalesce((kc == 0) & upper_half, F.lit(False)),
        "in_bottom": F.coalesce((kc == n_layers - 1) & (zc <= centre) & ~((kc == 0) & upper_half), F.lit(False)),
    })
    inner = kc.isNotNull() & ~F.col("in_surface") & ~F.col("in_bottom")
    out = out.withColumns({
        "k_upper": F.when(inner, F.when(upper_half, kc - 1).otherwise(kc)),
        "k_lower": F.when(inner, F.when(upper_half, kc).otherwise(kc + 1)),
    })
    out = out.withColumn("omega_layers", fraction(zc, pick(layers, F.col("k_lower")), pick(layers, F.col("k_upper"))))
    return out.withColumn("level_flag", F.when(kc.isNull(), NOT_FOUND).otherwise(0).cast("int"))


def at_depth(values: Sequence[Column], layout: str) -> Column:
    """Value in the host layer: level k in a boundary layer, else linear between two levels."""
    if layout == "surface":
        return values[0]
    edge = F.col("in_surface") | F.col("in_bottom")
    if layout == "node_levels":
        inner = lerp(F.col("omega"), pick(values, F.col("k") + 1), pick(values, F.col("k")))
    else:
        inner = lerp(F.col("omega_layers"), pick(values, F.col("k_lower")), pick(values, F.col("k_upper")))
    return F.when(edge, pick(values, F.col("k"))).otherwise(inner)


def on_interfaces(values: Sequence[Column]) -> Column:
    """Linear between the interfaces around the host layer."""
    return lerp(F.col("omega"), pick(values, F.col("k") + 1), pick(values, F.col("k")))


def interface_gradient(values: Sequence[Column], z: Sequence[Column]) -> Column:
    """dvalue/dz: centred differences on inner interfaces, one-sided at the ends, linear between."""
    last = len(values) - 1
    slope = lambda a, b: (values[a] - values[b]) / nonzero(z[a] - z[b])
    g = [slope(max(i - 1, 0), min(i + 1, last)) for i in range(last + 1)]
    return on_interfaces(g)


def sample_variable(points: DataFrame, fields: DataFrame, variables: Sequence[str], level_depths: Sequence[float],
                    nodes: DataFrame, layout: str = "node_levels") -> DataFrame:
    """Values of 3-D variables at (t, x, y, z) for sources on fixed depth levels.

    Adds zmin, zmax, the vertical position and one column per variable. Gaps of the variables
    mark masked levels (``on_levels_of``)."""
    if layout != "node_levels":
        raise ValueError(f"unknown layout {layout!r}")
    out = on_levels_of(points, fields, nodes, level_depths, variables)
    new = {v: between_levels(F.col(f"{v}_a"), F.col(f"{v}_b")) for v in variables}
    out = out.withColumns(new)
    return out.select(*points.columns, "zmin", "zmax", "k", "omega", "in_surface", "in_bottom", "level_flag", *variables)


def depth_fields(fields: DataFrame, nodes: DataFrame, levels: DataFrame | Sequence[tuple[float, float]], variable: str = "z_level",
                 hc: float | None = None, vtransform: int = 2) -> DataFrame:
    """Level depths as a field (variable, time, level, node_id, value), formed at each node from its ζ and h.

    ``levels``: σ of each node as a table (node_id, level, sigma), or the s-levels (s, C(s)) of the
    source as a list, with their critical depth ``hc``."""
    surface = fields.where((F.col("variable") == "zeta") & (F.col("level") == 0)).select("node_id", "time", F.col("value").alias("_zeta"))
    rows = surface.join(shuffled(nodes.select("node_id", F.col("h").alias("_h"))), "node_id")
    if isinstance(levels, DataFrame):
        rows = rows.join(shuffled(levels.select("node_id", "level", F.col("sigma").alias("_sigma"))), "node_id")
        value = geo.sigma_to_depth("_sigma", "_h", "_zeta")
    else:
        listed = F.array(*[F.struct(F.lit(float(a)).alias("s"), F.lit(float(b)).alias("cs")) for a, b in levels])
        rows = rows.select("*", F.posexplode(listed).alias("level", "_l"))
        value = geo.s_level_to_depth(F.col("_l.s"), F.col("_l.cs"), F.lit(float(hc)), "_h", "_zeta", vtransform)
    return rows.select(F.lit(variable).alias("variable"), "time", F.col("level").cast("int").alias("level"), "node_id", value.alias("value"))


def _layer_depths(n_levels: int, n_layers: int, sigma_levels: Sequence[float], sigma_layers: Sequence[float]) -> tuple[list[Column], list[Column]]:
    """Depths of interfaces and layer centres: gathered with the fields, or by σ uniform in the plane."""
    if sigma_levels:
        depth = lambda s: geo.sigma_to_depth(F.lit(float(s)), "_h", "zeta_0")
        return [depth(s) for s in sigma_levels], [depth(s) for s in sigma_layers]
    return level_columns("z_level", n_levels), level_columns("z_layer", n_layers)


def _on_layers(points: DataFrame, fields: DataFrame, nodes: DataFrame, wanted: dict[str, int], sigma_levels: Sequence[float], sigma_layers: Sequence[float],
               n_levels: int, n_layers: int, weights: dict[str, Sequence[str]] | None = None, z: Column | None = None,
               every: bool = False) -> tuple[DataFrame, list[Column], list[Column]]:
    """Points with the wanted columns and their place between layers, and the depths of both kinds of level.

    ``z`` replaces the points' z and may use ζ as zeta_0; with ``every`` points without a host stay."""
    if not sigma_levels:
        wanted = wanted | {"z_level": n_levels} | ({"z_layer": n_layers} if n_layers else {})
    # written once: the depth rules repeat these columns many times
    got = gather(points, fields, {"zeta": 1} | wanted, weights=weights, nodes=nodes, every=every)
    got = cut_lineage(got if z is None else got.withColumn("z", z))
    z_levels, z_layers = _layer_depths(n_levels, n_layers, sigma_levels, sigma_layers)
    return locate_level(got, "layers", levels=z_levels, layers=z_layers or z_levels[:-1]), z_levels, z_layers


def sample_layers(points: DataFrame, fields: DataFrame, nodes: DataFrame, sigma_levels: Sequence[float] = (),
                  sigma_layers: Sequence[float] = (), on_layers: Sequence[str] = (), on_levels: Sequence[str] = (),
                  gradients: Sequence[str] = (), n_levels: int = 0, n_layers: int = 0) -> DataFrame:
    """Values on layers or interfaces at (t, x, y, z) for terrain-following sources.

    With σ uniform in the plane the level depths follow from the interpolated ζ and h. Otherwise the
    fields hold them as z_level (``n_levels``) and z_layer (``n_layers``), see ``depth_fields``, and
    they are interpolated as other fields are. Without layers only values on interfaces are to be had."""
    n, m = len(sigma_layers) or n_layers, len(sigma_levels) or n_levels
    out, z_levels, _ = _on_layers(points, fields, nodes, {v: n for v in on_layers} | {v: m for v in on_levels}, sigma_levels, sigma_layers, m, n)
    new = {v: at_depth(level_columns(v, n), "layers") for v in on_layers}
    new |= {v: on_interfaces(level_columns(v, m)) for v in on_levels}
    new |= {f"d{v}_dz": interface_gradient(level_columns(v, m), z_levels) for v in gradients}
    out = out.withColumns(new | {"zmin": -F.col("_h"), "zmax": F.col("zeta_0")})
    return out.select(*points.columns, "zmin", "zmax", "k", "omega", "in_surface", "in_bottom", "k_upper", "k_lower",
                      "omega_layers", "level_flag", *new)


def values_on_layers(points: DataFrame, fields: DataFrame, nodes: DataFrame, variables: Sequence[str], surface: Sequence[str] = (), z: Column | None = None,
                     every: bool = False, sigma_levels: Sequence[float] = (), sigma_layers: Sequence[float] = (), n_levels: int = 0, n_layers: int = 0) -> DataFrame:
    """Points with zmin, zmax, z, ``surface`` fields and the variables' values on layer centres at z."""
    n, m = len(sigma_layers) or n_layers, len(sigma_levels) or n_levels
    out, _, _ = _on_layers(points, fields, nodes, {s: 1 for s in surface} | {v: n for v in variables}, sigma_levels, sigma_layers, m, n, z=z, every=every)
    new = {v: F.when(F.col("level_flag") == 0, at_depth(level_columns(v, n), "layers")) for v in variables}
    new |= {s: F.col(f"{s}_0") for s in surface} | {"zmin": -F.col("_h"), "zmax": F.col("zeta_0")}
    return out.withColumns(new)


def horizontal_diffusivity_layers(points: DataFrame, fields: DataFrame, mesh: Mesh, sigma_levels: Sequence[float] = (), sigma_layers: Sequence[float] = (),
                                  variable: str = "ah", n_levels: int = 0, n_layers: int = 0) -> DataFrame:
    """Ah on the layers of a terrain-following source and its horizontal gradient at (t, x, y, z)."""
    n, m = len(sigma_layers) or n_layers, len(sigma_levels) or n_levels
    out, _, _ = _on_layers(with_gradients(points, mesh), fields, mesh.nodes, {variable: n}, sigma_levels, sigma_layers, m, n, GRADIENT_WEIGHTS)
    new = {variable: at_depth(level_columns(variable, n), "layers")}
    new |= {f"d{variable}_d{a}": at_depth(level_columns(variable, n, f"_d{a}"), "layers") for a in "xy"}
    return out.withColumns(new).select(*points.columns, "level_flag", *new)


def sample_velocity(points: DataFrame, fields: DataFrame, level_depths: Sequence[float], nodes: DataFrame,
                    names: Sequence[str] = ("uo", "vo", "wo"), has_w: bool = True) -> DataFrame:
    """(uo, vo, wo) from node data; a missing vertical part is 0."""
    wanted = list(names) if has_w else list(names[:2])
    out = sample_variable(points, fields, wanted, level_depths, nodes)
    if not has_w:
        out = out.withColumn(names[2], F.when(F.col("level_flag") == 0, F.lit(0.0)))
    return out.withColumn(names[2], F.when(F.col("level_flag") == 0, F.coalesce(F.col(names[2]), F.lit(0.0))))


def sample_velocity_elements(points: DataFrame, elem_fields: DataFrame, mesh: Mesh, n_layers: int, names: Sequence[str] = ("uo", "vo", "wo")) -> DataFrame:
    """(uo, vo, wo) from element data on ``n_layers`` layers: Shepard weights on each layer, linear in time
    and between layers.

    Points carry their host, frames and vertical position (``locate_level`` with layers)."""
    wide = widen(elem_fields, {v: n_layers for v in names}, ("element_id", "time"))
    cells = [f"{v}_{k}" for v in names for k in range(n_layers)]
    got = idw_neighbours(points, wide, mesh, cells, in_time=True)
    new = {v: at_depth(level_columns(v, n_layers), "layers") for v in names}
    return got.withColumns(new).select(*points.columns, *names)


def sample_velocity_staggered(points: DataFrame, sources: dict[str, tuple[Mesh, DataFrame, int]], layers: Sequence[str] = ("uo", "vo"),
                              key: str = "point_id") -> DataFrame:
    """(uo, vo, wo) where each component has its own mesh and fields.

    ``sources``: component → (mesh, fields, number of levels). Points carry their frames and
    vertical position. Components in ``layers`` lie on layer centres, the others on
    interfaces. Each mesh is searched once; results meet by the key. Curvilinear grids:
    unstagger to the centres and ``geo.rotate_vector`` first."""
    from spark_drift.operators.locate import locate_points

    out = points
    vertical = ["t_last", "t_next", "t_frac", "k", "omega", "in_surface", "in_bottom", "k_upper", "k_lower", "omega_layers"]
    for name, (mesh, fields, n) in sources.items():
        found = locate_points(points.select(key, "x", "y", *vertical), mesh).where("host is not null")
        got = gather(found, fields, {name: n}, keep=[key, *vertical[3:]])
        columns = level_columns(name, n)
        value = at_depth(columns, "layers") if name in layers else on_interfaces(columns)
        out = out.join(shuffled(got.select(key, value.alias(name))), key, "left")
    if "wo" not in sources:
        out = out.withColumn("wo", F.lit(0.0))
    return out


def vertical_diffusivity(points: DataFrame, fields: DataFrame, nodes: DataFrame | None = None, layout: str = "layers",
                         variable: str = "kz", gradient: bool = False, **levels) -> DataFrame:
    """Kz (and dKz/dz) at (t, x, y, z), linear between interfaces.

    layout ``layers``: σ interfaces (sigma_levels, sigma_layers); ``node_levels``: fixed
    depths (level_depths), no gradient; ``surface``: 0. Columns of one profile:
    ``profile_diffusivity``."""
    if layout == "surface":
        return points.withColumns({variable: F.lit(0.0), f"d{variable}_dz": F.lit(0.0)})
    if layout == "node_levels":
        if gradient:
            raise ValueError("no gradient on fixed levels")
        return sample_variable(points, fields, [variable], levels["level_depths"], nodes)
    return sample_layers(points, fields, nodes, on_levels=[variable], gradients=[variable] if gradient else (), **levels)


def vertical_diffusivity_gradient(points: DataFrame, fields: DataFrame, nodes: DataFrame, variable: str = "kz", **levels) -> DataFrame:
    """dKz/dz: centred differences on the interfaces, one-sided in the end layers, linear between."""
    return vertical_diffusivity(points, fields, nodes, "layers", variable, gradient=True, **levels)


def profile_diffusivity(points: DataFrame, profile: DataFrame, by: Sequence[str] = ("time",), spline: bool = False) -> DataFrame:
    """Kz and its gradient from one column of data; negative values count as 0."""
    got = profile_spline(points, profile, by[0]) if spline else profile_linear(points, profile, by)
    return got.withColumn("value", F.when(F.col("value").isNotNull(), F.greatest("value", F.lit(0.0))))


def log_layer_velocity(speed: Column, z: Column, zmin: Column, z_layer: Column, z0: float) -> Column:
    """Velocity below the lowest layer centre by the law of the wall; 0 at or below zmin + z0."""
    height, ref = z - zmin, z_layer - zmin
    scaled = speed * F.log(height / F.lit(z0)) / nonzero(F.log(ref / F.lit(z0)))
    return F.when(height <= z0, F.lit(0.0)).when(z < z_layer, scaled).otherwise(speed)


def horizontal_diffusivity(points: DataFrame, fields: DataFrame, mesh: Mesh, level_depths: Sequence[float],
                           variable: str = "ah") -> DataFrame:
    """Ah and its horizontal gradient at (t, x, y, z)."""
    out = on_levels_of(with_gradients(points, mesh), fields, mesh.nodes, level_depths, [variable], GRADIENT_WEIGHTS)
    new = {variable: between_levels(F.col(f"{variable}_a"), F.col(f"{variable}_b"))}
    new |= {f"d{variable}_d{a}": between_levels(F.col(f"{variable}_a_d{a}"), F.col(f"{variable}_b_d{a}")) for a in "xy"}
    return out.withColumns(new).select(*points.columns, *new)


def smagorinsky_diffusivity(points: DataFrame, fields: DataFrame, mesh: Mesh, level_depths: Sequence[float],
                            constant: float = 0.2, names: Sequence[str] = ("uo", "vo")) -> DataFrame:
    """½·c·A·√(u_x² + v_y² + ½(u_y + v_x)²) per level, linear in depth. Its gradient counts as 0."""
    u, v = names
    out = on_levels_of(with_gradients(points, mesh), fields, mesh.nodes, level_depths, names, GRADIENT_WEIGHTS)
    on_level = {}
    for side in "ab":
        ux, uy = F.col(f"{u}_{side}_dx"), F.col(f"{u}_{side}_dy")
        vx, vy = F.col(f"{v}_{side}_dx"), F.col(f"{v}_{side}_dy")
        shear = ux * ux + vy * vy + F.lit(0.5) * (uy + vx) * (uy + vx)
        on_level[f"_s_{side}"] = F.lit(0.5 * constant) * F.col("area") * F.sqrt(shear)
    out = out.withColumns(on_level)
    value = between_levels(F.col("_s_a"), F.col("_s_b"))
    return out.withColumns({"ah": value, "dah_dx": F.lit(0.0), "dah_dy": F.lit(0.0)}).select(*points.columns, "ah", "dah_dx", "dah_dy")


def wet_elements(elements: DataFrame, level_mask: DataFrame) -> DataFrame:
    """(element_id, time, wet): a sea element is dry where a vertex is masked on the top level."""
    corners = elements.where(F.col("mask_c") != LAND).select("element_id", F.explode("nv").alias("node_id"))
    top = level_mask.where(F.col("level") == 0).select("node_id", "time", "masked")
    return corners.join(shuffled(top), "node_id").groupBy("element_id", "time").agg((F.lit(1) - F.max("masked")).cast("int").alias("wet"))


def is_wet(points: DataFrame, wet: DataFrame, surface: bool = False) -> DataFrame:
    """Adds ``wet``: the host is wet in both frames (and zmax ≥ zmin where those columns exist)."""
    if surface:
        return points.withColumn("wet", F.lit(1))
    out = points
    for c in ("t_last", "t_next"):
        w = wet.select(F.col("element_id").alias("host"), F.col("time").alias(c), F.col("wet").alias(f"_wet_{c}"))
        out = out.join(shuffled(w), ["host", c], "left")
    both = F.least(F.coalesce("_wet_t_last", F.lit(0)), F.coalesce("_wet_t_next", F.lit(0)))
    out = out.select(*points.columns, both.alias("wet"))
    if {"zmin", "zmax"} <= set(points.columns):
        out = out.withColumn("wet", F.when(F.col("zmax") >= F.col("zmin"), F.col("wet")).otherwise(0))
    return out


def sample_wind(points: DataFrame, fields: DataFrame) -> DataFrame:
    out = gather(points, fields, {"u10": 1, "v10": 1})
    return out.withColumnsRenamed({"u10_0": "u10", "v10_0": "v10"})


def sample_stokes(points: DataFrame, fields: DataFrame) -> DataFrame:
    out = gather(points, fields, {"usd": 1, "vsd": 1})
    return out.withColumnsRenamed({"usd_0": "usd", "vsd_0": "vsd"})


# --- column profiles ------------------------------------------------------------------


def _profiles(profile: DataFrame, by: Sequence[str], z: str = "z", value: str = "value") -> DataFrame:
    """One row per profile: p, its (z, v) from the bottom up. A profile is as long as its column has levels."""
    return profile.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(z).alias("z"), F.col(value).alias("v")))).alias("p"))


def _linear_layers(rows: DataFrame) -> DataFrame:
    """Adds ``layers`` to rows with a profile p: (k, z_lo, z_hi, v_lo, v_hi, g_lo, g_hi), g being nodal
    slopes, centred inside and one-sided at the ends. Null without two levels."""
    n = F.size("p")
    at = lambda i: F.get("p", i)
    slope = lambda i: (at(F.least(i + 1, n - 1))["v"] - at(F.greatest(i - 1, F.lit(0)))["v"]) / nonzero(at(F.least(i + 1, n - 1))["z"] - at(F.greatest(i - 1, F.lit(0)))["z"])
    layer = lambda i: F.struct(i.alias("k"), at(i)["z"].alias("z_lo"), at(i + 1)["z"].alias("z_hi"), at(i)["v"].alias("v_lo"),
                               at(i + 1)["v"].alias("v_hi"), slope(i).alias("g_lo"), slope(i + 1).alias("g_hi"))
    return rows.withColumn("layers", F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), layer)))


def profile_layers(profile: DataFrame, by: Sequence[str] = ("time",), z: str = "z", value: str = "value") -> DataFrame:
    """One row per profile with the array of its layers from the bottom up."""
    return _linear_layers(_profiles(profile, by, z, value)).select(*by, "layers")


def _own_layer(points: DataFrame, layers: DataFrame, by: Sequence[str], z: str) -> DataFrame:
    """Points with ``_l``, the first layer of their profile that holds z; null outside the profile."""
    return _pick_layer(skew_safe_join(points, layers, by, "left"), z)


def _pick_layer(rows: DataFrame, z: str) -> DataFrame:
    return rows.withColumn("_l", F.get(F.filter("layers", lambda layer: F.col(z).between(layer["z_lo"], layer["z_hi"])), F.lit(0))).drop("layers")


def _linear_values(rows: DataFrame, columns: Sequence[str], z: str) -> DataFrame:
    omega = fraction(F.col(z), F.col("_l.z_lo"), F.col("_l.z_hi"))
    return rows.select(*columns, F.col("_l.k").alias("k"), lerp(omega, F.col("_l.v_lo"), F.col("_l.v_hi")).alias("value"),
                       lerp(omega, F.col("_l.g_lo"), F.col("_l.g_hi")).alias("gradient"))


def profile_linear(points: DataFrame, profile: DataFrame, by: Sequence[str] = ("time",), z: str = "z") -> DataFrame:
    """Layer k, value and derivative of a 1-D column at each point; the first layer from the bottom wins
    on an interface. Points outside their profile, or without one, stay with nulls."""
    return _linear_values(_own_layer(points, profile_layers(profile, by), by, z), points.columns, z)


def profile_in_time(points: DataFrame, profile: DataFrame, z: str = "z", spline: bool = False) -> DataFrame:
    """Value and derivative of the column at each point's time, which may lie between frames.

    Levels and values of the two frames around a point (t_last, t_next, t_frac) are interpolated in
    time first, level by level (``profile``: time, level, z, value; levels of both frames count), and
    the profile so made is sampled at z. Points without frames or outside the profile have nulls."""
    pairs = points.select("t_last", "t_next").where("t_last is not null").distinct()
    last, nxt = (profile.select(F.col("time").alias(t), "level", F.col("z").alias(f"z{i}"), F.col("value").alias(f"v{i}")) for i, t in enumerate(("t_last", "t_next")))
    both = pairs.join(last, "t_last").join(nxt, ["t_next", "level"])
    both = both.groupBy("t_last", "t_next").agg(F.collect_list(F.struct("z0", "z1", "v0", "v1")).alias("_b"))
    rows = skew_safe_join(points, both, ["t_last", "t_next"], "left")
    between = F.transform("_b", lambda b: F.struct(lerp(F.col("t_frac"), b["z0"], b["z1"]).alias("z"), lerp(F.col("t_frac"), b["v0"], b["v1"]).alias("v")))
    rows = rows.withColumn("p", F.array_sort(between)).drop("_b")
    if spline:
        return _spline_values(_pick_layer(_spline_layers(rows), z), points.columns, z)
    return _linear_values(_pick_layer(_linear_layers(rows), z), points.columns, z)


def _spline_layers(rows: DataFrame) -> DataFrame:
    """Adds ``layers`` to rows with a profile p: (z_lo, z_hi, v_lo, v_hi, m_lo, m_hi), m being the second
    derivatives of the natural cubic spline.

    The tridiagonal system is swept along the sorted arrays: once upwards for the pivots, once
    downwards for the derivatives."""
    n = F.size("p")
    at = lambda i: F.get("p", i)
    h = lambda i: at(i + 1)["z"] - at(i)["z"]
    none = F.array().cast("array<int>")
    inner = F.when(n > 2, F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))).otherwise(none)
    side = lambda i: F.lit(6.0) * ((at(i + 1)["v"] - at(i)["v"]) / h(i) - (at(i)["v"] - at(i - 1)["v"]) / h(i - 1))
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))

    def up(swept: Column, i: Column) -> Column:
        last = F.element_at(swept, -1)
        pivot = F.lit(2.0) * (h(i - 1) + h(i)) - h(i - 1) * last["c"]
        return F.concat(swept, F.array(F.struct((h(i) / pivot).alias("c"), ((side(i) - h(i - 1) * last["d"]) / pivot).alias("d"))))

    rows = rows.withColumn("_s", F.aggregate(inner, F.array(zero), up))
    down = F.when(n > 2, F.sequence(F.greatest(n - 2, F.lit(1)), F.lit(1), F.lit(-1))).otherwise(none)
    back = F.aggregate(down, F.array(F.lit(0.0)), lambda m, i: F.concat(F.array(F.get("_s", i)["d"] - F.get("_s", i)["c"] * F.element_at(m, 1)), m))
    rows = rows.withColumn("_m", F.concat(F.array(F.lit(0.0)), back))
    layer = lambda i: F.struct(at(i)["z"].alias("z_lo"), at(i + 1)["z"].alias("z_hi"), at(i)["v"].alias("v_lo"), at(i + 1)["v"].alias("v_hi"),
                               F.get("_m", i).alias("m_lo"), F.get("_m", i + 1).alias("m_hi"))
    return rows.withColumn("layers", F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), layer))).drop("_s", "_m")


def spline_layers(profile: DataFrame, by: Sequence[str] = ("time",), z: str = "z", value: str = "value") -> DataFrame:
    """One row per profile with the array of its spline's layers."""
    return _spline_layers(_profiles(profile, by, z, value)).select(*by, "layers")


def _spline_values(rows: DataFrame, columns: Sequence[str], z: str) -> DataFrame:
    c = lambda name: F.col(f"_l.{name}")
    h, a, b = c("z_hi") - c("z_lo"), c("z_hi") - F.col(z), F.col(z) - c("z_lo")
    value = (c("m_lo") * a * a * a + c("m_hi") * b * b * b) / (h * 6) \
        + (c("v_lo") / h - c("m_lo") * h / 6) * a + (c("v_hi") / h - c("m_hi") * h / 6) * b
    slope = (c("m_hi") * b * b - c("m_lo") * a * a) / (h * 2) + (c("v_hi") - c("v_lo")) / h - (c("m_hi") - c("m_lo")) * h / 6
    return rows.select(*columns, value.alias("value"), slope.alias("gradient"))


def profile_spline(points: DataFrame, profile: DataFrame, by: str = "time", z: str = "z") -> DataFrame:
    """Value and first derivative of the natural cubic spline of each point's profile; null outside it."""
    return _spline_values(_own_layer(points, spline_layers(profile, [by]), [by], z), points.columns, z)


def time_series_at_depth(profile: DataFrame, depth: float, zeta: DataFrame | None = None, by: str = "time") -> DataFrame:
    """(time, value) at depth + ζ(t): linear in z, clamped to the ends of the profile."""
    target = F.lit(float(depth))
    rows = profile
    if zeta is not None:
        rows = rows.join(zeta.select(by, F.col("zeta").alias("_zeta")), by)
        target = target + F.col("_zeta")
    below, above = F.col("z") <= target, F.col("z") >= target
    lo, hi = F.when(below, F.col("z")), F.when(above, F.col("z"))
    agg = rows.groupBy(by).agg(
        F.max(lo).alias("z0"), F.max_by("value", lo).alias("v0"), F.min(hi).alias("z1"), F.min_by("value", hi).alias("v1"),
        F.max(target).alias("_t"))
    f = F.coalesce((F.col("_t") - F.col("z0")) / nonzero(F.col("z1") - F.col("z0")), F.lit(0.0))
    value = F.when(F.col("z0").isNull(), F.col("v1")).when(F.col("z1").isNull(), F.col("v0")).otherwise(lerp(f, "v0", "v1"))
    return agg.select(by, value.alias("value"))


def profile_at(profile: DataFrame, date, time: str = "time") -> DataFrame:
    """The profile at the time nearest to ``date``, from the bottom up."""
    return nearest_time(profile, date, time).orderBy("z")


def hovmoller(profile: DataFrame, edges: DataFrame) -> DataFrame:
    """Profile rows with the depth edges of their cell: ``edges`` (time, level, z), one more level than layers.

    Values on interfaces (as many levels as edges) take their own edge as both bounds."""
    top = edges.select("time", "level", F.col("z").alias("z_upper"))
    low = edges.select("time", (F.col("level") - 1).alias("level"), F.col("z").alias("z_lower"))
    return profile.join(top, ["time", "level"]).join(low, ["time", "level"])


def sample_column(points: DataFrame, n_depths: int, zmin: str = "zmin", zmax: str = "zmax") -> DataFrame:
    """Each point repeated at n equally spaced depths from floor to surface (depth_index, z)."""
    rows = points.withColumn("depth_index", F.explode(F.sequence(F.lit(0), F.lit(n_depths - 1))))
    step = (F.col(zmax) - F.col(zmin)) / F.lit(max(n_depths - 1, 1))
    return rows.withColumn("z", F.least(F.col(zmin) + step * F.col("depth_index"), F.col(zmax)))


def speed(u: str = "uo", v: str = "vo") -> Column:
    return F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))
