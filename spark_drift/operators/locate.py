"""Point location and boundary geometry on triangle meshes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_drift.functions import geo
from spark_drift.operators.mesh import SIDE_ENDS, centre_columns, corner_vectors, element_corners, element_sides
from spark_drift.schema import LAND, LAND_CROSSED, MASKED_ELEMENT, NOT_FOUND, OPEN_CROSSED, PHI_EPS, Mesh
from spark_drift.util import cut_lineage, one_row, shuffled, skew_safe_join

HOST_COLUMNS = ["host", "n0", "n1", "n2", "phi0", "phi1", "phi2", "mask_c", "flag"]


def with_host_test(elements: DataFrame, geographic: bool) -> DataFrame:
    """Corner columns plus, on the sphere, the inward normals of the three sides (s{k}x, s{k}y, s{k}z).

    Formed once per element, so a candidate pair costs three dot products and no trigonometry."""
    if not geographic:
        return elements
    a, b, c = corner_vectors(True)
    out, v = geo.stage(elements, v0=a, v1=b, v2=c)
    out = out.withColumn("_turn", F.signum(geo.det3(*v)))
    normals = {f"s{k}{a}": F.col("_turn") * c for k, (i, j) in enumerate(SIDE_ENDS) for a, c in zip("xyz", geo.cross3(v[i], v[j]))}
    return geo.unstage(out.withColumns(normals), "v0", "v1", "v2").drop("_turn")


TEST_COLUMNS = {
    False: [f"{a}{k}" for k in range(3) for a in "xy"],
    True: [f"s{k}{a}" for k in range(3) for a in "xyz"],
}


def with_position(points: DataFrame, x: str, y: str, geographic: bool) -> DataFrame:
    """Adds the position as _ux, _uy, _uz: unit vector on the sphere, (x, y, 0) in the plane."""
    p = _position(F.col(x), F.col(y), geographic)
    return points.withColumns(dict(zip(("_ux", "_uy", "_uz"), p)))


def phi_columns(geographic: bool, of: Callable[[str], Column] = F.col) -> list[Column]:
    """Barycentric coordinates of (_ux, _uy, _uz) in the triangle of the test columns; ``of`` finds a column."""
    x, y = of("_ux"), of("_uy")
    if not geographic:
        ax, ay = of("x1") - of("x0"), of("y1") - of("y0")
        bx, by = of("x2") - of("x0"), of("y2") - of("y0")
        area2 = ax * by - ay * bx
        phi1 = (by * (x - of("x2")) - bx * (y - of("y2"))) / area2
        phi2 = (ax * (y - of("y0")) - ay * (x - of("x0"))) / area2
        return [F.lit(1.0) - phi1 - phi2, phi1, phi2]
    p = (x, y, of("_uz"))
    s = [geo.dot3(p, tuple(of(f"s{k}{a}") for a in "xyz")) for k in range(3)]
    s = [F.when((c < 0) & (c >= -PHI_EPS), F.lit(0.0)).otherwise(c) for c in s]
    total = geo.nonzero(s[0] + s[1] + s[2])
    return [F.when(F.least(*s) < 0, F.lit(-1.0)).otherwise(c / total) for c in s]


def _inside(phis: list[Column]) -> Column:
    return (phis[0] >= 0) & (phis[1] >= 0) & (phis[2] >= 0)


def _position(x: Column, y: Column, geographic: bool) -> geo.Vec:
    if geographic:
        return geo.to_unit_vector(F.radians(x), F.radians(y))
    return (x, y, F.lit(0.0))


def _boxes(mesh: Mesh) -> DataFrame:
    """Element corners with the scale of their cells and one row per cell their box touches.

    The cell side is the power of two at or above the box extent, so a box touches at most
    two cells per axis whatever the mix of element sizes. On the sphere the box is that of
    the unit vectors, widened by the most that the surface bulges over the flat triangle;
    poles and the date line need no care there."""
    g = mesh.geographic
    a, b, c = corner_vectors(g)
    corners, p = geo.stage(element_corners(mesh), v0=a, v1=b, v2=c)
    axes = range(3 if g else 2)
    lo = [F.least(*[v[a] for v in p]) for a in axes]
    hi = [F.greatest(*[v[a] for v in p]) for a in axes]
    if g:
        chord2 = F.greatest(*[geo.dot3(d, d) for d in (tuple(p[i][a] - p[j][a] for a in range(3)) for i, j in SIDE_ENDS)])
        bulge = F.lit(1.0) - F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - chord2 / 3))
        pad = bulge + F.lit(1e-9)
    else:
        pad = F.greatest(*[h - l for h, l in zip(hi, lo)]) * 1e-9
    corners = corners.withColumns({f"_lo{a}": lo[a] for a in axes} | {f"_hi{a}": hi[a] for a in axes} | {"_pad": pad})
    lo, hi, pad = [F.col(f"_lo{a}") for a in axes], [F.col(f"_hi{a}") for a in axes], F.col("_pad")
    out = corners.withColumns({f"_lo{a}": lo[a] - pad for a in axes} | {f"_hi{a}": hi[a] + pad for a in axes}).drop("_pad")
    out = with_host_test(geo.unstage(out, "v0", "v1", "v2"), g)
    extent = F.greatest(*[F.col(f"_hi{a}") - F.col(f"_lo{a}") for a in axes])
    out = out.withColumn("_scale", F.ceil(F.log2(extent)).cast("int"))
    side = F.pow(F.lit(2.0), F.col("_scale"))
    for a in axes:
        cell = lambda name: F.floor(F.col(name) / side).cast("long")
        out = out.withColumn(f"_c{a}", F.explode(F.sequence(cell(f"_lo{a}"), cell(f"_hi{a}"))))
    return out.drop(*[f"_lo{a}" for a in axes], *[f"_hi{a}" for a in axes])


def _candidates(points: DataFrame, mesh: Mesh, x: str, y: str) -> tuple[DataFrame, DataFrame, Column]:
    """Points per cell, element boxes per cell, and the equi-join condition between them."""
    g = mesh.geographic
    boxes = _boxes(mesh)
    # the scales in use: a handful of exponents in one row
    scales = one_row(mesh_scales(mesh))["scales"] or [0]
    axes = range(3 if g else 2)
    left = with_position(points, x, y, g)
    left = left.withColumn("_pscale", F.explode(F.array(*[F.lit(int(s)) for s in sorted(scales)])))
    side = F.pow(F.lit(2.0), F.col("_pscale"))
    left = left.withColumns({f"_p{a}": F.floor(F.col(f"_u{'xyz'[a]}") / side).cast("long") for a in axes})
    on = F.col("_pscale") == F.col("_scale")
    for a in axes:
        on = on & (F.col(f"_p{a}") == F.col(f"_c{a}"))
    return left, boxes, on


def element_cells(mesh: Mesh) -> tuple[DataFrame, list[int]]:
    """One row per cell (_scale, _c0…) with the array of its elements (host, nv, mask_c, test columns), and
    the scales in use."""
    boxes = _boxes(mesh)
    if "mask_c" not in boxes.columns:
        boxes = boxes.withColumn("mask_c", F.lit(0))
    axes = range(3 if mesh.geographic else 2)
    element = F.struct(F.col("element_id").alias("host"), "nv", "mask_c", *TEST_COLUMNS[mesh.geographic])
    cells = boxes.groupBy("_scale", *[f"_c{a}" for a in axes]).agg(F.collect_list(element).alias("elements"))
    return cells, sorted(one_row(mesh_scales(mesh))["scales"] or [0])


def mesh_scales(mesh: Mesh) -> DataFrame:
    return _boxes(mesh).agg(F.collect_set("_scale").alias("scales"))


def locate_points(points: DataFrame, mesh: Mesh, x: str = "x", y: str = "y") -> DataFrame:
    """Host element of every point: host, its nodes n0..n2, φ0..φ2, mask_c and flag.

    The theta join is an equi-join on grid cells with the exact φ test as residual; the
    lowest element id wins on shared sides. A point off the mesh, or whose element is
    LAND, has a null host and flag −3.

    Each distinct position is searched once and only the position travels through the search;
    the point rows meet its result in one join, so equal rows stay separate rows."""
    left, boxes, on = _candidates(points.select(x, y).distinct(), mesh, x, y)
    phis = phi_columns(mesh.geographic)
    if "mask_c" not in boxes.columns:
        boxes = boxes.withColumn("mask_c", F.lit(0))
    axes = range(3 if mesh.geographic else 2)
    renamed = boxes.select(
        F.col("element_id").alias("_e"), F.col("mask_c").alias("_mask"), *[F.col("nv")[k].alias(f"_n{k}") for k in range(3)],
        *TEST_COLUMNS[mesh.geographic], "_scale", *[f"_c{a}" for a in axes],
    )
    hits = left.join(shuffled(renamed), on & _inside(phis), "left")
    for k in range(3):
        hits = hits.withColumn(f"_phi{k}", phis[k])
    best = hits.groupBy(x, y).agg(
        F.min("_e").alias("host"),
        *[F.min_by(f"_n{k}", "_e").alias(f"n{k}") for k in range(3)],
        *[F.min_by(f"_phi{k}", "_e").alias(f"phi{k}") for k in range(3)],
        F.min_by("_mask", "_e").alias("mask_c"),
    )
    found = skew_safe_join(shuffled(points), best, [x, y], "left")
    return flag_hosts(found.select(*points.columns, "host", "n0", "n1", "n2", "phi0", "phi1", "phi2", "mask_c"))


def flag_hosts(df: DataFrame) -> DataFrame:
    """Flag 0 in a sea or boundary element; −3 with a null host elsewhere."""
    ok = F.col("host").isNotNull() & (F.col("mask_c") != LAND)
    keep = {c: F.when(ok, F.col(c)) for c in HOST_COLUMNS[:-2]}
    return df.withColumn("flag", F.when(ok, 0).otherwise(NOT_FOUND).cast("int")).withColumns(keep)


def locate_with_hint(points: DataFrame, mesh: Mesh, hint: str = "hint", x: str = "x", y: str = "y") -> DataFrame:
    """As ``locate_points``, trying the hinted element first.

    A point strictly inside its hinted element can have no other host, so only the rest go
    through the cell join. A hinted LAND element gives −4 at once."""
    corners = element_corners(mesh)
    if "mask_c" not in corners.columns:
        corners = corners.withColumn("mask_c", F.lit(0))
    g = mesh.geographic
    corners = with_host_test(corners, g).select(F.col("element_id").alias("host"), "mask_c", *[F.col("nv")[k].alias(f"n{k}") for k in range(3)],
                                                *TEST_COLUMNS[g])
    tried = with_position(points, x, y, g).join(corners, F.col(hint) == F.col("host"), "left")
    phis = phi_columns(g)
    for k in range(3):
        tried = tried.withColumn(f"phi{k}", phis[k])
    strict = F.col("host").isNotNull() & (F.col("phi0") > 0) & (F.col("phi1") > 0) & (F.col("phi2") > 0)
    columns = [*points.columns, *HOST_COLUMNS[:-1]]
    hit = tried.where(strict).select(*columns)
    land = F.col("mask_c") == LAND
    hit = hit.withColumn("flag", F.when(land, MASKED_ELEMENT).otherwise(0).cast("int"))
    hit = hit.withColumns({c: F.when(~land, F.col(c)) for c in HOST_COLUMNS[:-2]})
    rest = tried.where(~F.coalesce(strict, F.lit(False))).select(*points.columns)
    return hit.unionByName(locate_points(rest, mesh, x, y))


def locate_on_grids(points: DataFrame, meshes: dict[str, Mesh], primary: str, key: str = "point_id",
                    x: str = "x", y: str = "y", composite: bool = False) -> DataFrame:
    """Hosts on several meshes as a map, and one flag.

    Staggered meshes: the primary mesh decides the flag, and a point inside it but outside
    another mesh is an error. Composite sources: the first non-zero flag is returned."""
    out = points
    for name, mesh in meshes.items():
        found = locate_points(points.select(key, x, y), mesh, x, y)
        found = found.select(key, F.col("host").alias(f"_h_{name}"), F.col("flag").alias(f"_f_{name}"))
        out = out.join(found, key)
    order = [primary, *[m for m in meshes if m != primary]]
    first = F.col(f"_f_{primary}")
    if composite:
        flag = F.coalesce(*[F.when(F.col(f"_f_{m}") != 0, F.col(f"_f_{m}")) for m in order], F.lit(0))
    else:
        lost = F.lit(False)
        for m in order[1:]:
            lost = lost | (F.col(f"_f_{m}") != 0)
        flag = F.when((first == 0) & lost,
                      F.raise_error(F.lit("point lies in the primary mesh but not in a staggered one")).cast("int")).otherwise(first)
    pairs = F.array(*[F.struct(F.lit(m).alias("k"), F.col(f"_h_{m}").alias("v")) for m in meshes])
    return out.select(*points.columns, F.map_from_entries(pairs).alias("hosts"), flag.alias("flag"))


def local_coordinates(points: DataFrame, mesh: Mesh, host: str = "host", x: str = "x", y: str = "y") -> DataFrame:
    """φ in a known host; −1e-12 ≤ φ < 0 counts as 0, less is an error."""
    g = mesh.geographic
    corners = with_host_test(element_corners(mesh), g).select(F.col("element_id").alias("_e"), *TEST_COLUMNS[g])
    joined = with_position(points, x, y, g).join(corners, F.col(host) == F.col("_e"))
    phis = phi_columns(g)
    bad = F.raise_error(F.lit("point lies outside its host element")).cast("double")
    out = {f"phi{k}": F.when(p >= 0, p).when(p >= -PHI_EPS, F.lit(0.0)).otherwise(bad) for k, p in enumerate(phis)}
    return joined.withColumns(out).select(*points.columns, "phi0", "phi1", "phi2")


def snap_to_centre(points: DataFrame, mesh: Mesh, host: str = "host", x: str = "x", y: str = "y") -> DataFrame:
    """Positions replaced by the centre of the host element."""
    xc, yc = centre_columns(mesh.geographic)
    centres = element_corners(mesh).select(F.col("element_id").alias("_e"), xc.alias("_xc"), yc.alias("_yc"))
    joined = points.join(centres, F.col(host) == F.col("_e"))
    return joined.withColumns({x: F.col("_xc"), y: F.col("_yc")}).select(*points.columns)


def boundary_edges(mesh: Mesh) -> DataFrame:
    """(element_id, slot, na, nb, kind): sides on a land (−1) or open (−2) boundary."""
    kinds = mesh.elements.select("element_id", F.posexplode("nbe").alias("slot", "kind")).where("kind < 0")
    sides = element_sides(mesh.elements).select("element_id", "slot", "na", "nb")
    return sides.join(kinds.withColumn("kind", F.col("kind").cast("int")), ["element_id", "slot"])


def wall_sides(mesh: Mesh) -> DataFrame:
    """Sides a path may not cross: (element_id, slot, kind, side ends sx, sy, ex, ey).

    kind −1: no neighbour, or a LAND neighbour; kind −2: open boundary. Sides of LAND
    elements are left out: a path only ever meets them from the sea."""
    el = element_corners(mesh)
    if "mask_c" not in el.columns:
        el = el.withColumn("mask_c", F.lit(0))
    sides = F.array(*[
        F.struct(F.lit(k).alias("slot"), F.col("nbe")[k].alias("nb"), F.col(f"x{i}").alias("sx"), F.col(f"y{i}").alias("sy"),
                 F.col(f"x{j}").alias("ex"), F.col(f"y{j}").alias("ey"))
        for k, (i, j) in enumerate(SIDE_ENDS)])
    rows = el.where(F.col("mask_c") != LAND).select("element_id", F.explode(sides).alias("s")).select("element_id", "s.*")
    land = el.where(F.col("mask_c") == LAND).select(F.col("element_id").alias("nb"), F.lit(1).alias("_land"))
    rows = rows.join(land, "nb", "left").where("nb < 0 or _land = 1")
    kind = F.when(F.col("nb") == OPEN_CROSSED, OPEN_CROSSED).otherwise(LAND_CROSSED).cast("int")
    return rows.withColumn("kind", kind).drop("nb", "_land")


def with_crossing(pairs: DataFrame, geographic: bool) -> DataFrame:
    """Keep the pairs whose wall (sx, sy)–(ex, ey) meets the move (x, y)–(x_new, y_new): adds xi, yi."""
    c = F.col
    if not geographic:
        hit = geo.segment_intersection((c("sx"), c("sy")), (c("ex"), c("ey")), (c("x"), c("y")), (c("x_new"), c("y_new")))
        out = pairs.withColumn("_xi", hit).where("_xi is not null")
        return out.withColumns({"xi": c("_xi.x"), "yi": c("_xi.y")}).drop("_xi")
    unit = lambda x, y: geo.to_unit_vector(F.radians(x), F.radians(y))
    out, ends = geo.stage(pairs, a=unit("sx", "sy"), b=unit("ex", "ey"), c=unit("x", "y"), d=unit("x_new", "y_new"))
    out, (n1, n2) = geo.stage(out, n1=geo.cross3(ends[0], ends[1]), n2=geo.cross3(ends[2], ends[3]))
    out, (line,) = geo.stage(out, line=geo.cross3(n1, n2))
    point = geo.arc_point(*ends, n1, n2, line)
    out = out.withColumn("_xi", point).where("_xi is not null")
    out = out.withColumns({"xi": F.degrees(c("_xi.x")), "yi": F.degrees(c("_xi.y"))}).drop("_xi")
    return geo.unstage(out, "a", "b", "c", "d", "n1", "n2", "line")


def _move_cells(moves: DataFrame, start: geo.Vec, end: geo.Vec, scales: list[int], pad: Column, axes: range) -> DataFrame:
    """One row per cell that a move runs through, per scale: strip by strip along the first axis.

    Within a strip only the part of the move inside it is followed, so a long move meets
    cells along its line and not its whole box."""
    rows = moves.withColumn("_ms", F.explode(F.array(*[F.lit(int(v)) for v in sorted(scales)])))
    rows = rows.withColumns({"_mside": F.pow(F.lit(2.0), F.col("_ms")), "_mpad": pad})
    side, pad = F.col("_mside"), F.col("_mpad")
    cell = lambda v: F.floor(v / side).cast("long")
    d0 = end[0] - start[0]
    lo, hi = F.least(start[0], end[0]) - pad, F.greatest(start[0], end[0]) + pad
    rows = rows.withColumn("_m0", F.explode(F.sequence(cell(lo), cell(hi))))
    enter = (F.col("_m0") * side - pad - start[0]) / geo.nonzero(d0)
    leave = ((F.col("_m0") + 1) * side + pad - start[0]) / geo.nonzero(d0)
    rows = rows.withColumns({"_ta": F.coalesce(geo.clamp(F.least(enter, leave), 0.0, 1.0), F.lit(0.0)),
                             "_tb": F.coalesce(geo.clamp(F.greatest(enter, leave), 0.0, 1.0), F.lit(1.0))})
    for a in axes[1:]:
        p, q = (start[a] + F.col(t) * (end[a] - start[a]) for t in ("_ta", "_tb"))
        rows = rows.withColumn(f"_m{a}", F.explode(F.sequence(cell(F.least(p, q) - pad), cell(F.greatest(p, q) + pad))))
    return rows.drop("_mside", "_mpad", "_ta", "_tb")


def first_walls(moves: DataFrame, mesh: Mesh) -> DataFrame:
    """First wall side that the straight move (x, y) → (x_new, y_new) crosses, by path length.

    Moves (move_id, …). Each wall lies in cells of the power of two at or above its own
    length (two per axis at most), each move in the cells along its line at every scale in
    use; the two meet by cell."""
    g = mesh.geographic
    axes = range(3 if g else 2)

    def bulge(p: geo.Vec, q: geo.Vec) -> Column:
        if not g:
            return F.lit(1e-9)
        d = tuple(p[a] - q[a] for a in axes)
        return F.lit(1e-9) + F.lit(1.0) - F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - geo.dot3(d, d) / 4))

    walls, (ws, we) = geo.stage(wall_sides(mesh), ws=_position(F.col("sx"), F.col("sy"), g), we=_position(F.col("ex"), F.col("ey"), g))
    walls = walls.withColumn("_wpad", bulge(ws, we))
    walls = walls.withColumns({f"_wlo{a}": F.least(ws[a], we[a]) - F.col("_wpad") for a in axes}
                              | {f"_whi{a}": F.greatest(ws[a], we[a]) + F.col("_wpad") for a in axes})
    walls = geo.unstage(walls, "ws", "we").drop("_wpad")
    extent = F.greatest(*[F.col(f"_whi{a}") - F.col(f"_wlo{a}") for a in axes])
    walls = walls.withColumn("_ws", F.ceil(F.log2(extent)).cast("int"))
    scales = one_row(walls.agg(F.collect_set("_ws").alias("s")))["s"] or [0]  # a handful of exponents
    right = walls
    for a in axes:
        cell = lambda name: F.floor(F.col(name) / F.pow(F.lit(2.0), F.col("_ws"))).cast("long")
        right = right.withColumn(f"_w{a}", F.explode(F.sequence(cell(f"_wlo{a}"), cell(f"_whi{a}"))))
    right = right.drop(*[f"_w{b}{a}" for a in axes for b in ("lo", "hi")])
    staged, (ms, me) = geo.stage(moves, ms=_position(F.col("x"), F.col("y"), g), me=_position(F.col("x_new"), F.col("y_new"), g))
    left = _move_cells(staged, ms, me, scales, bulge(ms, me), axes)
    left = geo.unstage(left, "ms", "me")
    on = F.col("_ms") == F.col("_ws")
    for a in axes:
        on = on & (F.col(f"_m{a}") == F.col(f"_w{a}"))
    right = right.withColumnsRenamed({"element_id": "wall_element", "slot": "wall_slot"})
    pairs = with_crossing(left.join(right, on), g)
    if g:
        along = geo.haversine(F.radians("x"), F.radians("y"), F.radians("xi"), F.radians("yi"))
    else:
        along = geo.euclid("x", "y", "xi", "yi")
    found = ["wall_element", "wall_slot", "kind", "sx", "sy", "ex", "ey", "xi", "yi"]
    best = pairs.withColumn("_d", along).groupBy("move_id").agg(F.min(F.struct("_d", *found)).alias("w"))
    return best.select("move_id", *[f"w.{c}" for c in found])


def crossings(moves: DataFrame, mesh: Mesh, walls: DataFrame | None = None) -> DataFrame:
    """Where each move (move_id, x, y, x_new, y_new, host) ends.

    flag −1 / −2 with the last sea element when a land or open side is crossed, else 0 with
    the new host. On the sphere an end point that no element accepts is put at the centre
    of its old host. ``walls``: the result of ``first_walls`` where it is at hand."""
    g = mesh.geographic
    if walls is None:
        walls = first_walls(moves, mesh)
    kept = moves.join(walls, "move_id", "left")
    crossed = kept.where("kind is not null").select(
        *moves.columns, F.col("wall_element").alias("new_host"), F.col("kind").alias("flag"))
    free = kept.where("kind is null").select(*moves.columns)
    ends = free.select("move_id", F.col("x_new").alias("x"), F.col("y_new").alias("y"))
    found = locate_points(ends, mesh).select("move_id", F.col("host").alias("new_host"), "flag")
    free = free.join(found, "move_id")
    if g:
        lost = free.where("new_host is null").drop("new_host", "flag")
        snapped = snap_to_centre(lost, mesh, "host", "x_new", "y_new").withColumn("new_host", F.col("host")).withColumn("flag", F.lit(0))
        free = free.where("new_host is not null").unionByName(snapped)
    return crossed.unionByName(free)


def boundary_intersection(moves: DataFrame, mesh: Mesh, strict: bool = True) -> DataFrame:
    """Side ends and crossing point where a move leaves its host.

    Sides of the host without neighbour, or whose neighbour has two or more land sides;
    the first side by (v0,v1), (v1,v2), (v2,v0) order that the move meets."""
    g = mesh.geographic
    corners = element_corners(mesh)
    land_sides = F.size(F.filter("nbe", lambda e: e == -1))
    closed = mesh.elements.where(land_sides >= 2).select(F.col("element_id").alias("nb"), F.lit(1).alias("_closed"))
    order = ((2, 0, 1), (0, 1, 2), (1, 2, 0))  # (slot, from, to)
    sides = F.array(*[
        F.struct(F.lit(r).alias("rank"), F.col("nbe")[k].alias("nb"), F.col(f"x{i}").alias("sx"), F.col(f"y{i}").alias("sy"),
                 F.col(f"x{j}").alias("ex"), F.col(f"y{j}").alias("ey"))
        for r, (k, i, j) in enumerate(order)])
    walls = corners.select(F.col("element_id").alias("_e"), F.explode(sides).alias("s")).select("_e", "s.*")
    walls = walls.join(closed, "nb", "left").where("nb = -1 or _closed = 1").drop("nb", "_closed")
    pairs = with_crossing(moves.join(walls, F.col("host") == F.col("_e")), g)
    found = ["sx", "sy", "ex", "ey", "xi", "yi"]
    best = pairs.groupBy("move_id").agg(F.min(F.struct("rank", *found)).alias("w"))
    best = best.select("move_id", *[f"w.{c}" for c in found])
    if not strict:
        return moves.join(best, "move_id")
    out = moves.join(best, "move_id", "left")
    bad = F.raise_error(F.lit("the move meets no boundary side of its host")).cast("double")
    return out.withColumn("xi", F.coalesce("xi", bad))


def reflect_across_side(crossed: DataFrame, cs: str = "cartesian") -> DataFrame:
    """Mirror the part of each move beyond its crossing point: adds x_ref, y_ref.

    On the sphere this is done in the plane tangent at the crossing point."""
    c = F.col
    if cs != "geographic":
        nx, ny = c("ey") - c("sy"), c("sx") - c("ex")
        dx, dy = c("x_new") - c("xi"), c("y_new") - c("yi")
        m = F.lit(2.0) * (nx * dx + ny * dy) / (nx * nx + ny * ny)
        return crossed.withColumns({"x_ref": c("xi") + dx - m * nx, "y_ref": c("yi") + dy - m * ny})
    # In the plane tangent at p, with b the new position and q along the side: the part of b
    # along q stays, the rest turns over. Multiplied out: p + m·(q − (q·p)p) − (b − (b·p)p).
    unit = lambda x, y: geo.to_unit_vector(F.radians(x), F.radians(y))
    side = tuple(e - s for e, s in zip(unit("ex", "ey"), unit("sx", "sy")))
    out, (p, b, q) = geo.stage(crossed, rp=unit("xi", "yi"), rb=unit("x_new", "y_new"), rq=side)
    out = out.withColumns({"_qp": geo.dot3(q, p), "_bp": geo.dot3(b, p), "_bq": geo.dot3(b, q), "_qq": geo.dot3(q, q)})
    out = out.withColumn("_m", F.lit(2.0) * (c("_bq") - c("_bp") * c("_qp")) / (c("_qq") - c("_qp") * c("_qp")))
    v = [(F.lit(1.0) - c("_m") * c("_qp") + c("_bp")) * p[a] + c("_m") * q[a] - b[a] for a in range(3)]
    out = out.withColumns({"x_ref": F.degrees(F.atan2(v[1], v[0])),
                           "y_ref": F.degrees(F.atan2(v[2], F.sqrt(v[0] * v[0] + v[1] * v[1])))})
    return geo.unstage(out, "rp", "rb", "rq").drop("_qp", "_bp", "_bq", "_qq", "_m")


def wet_distances(mesh: Mesh, wet: DataFrame, sources: DataFrame | None = None) -> list[DataFrame]:
    """Elements by their number of steps to the nearest wet element, one table (element_id) per number.

    The first holds the wet elements, the k-th what reaches one through k − 1 dry neighbours. All wet elements
    spread at once, so each dry element is labelled a single time whatever the number of sources, and since
    neighbours differ by one step at most, a new ring is checked against the last two alone. Each ring is a
    checkpointed table. ``sources`` (element_id): stop when all that can be reached are labelled.
    Elements missing in ``wet`` (element_id, wet) are walls."""
    links = _links(mesh)
    status = wet.select("element_id", "wet")
    rings = [status.where("wet = 1").select("element_id").distinct()]
    dry = status.where(~F.col("wet").eqNullSafe(1)).select("element_id").distinct()
    left = None if sources is None else sources.select("element_id").distinct().join(dry, "element_id", "left_semi").count()
    while left is None or left > 0:
        ring = rings[-1].withColumnRenamed("element_id", "_from").join(links, "_from").select("element_id").distinct().join(dry, "element_id", "left_semi")
        for known in rings[1:][-2:]:
            ring = ring.join(known, "element_id", "left_anti")
        ring = cut_lineage(ring)
        if ring.isEmpty():
            break
        rings.append(ring)
        if sources is not None:
            left -= sources.select("element_id").distinct().join(ring, "element_id", "left_semi").count()
    return rings


def _links(mesh: Mesh) -> DataFrame:
    return mesh.elements.select(F.col("element_id").alias("_from"), F.explode("nbe").alias("element_id")).where("element_id >= 0").distinct()


def first_wet_ring(mesh: Mesh, wet: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, near): the wet elements at the fewest steps from each dry source (element_id).

    Every shortest way runs along falling distances, so a source walks down through the rings and keeps
    only the elements of its present ring: no list of visited elements."""
    rings = wet_distances(mesh, wet, sources)
    links = _links(mesh)
    own = sources.select("element_id").distinct()
    at = own.where("false").select(F.col("element_id").alias("source"), "element_id")
    for k in range(len(rings) - 1, 0, -1):
        at = at.unionByName(own.join(rings[k], "element_id", "left_semi").select(F.col("element_id").alias("source"), "element_id"))
        down = at.withColumnRenamed("element_id", "_from").join(links, "_from").select("source", "element_id").distinct()
        at = down.join(rings[k - 1], "element_id", "left_semi")
        if k % 4 == 1:
            at = cut_lineage(at)
    return at.select("source", F.col("element_id").alias("near"))


def nearest_wet_element(points: DataFrame, mesh: Mesh, wet: DataFrame, host: str = "host", x: str = "x",
                        y: str = "y") -> DataFrame:
    """Nearest wet element of the first ring of neighbours that holds one (lowest id on ties).

    ``wet``: (element_id, wet 0/1). Distances spread from all wet elements at once and hosts walk down along
    them (``first_wet_ring``). Every point stays: on a wet host, off the
    mesh, or with no wet element in its part of the mesh its wet_host is null."""
    xc, yc = centre_columns(mesh.geographic)
    centres = element_corners(mesh).select("element_id", xc.alias("_xc"), yc.alias("_yc"))
    hosts = points.select(F.col(host).alias("element_id")).distinct()
    hits = first_wet_ring(mesh, wet, cut_lineage(hosts.join(wet.where("wet = 0").select("element_id").distinct(), "element_id", "left_semi")))
    # each distinct place of a dry host is measured once
    spots = points.select(host, x, y).distinct()
    cand = spots.join(hits, F.col(host) == F.col("source")).join(centres, F.col("near") == F.col("element_id"))
    if mesh.geographic:
        d = geo.haversine(F.radians(x), F.radians(y), F.radians("_xc"), F.radians("_yc"))
    else:
        d = geo.euclid(x, y, "_xc", "_yc")
    cand = cand.withColumn("_d", d)
    least = cand.groupBy(host, x, y).agg(F.min("_d").alias("_d"))
    best = cand.join(least, [host, x, y, "_d"]).groupBy(host, x, y).agg(F.min("near").alias("wet_host"))
    return points.join(best, [host, x, y], "left").select(*points.columns, "wet_host")
