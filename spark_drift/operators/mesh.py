"""Triangle meshes as node and element tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_drift.functions import geo
from spark_drift.schema import BOUNDARY, EARTH_RADIUS, LAND, SEA, Mesh
from spark_drift.util import one_row, shuffled

# (from, to) vertex positions of the side that lies opposite vertex 0, 1, 2.
SIDE_ENDS = ((1, 2), (2, 0), (0, 1))


def lattice_mesh(lons: DataFrame, lats: DataFrame, geographic: bool = False, idx: str = "idx",
                 value: str = "v") -> Mesh:
    """Triangle mesh over a lon × lat lattice; node id = lon index · n_lat + lat index.

    The axes are tables (idx 0..n−1, v, further columns that the nodes keep). Nodes are
    numbered by a range and looked up in each axis, so no side is crossed with the other.
    Each cell is cut from lower left to upper right, vertices clockwise. On the sphere,
    polar rows at either end of the latitude axis are dropped."""
    if geographic:
        polar_first = one_row(lats.agg(F.count_if((F.col(idx) == 0) & (F.abs(F.col(value)) == 90)).alias("n")))["n"]
        lats = lats.where(F.abs(F.col(value)) != 90).withColumn(idx, F.col(idx) - F.lit(polar_first))
    n_lon, n_lat = lons.count(), lats.count()
    spark = lons.sparkSession
    ids = spark.range(n_lon * n_lat).select(
        F.col("id").alias("node_id"),
        F.floor(F.col("id") / n_lat).cast("long").alias("lon_index"),
        F.pmod("id", F.lit(n_lat)).alias("lat_index"),
    )
    x_axis = lons.withColumnsRenamed({idx: "lon_index", value: "x"})
    y_axis = lats.withColumnsRenamed({idx: "lat_index", value: "y"})
    nodes = ids.join(x_axis, "lon_index").join(y_axis, "lat_index")
    if geographic:
        nodes = nodes.withColumn("x", geo.wrap_longitude("x"))

    rows, cols = n_lon - 1, n_lat - 1
    cell = spark.range(rows * cols).select(
        F.col("id"), F.floor(F.col("id") / cols).cast("long").alias("i"), F.pmod("id", F.lit(cols)).alias("j")
    )
    a = F.col("i") * n_lat + F.col("j")
    b, c, d = a + n_lat, a + 1, a + n_lat + 1
    lower, upper = F.col("id") * 2, F.col("id") * 2 + 1

    def inside(condition: Column, element: Column) -> Column:
        return F.when(condition, element).otherwise(F.lit(-1)).cast("long")

    first = F.struct(
        lower.alias("element_id"),
        F.array(a, d, b).alias("nv"),
        F.array(inside(F.col("i") < rows - 1, (F.col("id") + cols) * 2 + 1),
                inside(F.col("j") > 0, (F.col("id") - 1) * 2 + 1), upper).alias("nbe"),
    )
    second = F.struct(
        upper.alias("element_id"),
        F.array(a, c, d).alias("nv"),
        F.array(inside(F.col("j") < cols - 1, (F.col("id") + 1) * 2), lower,
                inside(F.col("i") > 0, (F.col("id") - cols) * 2)).alias("nbe"),
    )
    elements = cell.select(F.explode(F.array(first, second)).alias("e")).select("e.*")
    return Mesh(nodes, elements, "geographic" if geographic else "cartesian")


def attach_nodes(elements: DataFrame, nodes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add node columns of the three vertices: {'x': 'x'} gives x0, x1, x2."""
    out = elements
    for k in range(3):
        side = nodes.select(F.col("node_id").alias("_n"), *[F.col(c).alias(f"{name}{k}") for c, name in columns.items()])
        out = out.withColumn("_k", F.col("nv")[k]).join(shuffled(side), F.col("_k") == F.col("_n")).drop("_k", "_n")
    return out


def prepare_mesh(mesh: Mesh) -> Mesh:
    """The mesh with corner positions (and node masks m0..m2) kept on the element table.

    Write the result and read it back: every later operator then reads elements alone,
    without looking up their nodes again."""
    columns = {"x": "x", "y": "y"}
    if "mask" in mesh.nodes.columns:
        columns["mask"] = "m"
    bare = mesh.elements.drop(*[f"{c}{k}" for c in ("x", "y", "m") for k in range(3)])
    return Mesh(mesh.nodes, attach_nodes(bare, mesh.nodes, columns), mesh.cs)


def element_corners(mesh: Mesh) -> DataFrame:
    """Elements with their corner positions x0, y0 … x2, y2 in mesh units."""
    if "x0" in mesh.elements.columns:
        return mesh.elements
    return attach_nodes(mesh.elements, mesh.nodes, {"x": "x", "y": "y"})


def element_masks(mesh: Mesh) -> DataFrame:
    """Elements with the masks of their corners m0..m2."""
    if "m0" in mesh.elements.columns:
        return mesh.elements
    return attach_nodes(mesh.elements, mesh.nodes, {"mask": "m"})


def corner_vectors(geographic: bool) -> list[geo.Vec]:
    """Corner positions as 3-vectors: unit vectors on the sphere, (x, y, 0) in the plane."""
    if geographic:
        return [geo.to_unit_vector(F.radians(F.col(f"x{k}")), F.radians(F.col(f"y{k}"))) for k in range(3)]
    return [(F.col(f"x{k}"), F.col(f"y{k}"), F.lit(0.0)) for k in range(3)]


def _signed(geographic: bool) -> Column:
    """Positive when the vertices run anticlockwise."""
    p = corner_vectors(geographic)
    if geographic:
        return geo.det3(*p)
    return geo.twice_signed_area(p[0][:2], p[1][:2], p[2][:2])


def orient_elements(mesh: Mesh, clockwise: bool = True) -> Mesh:
    """Swap the last two vertices (and neighbour slots) of elements that run the wrong way."""
    corners = element_corners(mesh)
    signed = _signed(mesh.geographic)
    wrong = signed > 0 if clockwise else signed < 0

    def swap(name: str) -> Column:
        return F.when(wrong, F.array(F.col(name)[0], F.col(name)[2], F.col(name)[1])).otherwise(F.col(name))

    columns = {n: swap(n) for n in ("nv", "nbe") if n in mesh.elements.columns}
    return Mesh(mesh.nodes, corners.withColumns(columns).select(*mesh.elements.columns), mesh.cs)


def element_sides(elements: DataFrame) -> DataFrame:
    """(element_id, slot, na, nb, lo, hi): the three sides, slot k opposite vertex k."""
    sides = [
        F.struct(F.lit(k).alias("slot"), F.col("nv")[i].alias("na"), F.col("nv")[j].alias("nb"))
        for k, (i, j) in enumerate(SIDE_ENDS)
    ]
    rows = elements.select("element_id", F.explode(F.array(*sides)).alias("s")).select("element_id", "s.*")
    return rows.withColumns({"lo": F.least("na", "nb"), "hi": F.greatest("na", "nb")})


def element_neighbours(elements: DataFrame) -> DataFrame:
    """Element table with ``nbe`` from shared sides; −1 where there is none.

    A side belongs to one or two elements, so one aggregation per side replaces a self join:
    each shared side yields both directions."""
    sides = element_sides(elements)
    shared = sides.groupBy("lo", "hi").agg(
        F.min("element_id").alias("a"), F.max("element_id").alias("b"),
        F.min_by("slot", "element_id").alias("sa"), F.max_by("slot", "element_id").alias("sb"),
    )
    other = lambda e, n: F.when(F.col("a") != F.col("b"), F.col(n)).otherwise(F.lit(-1).cast("long"))
    both = F.array(
        F.struct(F.col("a").alias("element_id"), F.col("sa").alias("slot"), other("a", "b").alias("nb")),
        F.struct(F.col("b").alias("element_id"), F.col("sb").alias("slot"), other("b", "a").alias("nb")),
    )
    rows = shared.select(F.explode(both).alias("r")).select("r.*")
    slots = rows.groupBy("element_id").agg(
        *[F.max(F.when(F.col("slot") == k, F.col("nb"))).alias(f"b{k}") for k in range(3)]
    )
    out = elements.drop("nbe").join(slots, "element_id")
    return out.withColumn("nbe", F.array("b0", "b1", "b2")).drop("b0", "b1", "b2")


def element_areas(mesh: Mesh, radius: float = EARTH_RADIUS) -> DataFrame:
    a, b, c = corner_vectors(mesh.geographic)
    corners, p = geo.stage(element_corners(mesh), v0=a, v1=b, v2=c)
    if mesh.geographic:
        area = geo.spherical_triangle_area(*p, r=radius)
    else:
        area = geo.triangle_area(p[0][:2], p[1][:2], p[2][:2])
    return corners.select(*mesh.elements.columns, area.alias("area"))


def centre_columns(geographic: bool) -> tuple[Column, Column]:
    """Element centre from the corner columns, in mesh units."""
    p = corner_vectors(geographic)
    mean = tuple((p[0][i] + p[1][i] + p[2][i]) / 3 for i in range(3))
    if geographic:
        lon, lat = geo.to_lonlat(geo.unit3(mean))
        return F.degrees(lon), F.degrees(lat)
    return mean[0], mean[1]


def element_midpoints(mesh: Mesh) -> DataFrame:
    """Mean of the corners; on the sphere the mean unit vector, renormalised."""
    xc, yc = centre_columns(mesh.geographic)
    return element_corners(mesh).select(*mesh.elements.columns, xc.alias("xc"), yc.alias("yc"))


def element_mask(elements: DataFrame, nodes: DataFrame, allowed: int = 2, land_value: int = LAND) -> DataFrame:
    """SEA without masked vertices, BOUNDARY with up to ``allowed``, LAND beyond."""
    if allowed not in (0, 1, 2):
        raise ValueError("allowed masked vertices must be 0, 1 or 2")
    masked = F.col("_m0") + F.col("_m1") + F.col("_m2")
    value = F.when(masked == 0, SEA).when(masked <= allowed, BOUNDARY).otherwise(land_value)
    return attach_nodes(elements, nodes, {"mask": "_m"}).withColumn("mask_c", value.cast("int")).drop("_m0", "_m1", "_m2")


def mask_two_boundary(elements: DataFrame, land_value: int = LAND) -> DataFrame:
    """A sea element with exactly two land neighbours becomes land, in one simultaneous pass."""
    links = elements.where(F.col("mask_c") == SEA).select("element_id", F.explode("nbe").alias("nb")).where("nb >= 0")
    land = elements.where(F.col("mask_c") == land_value).select(F.col("element_id").alias("nb"))
    turned = links.join(land, "nb", "left_semi").groupBy("element_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2")
    out = elements.join(turned, "element_id", "left")
    return out.withColumn("mask_c", F.when(F.col("_n") == 2, land_value).otherwise(F.col("mask_c")).cast("int")).drop("_n")


def mask_two_land_sides(elements: DataFrame, land_value: int = LAND) -> DataFrame:
    """An element with exactly two sides without a neighbour is land."""
    open_sides = F.size(F.filter("nbe", lambda e: e == -1))
    return elements.withColumn("mask_c", F.when(open_sides == 2, land_value).otherwise(SEA).cast("int"))


def flag_open_boundary(elements: DataFrame, ob_nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Side slots without neighbour whose two nodes both lie on the open boundary become −2.

    Only elements with exactly two open-boundary nodes are flagged."""
    corners = elements.select("element_id", F.posexplode("nv").alias("slot", "n"))
    hits = corners.join(ob_nodes.select(F.col(node).alias("n")).distinct(), "n", "left_semi")
    slots = hits.groupBy("element_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("slot").alias("_s"))
    # the slots of an element add up to 3, so the vertex that is not on the boundary is 3 − sum
    slots = slots.where("_n = 2").select("element_id", (F.lit(3) - F.col("_s")).cast("int").alias("_third"))
    out = elements.join(slots, "element_id", "left")
    flagged = F.transform("nbe", lambda e, i: F.when((i == F.col("_third")) & (e == -1), F.lit(-2).cast("long")).otherwise(e))
    return out.withColumn("nbe", F.when(F.col("_third").isNull(), F.col("nbe")).otherwise(flagged)).drop("_third")


def open_lattice_boundary(elements: DataFrame, is_global: bool = False) -> DataFrame:
    """Lattice meshes: every missing neighbour is open. A global mesh may have none."""
    if is_global:
        flag = F.when(F.array_contains("nbe", F.lit(-1).cast("long")),
                      F.raise_error(F.lit("a global mesh has an element without a neighbour")).cast("array<bigint>"))
        return elements.withColumn("nbe", flag.otherwise(F.col("nbe")))
    return elements.withColumn("nbe", F.transform("nbe", lambda e: F.when(e == -1, F.lit(-2).cast("long")).otherwise(e)))


def mask_by_points(mesh: Mesh, points: DataFrame, mask: str = "mask", land_value: int = LAND) -> DataFrame:
    """Every masked point masks its host element and the neighbour opposite its smallest φ."""
    from spark_drift.operators.locate import locate_points

    bare = Mesh(mesh.nodes, mesh.elements.drop("mask_c"), mesh.cs)
    found = locate_points(points.where(F.col(mask) == 1), bare).where("host is not null")
    smallest = F.least("phi0", "phi1", "phi2")
    slot = F.when(F.col("phi0") == smallest, 0).when(F.col("phi1") == smallest, 1).otherwise(2)
    hosts = found.groupBy("host", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    pairs = mesh.elements.join(hosts, F.col("element_id") == F.col("host"))
    hit = pairs.select(F.explode(F.array("host", F.expr("nbe[slot]"))).alias("element_id")).where("element_id >= 0").distinct()
    out = mesh.elements.drop("mask_c").join(hit.withColumn("_hit", F.lit(1)), "element_id", "left")
    return out.withColumn("mask_c", F.when(F.col("_hit") == 1, land_value).otherwise(SEA).cast("int")).drop("_hit")


def bathymetry_from_mask(fields: DataFrame, levels: DataFrame) -> DataFrame:
    """(node_id, h): depth of the last unmasked level; 0 where all levels are masked."""
    deepest = fields.groupBy("node_id").agg(F.max(F.when(F.col("value").isNotNull(), F.col("level"))).alias("level"))
    out = deepest.join(levels.select("level", "depth"), "level", "left")
    return out.select("node_id", F.coalesce("depth", F.lit(0.0)).alias("h"))


def node_mask_from_field(fields: DataFrame) -> DataFrame:
    """(node_id, mask): 1 where the top level of the first time is masked."""
    first = one_row(fields.agg(F.min("time").alias("t")))["t"]
    top = fields.where((F.col("time") == F.lit(str(first)).cast("timestamp_ntz")) & (F.col("level") == 0))
    return top.select("node_id", F.col("value").isNull().cast("int").alias("mask"))


def invert_mask(df: DataFrame, mask: str = "mask") -> DataFrame:
    return df.withColumn(mask, (F.lit(1) - F.col(mask)).cast("int"))


def level_interfaces(layers: DataFrame, by: Sequence[str] = (), level: str = "level", sigma: str = "sigma") -> DataFrame:
    """Interfaces of σ layers: 0 on top, −1 at the bottom, the mean of adjacent layers between."""
    w = Window.partitionBy(*by).orderBy(level) if by else Window.orderBy(level)
    rows = layers.select(*by, F.col(level).alias("_k"), F.col(sigma).alias("_s"), F.lag(sigma).over(w).alias("_above"),
                         F.lead(sigma).over(w).isNull().alias("_last"))
    upper = F.struct(F.col("_k").alias("k"), F.coalesce((F.col("_above") + F.col("_s")) / 2, F.lit(0.0)).alias("s"))
    bottom = F.struct((F.col("_k") + 1).cast("int").alias("k"), F.lit(-1.0).alias("s"))
    out = rows.select(*by, F.explode(F.when(F.col("_last"), F.array(upper, bottom)).otherwise(F.array(upper))).alias("p"))
    return out.select(*by, F.col("p.k").cast("int").alias(level), F.col("p.s").alias(sigma))


def close_interfaces(interfaces: DataFrame, by: Sequence[str] = (), level: str = "level", sigma: str = "sigma") -> DataFrame:
    """Given interfaces with the ends forced to 0 and −1."""
    w = Window.partitionBy(*by)
    k = F.col(level)
    ends = F.when(k == F.min(level).over(w), F.lit(0.0)).when(k == F.max(level).over(w), F.lit(-1.0))
    return interfaces.withColumn(sigma, F.coalesce(ends, F.col(sigma)))


def _unstagger(df: DataFrame, line: Sequence[str], index: str, value: str) -> DataFrame:
    """Mean of adjacent points along one grid line; ends extrapolated; 0 and gaps are missing.

    Each output point k needs inputs k−1 and k (ends reach three outputs inward). Only
    neighbours on the line meet: rows go to the outputs they feed, then one sum per output."""
    v = F.when(F.col(value) != 0, F.col(value))
    n = df.groupBy(*line).agg((F.max(index) + 1).alias("_n"))
    rows = df.withColumn("_v", v).join(n, list(line))
    k, m = F.col(index), F.col("_n")
    feed = lambda to, weight, when: F.when(when, F.struct(to.cast("int").alias("k"), F.lit(weight).alias("w")))
    inner = [feed(k, 0.5, k >= 1), feed(k + 1, 0.5, k < m - 1)]
    # out[0] = o1 + o2 − o3 = (i0+i1)/2 + (i1+i2)/2 − (i2+i3)/2;  out[n] = 2·o[n−1] − o[n−2]
    start = [feed(F.lit(0), w, k == i) for i, w in enumerate((0.5, 1.0, 0.0, -0.5))]
    end = [feed(m, w, k == m - 1 - i) for i, w in enumerate((1.0, 0.5, -0.5))]
    fed = rows.select(*line, "_v", F.explode(F.filter(F.array(*inner, *start, *end), lambda s: s.isNotNull())).alias("s"))
    total = F.sum(F.col("_v") * F.col("s.w"))
    whole = F.count("_v") == F.count(F.lit(1))
    out = fed.groupBy(*line, F.col("s.k").alias(index)).agg(F.when(whole, total).alias(value))
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def unstagger_u(df: DataFrame, line: Sequence[str], index: str = "x_index", value: str = "value") -> DataFrame:
    """Staggered u to cell centres along the last axis; ``line`` names the other axes."""
    return _unstagger(df, line, index, value)


def unstagger_v(df: DataFrame, line: Sequence[str], index: str = "y_index", value: str = "value") -> DataFrame:
    return _unstagger(df, line, index, value)


def permute_nodes(df: DataFrame, permutation: DataFrame, node: str = "node_id") -> DataFrame:
    """Replace node ids by their place in a stored permutation (place, node_id)."""
    return df.join(shuffled(permutation.select(F.col(node), F.col("place"))), node).withColumn(node, F.col("place")).drop("place")
