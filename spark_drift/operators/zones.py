"""Release zones and their particles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_drift.functions import geo
from spark_drift.functions.projection import epsg_code, lonlat_from_utm_cols, utm_from_lonlat_cols
from spark_drift.util import join_in_blocks, one_row, shuffled, skew_safe_join, uniform

CHUNK = 4096


def explode_count(df: DataFrame, n: str, out: str) -> DataFrame:
    """Repeat each row n times with an index 0..n−1.

    Rows are cut into blocks first and the blocks spread over the cluster, so a zone that
    holds most of the particles is not built in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.where(F.col(n) > 0).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / CHUNK).cast("int"))))
    blocks = blocks.repartition(parts, "group_id", "_block")
    first = F.col("_block").cast("long") * CHUNK
    last = F.least(first + CHUNK, F.col(n).cast("long")) - 1
    return blocks.withColumn(out, F.explode(F.sequence(first, last))).drop("_block")


def create_release_zones(zones: DataFrame, cs: str = "cartesian") -> DataFrame:
    """Zones with their area; geographic centres also in UTM (code from the centre when not given)."""
    out = zones.withColumn("area", F.lit(math.pi) * F.col("radius") * F.col("radius"))
    if cs != "geographic":
        return out.withColumns({"ux": F.col("cx"), "uy": F.col("cy")})
    code = F.col("epsg").cast("int") if "epsg" in zones.columns else F.lit(None).cast("int")
    out = out.withColumn("epsg", F.coalesce(code, epsg_code("cx", "cy")))
    east, north = utm_from_lonlat_cols("cx", "cy", "epsg")
    return out.withColumns({"ux": east, "uy": north})


def zone_particles(zones: DataFrame, seed: int = 0, cs: str = "cartesian") -> DataFrame:
    """Particles of release zones: (group_id, index, x, y, z), n per zone, uniform over its disc.

    Geographic zones (centres in degrees, radii in metres) are drawn in the UTM zone of their centre
    and turned back to longitude and latitude."""
    out = create_release_zones(zones, cs)
    if cs != "geographic":
        return disc_points_random(out, seed)
    drawn = disc_points_random(out.withColumns({"cx": F.col("ux"), "cy": F.col("uy")}), seed, ["epsg"])
    lon, lat = lonlat_from_utm_cols("x", "y", "epsg")
    return drawn.select("group_id", "index", lon.alias("x"), lat.alias("y"), "z")


def disc_points_random(zones: DataFrame, seed: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly n points per zone, uniform over the disc: (group_id, index, x, y, z), and zone columns to ``keep``."""
    rows = explode_count(zones, "n", "index")
    r = F.col("radius") * F.sqrt(uniform("r", seed, F.col("group_id"), F.col("index")))
    theta = F.lit(2 * math.pi) * uniform("t", seed, F.col("group_id"), F.col("index"))
    return rows.select("group_id", "index", (F.col("cx") + r * F.cos(theta)).alias("x"),
                       (F.col("cy") + r * F.sin(theta)).alias("y"), F.col("depth").alias("z"), *keep)


def disc_points_regular(zones: DataFrame) -> DataFrame:
    """Points of the square lattice over the zone's box that lie in the disc: (group_id, i, j, x, y, z)."""
    area = F.lit(math.pi) * F.col("radius") * F.col("radius")
    delta = F.sqrt(area / F.col("n"))
    rows = zones.withColumn("_m", F.floor(F.lit(2.0) * F.col("radius") / delta).cast("int")).where("_m > 0")
    rows = explode_count(rows.withColumn("_mm", F.col("_m") * F.col("_m")), "_mm", "_id")
    rows = rows.withColumns({"i": F.pmod("_id", F.col("_m")).cast("int"), "j": F.floor(F.col("_id") / F.col("_m")).cast("int")})

    def place(c: str, index: str) -> Column:
        step = F.lit(2.0) * F.col("radius") / geo.nonzero(F.col("_m") - 1)
        inner = F.col(c) - F.col("radius") + step * F.col(index)
        last = F.when(F.col(index) == F.col("_m") - 1, F.col(c) + F.col("radius")).otherwise(inner)
        return F.when(F.col("_m") == 1, F.col(c) - F.col("radius")).otherwise(last)

    rows = rows.withColumns({"x": place("cx", "i"), "y": place("cy", "j")})
    # points on the rim count as inside, whatever the last bits of their distance
    rows = rows.where(geo.euclid("x", "y", "cx", "cy") <= F.col("radius") * F.lit(1 + 1e-9))
    return rows.select("group_id", "i", "j", "x", "y", F.col("depth").alias("z"))


def within_zone(points: DataFrame, zones: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(point, zone) for every point within the radius of a zone.

    Zones are listed in the cells their box touches at a cell side of a quarter of the power of two
    at or above their own diameter, so that few points off the disc are looked at; points are keyed once
    per scale in use. As many pairs as there are, tasks get a like share of them (``join_in_blocks``)."""
    scale = F.ceil(F.log2(F.lit(2.0) * F.col("radius"))).cast("int") - 2
    z = zones.select("group_id", "cx", "cy", "radius", scale.alias("_scale"))
    scales = one_row(z.agg(F.collect_set("_scale").alias("s")))["s"] or [0]  # a few exponents
    side = F.pow(F.lit(2.0), F.col("_scale"))
    for name, c in (("_zx", "cx"), ("_zy", "cy")):
        lo, hi = F.floor((F.col(c) - F.col("radius")) / side), F.floor((F.col(c) + F.col("radius")) / side)
        z = z.withColumn(name, F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    p = points.withColumn("_ps", F.explode(F.array(*[F.lit(int(s)) for s in sorted(scales)])))
    pside = F.pow(F.lit(2.0), F.col("_ps"))
    p = p.withColumns({"_px": F.floor(F.col(x) / pside).cast("long"), "_py": F.floor(F.col(y) / pside).cast("long")})
    p = p.withColumnsRenamed({"_ps": "_scale", "_px": "_zx", "_py": "_zy"})
    z = z.withColumnsRenamed({"group_id": "_zone", "cx": "_cx", "cy": "_cy", "radius": "_radius"})
    hits = join_in_blocks(p, z, ["_scale", "_zx", "_zy"]).where(geo.euclid(x, y, "_cx", "_cy") <= F.col("_radius"))
    return hits.select(*points.columns, F.col("_zone").alias("zone_id"))


def zones_along_line(lines: DataFrame, radius: float, cs: str = "cartesian") -> DataFrame:
    """Touching discs from (x1, y1) to (x2, y2) of each line, centred on it: ⌊L/2R⌋ per line.

    (line_id, index, cx, cy, radius); a line shorter than a diameter gives none. Geographic
    ends go through UTM in the zone of the start."""
    rows = lines
    if cs == "geographic":
        rows = rows.withColumn("_epsg", epsg_code("x1", "y1"))
        a, b = utm_from_lonlat_cols("x1", "y1", "_epsg"), utm_from_lonlat_cols("x2", "y2", "_epsg")
    else:
        a, b = (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))
    rows = rows.withColumns({"_ax": a[0], "_ay": a[1], "_bx": b[0], "_by": b[1]})
    rows = rows.withColumn("_len", geo.euclid("_ax", "_ay", "_bx", "_by"))
    d = F.lit(2.0 * radius)
    rows = rows.withColumn("_n", F.floor(F.col("_len") / d).cast("long")).where("_n > 0")
    rows = rows.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    spare = F.col("_len") - F.col("_n") * d
    along = (d * F.col("index") + F.lit(float(radius)) + spare / 2) / F.col("_len")
    cx = F.col("_ax") + along * (F.col("_bx") - F.col("_ax"))
    cy = F.col("_ay") + along * (F.col("_by") - F.col("_ay"))
    if cs == "geographic":
        rows = rows.withColumns({"_cx": cx, "_cy": cy})
        cx, cy = lonlat_from_utm_cols("_cx", "_cy", "_epsg")
    return rows.select("line_id", "index", cx.alias("cx"), cy.alias("cy"), F.lit(float(radius)).alias("radius"))


def _ring_sides(vertices: DataFrame) -> DataFrame:
    """(polygon_id, idx, x, y, xn, yn): each vertex with the next, by an equi-join on the index."""
    n = vertices.groupBy("polygon_id").agg(F.max("idx").alias("_last"))
    a = skew_safe_join(shuffled(vertices), n, ["polygon_id"]).withColumn("_next", F.when(F.col("idx") == F.col("_last"), 0).otherwise(F.col("idx") + 1))
    b = vertices.select(F.col("polygon_id").alias("_p"), F.col("idx").alias("_i"), F.col("x").alias("xn"), F.col("y").alias("yn"))
    return a.join(shuffled(b), (F.col("polygon_id") == F.col("_p")) & (F.col("_next") == F.col("_i"))).drop("_p", "_i", "_next", "_last")


def is_clockwise(vertices: DataFrame) -> DataFrame:
    """(polygon_id, clockwise) of rings (polygon_id, idx 0.., x, y) from the signed area."""
    cross = F.col("x") * F.col("yn") - F.col("xn") * F.col("y")
    return _ring_sides(vertices).groupBy("polygon_id").agg((F.sum(cross) < 0).alias("clockwise"))


def nearest_vertex(vertices: DataFrame, starts: DataFrame, tolerance: float | None = None) -> DataFrame:
    """(polygon_id, idx, distance): vertex nearest to each polygon's start (sx, sy); first on ties."""
    rows = vertices.join(shuffled(starts), "polygon_id")
    d = geo.euclid("x", "y", "sx", "sy")
    best = rows.groupBy("polygon_id").agg(F.min(F.struct(d.alias("distance"), F.col("idx"))).alias("b"))
    out = best.select("polygon_id", "b.idx", "b.distance")
    if tolerance is None:
        return out
    far = F.raise_error(F.lit("the start is further from the ring than the tolerance")).cast("double")
    return out.withColumn("distance", F.when(F.col("distance") < tolerance, F.col("distance")).otherwise(far))


def _walk_ring(xy: Sequence[Sequence[float]], start: int, clockwise: bool, spacing: float, length: float | None) -> list[tuple[float, float]]:
    """Centres on the ring, each at straight-line distance ``spacing`` from the last."""
    ring = [(float(x), float(y)) for x, y in xy]
    n = len(ring)
    step = 1 if clockwise else -1
    cx, cy = hx, hy = ring[start % n]
    centres = [(cx, cy)]
    travelled = 0.0
    for count in range(1, n + 1):
        if length is not None and travelled > length:
            break
        tx, ty = ring[(start + step * count) % n]
        sx, sy = tx - hx, ty - hy
        while math.hypot(tx - cx, ty - cy) >= spacing:
            ox, oy = hx - cx, hy - cy
            a, b, c = sx * sx + sy * sy, 2 * (ox * sx + oy * sy), ox * ox + oy * oy - spacing * spacing
            # the root nearer the end of the side: the ring leaves the circle there
            f = (-b + math.sqrt(max(b * b - 4 * a * c, 0.0))) / (2 * a)
            f = min(max(f, 0.0), 1.0)
            cx, cy = hx + f * sx, hy + f * sy
            centres.append((cx, cy))
        travelled += math.hypot(sx, sy)
        hx, hy = tx, ty
    return centres


def zones_around_polygon(vertices: DataFrame, starts: DataFrame, radius: float, target_length: float | None = None) -> DataFrame:
    """Touching discs round each ring from the vertex nearest its start: (polygon_id, index, cx, cy, radius).

    Each centre depends on the one before, so a ring is one row (an outline) that one task walks; tasks walk
    many rings, however few bytes these are. Stops after one turn or ``target_length``."""
    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = nearest_vertex(vertices, starts).select("polygon_id", F.col("idx").alias("start"))
    gap = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    corner = F.struct(F.col("idx").isNull().alias("_last"), "idx", gap("x"), gap("y"))
    # dealt by number, or adaptive execution puts rings of few bytes into few tasks
    rings = vertices.repartition(parts, "polygon_id").groupBy("polygon_id").agg(F.array_sort(F.collect_list(corner)).alias("_ring"))
    rings = rings.join(shuffled(first), "polygon_id").join(shuffled(is_clockwise(vertices)), "polygon_id")
    rings = rings.select("polygon_id", "start", "clockwise", F.col("_ring.x").alias("xs"), F.col("_ring.y").alias("ys"))

    def walk(batches):
        for pdf in batches:
            rows = [_walk_ring(list(zip(xs, ys)), int(s), bool(c), 2 * radius, target_length)
                    for xs, ys, s, c in zip(pdf["xs"], pdf["ys"], pdf["start"], pdf["clockwise"])]
            yield pd.DataFrame({"polygon_id": pdf["polygon_id"], "xs": [[p[0] for p in r] for r in rows], "ys": [[p[1] for p in r] for r in rows]})

    kind = dict(vertices.dtypes)["polygon_id"]
    walked = rings.mapInPandas(walk, f"polygon_id {kind}, xs array<double>, ys array<double>")
    out = walked.select("polygon_id", F.posexplode(F.arrays_zip("xs", "ys")).alias("index", "_c"))
    return out.select("polygon_id", F.col("index").cast("long").alias("index"), F.col("_c.xs").alias("cx"), F.col("_c.ys").alias("cy"), F.lit(float(radius)).alias("radius"))


def zone_overlaps(zones: DataFrame, tol: float = 0.0) -> DataFrame:
    """(a, b, overlap) for zone pairs that overlap by more than ``tol`` (from 0) of the touching distance.

    Zones lie in the cells their box touches at a cell side of the power of two at or above their
    own diameter, and look into the cells they touch at every larger side in use: a pair meets at
    the side of its larger zone, and one wide zone does not bring all others together. It counts in the
    first cell that both touch alone, and tasks get a like share of the pairs (``join_in_blocks``)."""
    scale = F.ceil(F.log2(F.greatest(F.lit(2.0) * F.col("radius"), F.lit(1e-9)))).cast("int")
    rows = zones.select("group_id", "cx", "cy", "radius", scale.alias("_own"))
    repeated = bool(rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1))
    scales = sorted(one_row(rows.agg(F.collect_set("_own").alias("s")))["s"] or [0])  # a few exponents

    def cells(df: DataFrame) -> DataFrame:
        side = F.pow(F.lit(2.0), F.col("_scale"))
        for name, c in (("_i", "cx"), ("_j", "cy")):
            lo, hi = F.floor((F.col(c) - F.col("radius")) / side), F.floor((F.col(c) + F.col("radius")) / side)
            df = df.withColumn(f"_lo{name}", lo.cast("long"))
            df = df.withColumn(name, F.explode(F.sequence(F.col(f"_lo{name}"), hi.cast("long"))))
        return df

    wide = cells(rows.withColumn("_scale", F.col("_own")))
    every = F.filter(F.array(*[F.lit(int(s)) for s in scales]), lambda s: s >= F.col("_own"))
    small = cells(rows.withColumn("_scale", F.explode(every))).withColumnsRenamed({"group_id": "a", "cx": "ax", "cy": "ay", "radius": "ar", "_own": "_small", "_lo_i": "_from_i", "_lo_j": "_from_j"})
    pairs = join_in_blocks(small, wide, ["_scale", "_i", "_j"])
    pairs = pairs.where((F.col("_i") == F.greatest("_lo_i", "_from_i")) & (F.col("_j") == F.greatest("_lo_j", "_from_j")))
    pairs = pairs.where((F.col("_small") < F.col("_own")) | ((F.col("_small") == F.col("_own")) & (F.col("a") < F.col("group_id"))))
    touch = F.col("ar") + F.col("radius")
    pairs = pairs.withColumn("overlap", (touch - geo.euclid("ax", "ay", "cx", "cy")) / touch).where(F.col("overlap") > tol)
    pairs = pairs.select(F.least("a", "group_id").alias("a"), F.greatest("a", "group_id").alias("b"), "overlap")
    return pairs.distinct() if repeated else pairs  # only zones that share an id give equal rows


def _hull(xy: np.ndarray) -> np.ndarray:
    """Convex hull, anticlockwise from the lowest left point (monotone chain)."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        chain: list[np.ndarray] = []
        for p in seq:
            while len(chain) > 1:
                u, v = chain[-1] - chain[-2], p - chain[-2]
                one, two = u[0] * v[1], u[1] * v[0]
                if one - two > 1e-12 * (abs(one) + abs(two)):  # on a line up to rounding: no corner
                    break
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def zone_hull(points: DataFrame, salts: int = 64) -> DataFrame:
    """(group_id, idx, x, y): convex hull of each group.

    Only the lowest and highest point of each x can be corners; an aggregate leaves those. The hull
    of a group is the hull of the hulls of its parts: each batch is reduced where it lies, then
    parts of a group, then the group, so a hot group never meets in one task. Points on a line
    between corners, up to rounding, are none."""
    rows = points.select("group_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = rows.groupBy("group_id", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    rows = rows.select("group_id", "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"))
    kind = dict(rows.dtypes)["group_id"]

    def reduce_batch(batches):
        for pdf in batches:
            for g, part in pdf.groupby("group_id", sort=False):
                h = _hull(part[["x", "y"]].to_numpy())
                yield pd.DataFrame({"group_id": g, "x": h[:, 0], "y": h[:, 1]})

    def reduce_group(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"group_id": pdf["group_id"].iloc[0], "idx": range(len(h)), "x": h[:, 0], "y": h[:, 1]})

    schema = f"group_id {kind}, x double, y double"
    part = rows.mapInPandas(reduce_batch, schema).withColumn("_s", F.pmod(F.hash("x", "y"), F.lit(salts)))
    small = f"group_id {kind}, idx long, x double, y double"
    merged = part.groupBy("group_id", "_s").applyInPandas(lambda p: reduce_group(p), small)
    return merged.groupBy("group_id").applyInPandas(reduce_group, small)


def zone_counts(points: DataFrame) -> DataFrame:
    """(group_id, n): particles per zone, and in total where group_id is null."""
    return points.rollup("group_id").agg(F.count(F.lit(1)).alias("n"))
