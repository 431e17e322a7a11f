"""Coordinate and geometry expressions.

Plain Column algebra, so that they stay inside whole-stage codegen. Three-dimensional
vectors are Python triples of Columns; ``xyz`` packs one into a struct. Angles are in
radians unless a name says degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_drift.schema import EARTH_RADIUS

Vec = tuple[Column, Column, Column]
Vec2 = tuple[Column, Column]


def col(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def clamp(c: Column, lo: float, hi: float) -> Column:
    # least and greatest skip nulls, so they would turn a missing value into a bound
    return F.when(c < lo, F.lit(lo)).when(c > hi, F.lit(hi)).otherwise(c)


def xyz(v: Vec) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


# --- distances -----------------------------------------------------------------


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle angle between two points (unit sphere)."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2.0) * F.asin(clamp(F.sqrt(a), 0.0, 1.0))


def euclid(x1, y1, x2, y2) -> Column:
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return F.sqrt(dx * dx + dy * dy)


# --- vectors -------------------------------------------------------------------


def dot2(a: Vec2, b: Vec2) -> Column:
    return a[0] * b[0] + a[1] * b[1]


def dot3(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross3(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm3(a: Vec) -> Column:
    return F.sqrt(dot3(a, a))


def nonzero(c: Column) -> Column:
    """Null in place of 0, so that a division gives null and not an error."""
    return F.when(c != 0, c)


def unit3(a: Vec) -> Vec:
    n = nonzero(norm3(a))
    return (a[0] / n, a[1] / n, a[2] / n)


def det2(a: Vec2, b: Vec2) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def det3(a: Vec, b: Vec, c: Vec) -> Column:
    return dot3(a, cross3(b, c))


def stage(df: DataFrame, **vectors: Vec) -> tuple[DataFrame, list[Vec]]:
    """Keep vectors as columns of ``df`` and refer to them by name from here on.

    An expression that uses a vector many times then holds its name, not its whole formula;
    without this, chained vector algebra grows exponentially."""
    names = {n: [f"_{n}{a}" for a in "xyz"[: len(v)]] for n, v in vectors.items()}
    out = df.withColumns({c: e for n, v in vectors.items() for c, e in zip(names[n], v)})
    return out, [tuple(F.col(c) for c in names[n]) for n in vectors]


def unstage(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[f"_{n}{a}" for n in names for a in "xyz"])


def angle_between(a: Vec, b: Vec) -> Column:
    return F.acos(clamp(dot3(a, b) / nonzero(norm3(a) * norm3(b)), -1.0, 1.0))


def array_dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def array_norm(a) -> Column:
    return F.sqrt(array_dot(a, a))


def array_angle(a, b) -> Column:
    return F.acos(clamp(array_dot(a, b) / nonzero(array_norm(a) * array_norm(b)), -1.0, 1.0))


def to_unit_vector(lon, lat) -> Vec:
    lon, lat = col(lon), col(lat)
    return (F.cos(lon) * F.cos(lat), F.sin(lon) * F.cos(lat), F.sin(lat))


def to_lonlat(v: Vec) -> Vec2:
    """Longitude and latitude of a unit vector."""
    return F.atan2(v[1], v[0]), F.asin(clamp(v[2], -1.0, 1.0))


# --- rotations of the axes -------------------------------------------------------


def rotate_x(p: Vec, angle) -> Vec:
    c, s = F.cos(col(angle)), F.sin(col(angle))
    return (p[0], c * p[1] + s * p[2], c * p[2] - s * p[1])


def rotate_y(p: Vec, angle) -> Vec:
    c, s = F.cos(col(angle)), F.sin(col(angle))
    return (c * p[0] - s * p[2], p[1], s * p[0] + c * p[2])


def rotate_z(p: Vec, angle) -> Vec:
    c, s = F.cos(col(angle)), F.sin(col(angle))
    return (c * p[0] + s * p[1], c * p[1] - s * p[0], p[2])


def rotate_axes(p: Vec, lon, lat) -> Vec:
    """Into the frame at (lon, lat) with x east, y north and z outward.

    The four turns (z and x by π/2, y by lon, x by −lat) multiplied out."""
    lon, lat = col(lon), col(lat)
    sl, cl, sp, cp = F.sin(lon), F.cos(lon), F.sin(lat), F.cos(lat)
    return (
        cl * p[1] - sl * p[0],
        cp * p[2] - sp * cl * p[0] - sp * sl * p[1],
        cp * cl * p[0] + cp * sl * p[1] + sp * p[2],
    )


def reverse_rotate_axes(p: Vec, lon, lat) -> Vec:
    """Back from the frame at (lon, lat)."""
    lon, lat = col(lon), col(lat)
    sl, cl, sp, cp = F.sin(lon), F.cos(lon), F.sin(lat), F.cos(lat)
    return (
        cp * cl * p[2] - sl * p[0] - sp * cl * p[1],
        cl * p[0] - sp * sl * p[1] + cp * sl * p[2],
        cp * p[1] + sp * p[2],
    )


# --- areas -----------------------------------------------------------------------


def twice_signed_area(p1: Vec2, p2: Vec2, p3: Vec2) -> Column:
    return (p2[0] - p1[0]) * (p3[1] - p1[1]) - (p2[1] - p1[1]) * (p3[0] - p1[0])


def triangle_area(p1: Vec2, p2: Vec2, p3: Vec2) -> Column:
    return F.abs(twice_signed_area(p1, p2, p3)) / 2


def spherical_triangle_area(p1: Vec, p2: Vec, p3: Vec, r: float = EARTH_RADIUS) -> Column:
    """Spherical excess × r² from unit vectors, by the triple product: half the excess is the angle of
    (1 + p1·p2 + p2·p3 + p3·p1, |p1·(p2×p3)|). Small and flat triangles keep their digits."""
    along = F.lit(1.0) + dot3(p1, p2) + dot3(p2, p3) + dot3(p3, p1)
    return F.atan2(F.abs(det3(p1, p2, p3)), along) * F.lit(2.0 * r * r)


# --- intersections ---------------------------------------------------------------


def segment_parameter(p1: Vec2, p2: Vec2, q1: Vec2, q2: Vec2) -> tuple[Column, Column, Column]:
    """(t, u, parallel): the crossing lies at p1 + t·(p2−p1) = q1 + u·(q2−q1)."""
    r = (p2[0] - p1[0], p2[1] - p1[1])
    s = (q2[0] - q1[0], q2[1] - q1[1])
    w = (q1[0] - p1[0], q1[1] - p1[1])
    d = det2(r, s)
    return det2(w, s) / nonzero(d), det2(w, r) / nonzero(d), d == 0


def segment_intersection(p1: Vec2, p2: Vec2, q1: Vec2, q2: Vec2) -> Column:
    """Crossing point of two closed plane segments as a nullable struct<x, y>."""
    t, u, _ = segment_parameter(p1, p2, q1, q2)
    inside = t.between(0, 1) & u.between(0, 1)
    point = F.struct((p1[0] + t * (p2[0] - p1[0])).alias("x"), (p1[1] + t * (p2[1] - p1[1])).alias("y"))
    return F.when(inside, point)


def arc_intersection(p1: Vec2, p2: Vec2, q1: Vec2, q2: Vec2, tol: float = 1e-12) -> Column:
    """Crossing of two great-circle arcs given by (lon, lat) ends, as a nullable struct<x, y>.

    Each arc must meet the plane of the other, ends included within ``tol``, on the same side
    of the sphere. An arc of no length crosses nothing."""
    a, b, c, d = (to_unit_vector(*p) for p in (p1, p2, q1, q2))
    return arc_vector_intersection(a, b, c, d, tol)


def arc_vector_intersection(a: Vec, b: Vec, c: Vec, d: Vec, tol: float = 1e-12) -> Column:
    """The same for arcs given by the unit vectors of their ends."""
    n1, n2 = cross3(a, b), cross3(c, d)
    return arc_point(a, b, c, d, n1, n2, cross3(n1, n2), tol)


def arc_point(a: Vec, b: Vec, c: Vec, d: Vec, n1: Vec, n2: Vec, line: Vec, tol: float = 1e-12) -> Column:
    """Crossing of the arcs a–b and c–d from the normals of their planes and their common line."""

    def meets(n: Vec, u: Vec, v: Vec) -> Column:
        su, sv = dot3(n, u), dot3(n, v)
        return (F.least(su, sv) <= tol) & (F.greatest(su, sv) >= -tol)

    side = dot3(line, tuple(x + y for x, y in zip(a, b)))
    other = dot3(line, tuple(x + y for x, y in zip(c, d)))
    turn = F.signum(side)
    lon = F.atan2(turn * line[1], turn * line[0])
    lat = F.atan2(turn * line[2], F.sqrt(line[0] * line[0] + line[1] * line[1]))
    point = F.struct(lon.alias("x"), lat.alias("y"))
    return F.when(meets(n2, a, b) & meets(n1, c, d) & (side * other > 0), point)


def arcs_intersect(p1: Vec2, p2: Vec2, q1: Vec2, q2: Vec2) -> Column:
    return arc_intersection(p1, p2, q1, q2).isNotNull()


# --- positions -------------------------------------------------------------------


def displace(x, y, z, dx, dy, dz, cs: str = "cartesian") -> Vec:
    """Add metres to a position (radians when geographic)."""
    x, y, z, dx, dy, dz = map(col, (x, y, z, dx, dy, dz))
    if cs == "geographic":
        return (x + dx / (F.lit(EARTH_RADIUS) * F.cos(y)), y + dy / F.lit(EARTH_RADIUS), z + dz)
    return (x + dx, y + dy, z + dz)


def wrap_longitude(lon) -> Column:
    lon = col(lon)
    return F.when(lon > 180, lon - 360).otherwise(lon)


def recentre_latitude(lat, centre: float) -> Column:
    if centre not in (0, 90):
        raise ValueError("the latitude centre must be 0 or 90")
    return col(lat) - F.lit(float(centre))


def dms_to_decimal(d, m, s) -> Column:
    d, m, s = map(col, (d, m, s))
    size = F.abs(d) + F.abs(m) / 60 + F.abs(s) / 3600
    return F.when(F.least(d, m, s) < 0, -size).otherwise(size)


def wco_to_decimal(d, m, s) -> Column:
    """Degrees, minutes and hundredths of a minute."""
    d, m, s = map(col, (d, m, s))
    size = F.abs(d) + F.abs(m) / 60 + F.abs(s) / 6000
    return F.when(F.least(d, m, s) < 0, -size).otherwise(size)


# --- vertical coordinates ----------------------------------------------------------


def sigma_to_depth(sigma, h, zeta) -> Column:
    """Field form, h positive down."""
    return col(zeta) + col(sigma) * (col(zeta) + col(h))


def sigma_to_cartesian(sigma, h, zeta) -> Column:
    """Point form, h negative."""
    return col(zeta) + col(sigma) * (col(zeta) - col(h))


def depth_to_sigma(z, h, zeta) -> Column:
    return (col(z) - col(zeta)) / (col(zeta) - col(h))


def s_level_to_depth(s, cs, hc, h, zeta, vtransform: int = 2) -> Column:
    s, cs, hc, h, zeta = map(col, (s, cs, hc, h, zeta))
    if vtransform == 1:
        z0 = hc * (s - cs) + cs * h
        return z0 + zeta * (F.lit(1.0) + z0 / h)
    if vtransform == 2:
        z0 = (hc * s + cs * h) / (hc + h)
        return zeta + (zeta + h) * z0
    raise ValueError("vtransform must be 1 or 2")


def fixed_level_to_depth(depth, zeta) -> Column:
    return -col(depth) + col(zeta)


def rotate_vector(u, v, angle) -> Vec2:
    u, v, angle = map(col, (u, v, angle))
    c, s = F.cos(angle), F.sin(angle)
    return (u * c - v * s, u * s + v * c)
