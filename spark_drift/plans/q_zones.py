"""Queries: release zones and seeds."""

from pyspark.sql import functions as F

from spark_drift.functions import projection as proj
from spark_drift.operators import seeds as seed_ops
from spark_drift.operators import zones as ops
from spark_drift.plans.registry import query, rd
from spark_drift.plans.tables import SHARED

C = F.col

# uniform draw from the first eight hex digits of an md5
U = "(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def draw(*parts: str) -> str:
    return U.format(key=" || '|' || ".join(parts))


@query("disc_points_random", f"""
    SELECT group_id, i AS index, round(cx + radius * sqrt({draw("'r'", "'7'", 'group_id', 'i')}) * cos(2 * pi() * {draw("'t'", "'7'", 'group_id', 'i')}), 6) + 0.0 AS x,
      round(cy + radius * sqrt({draw("'r'", "'7'", 'group_id', 'i')}) * sin(2 * pi() * {draw("'t'", "'7'", 'group_id', 'i')}), 6) + 0.0 AS y, depth AS z
    FROM zones, LATERAL (SELECT unnest(range(n)) AS i) r""")
def disc_points_random(t):
    return ops.disc_points_random(t.table("zones"), 7).select("group_id", "index", rd("x").alias("x"), rd("y").alias("y"), "z")


@query("disc_points_regular", """
    WITH m AS (SELECT *, CAST(floor(2 * radius / sqrt(pi() * radius * radius / n)) AS INT) AS m FROM zones),
    p AS (SELECT group_id, i, j, cx, cy, radius, cx - radius + 2 * radius / (m - 1) * i AS x, cy - radius + 2 * radius / (m - 1) * j AS y, depth
      FROM m, LATERAL (SELECT CAST(unnest(range(m)) AS INT) AS i) a, LATERAL (SELECT CAST(unnest(range(m)) AS INT) AS j) b)
    SELECT group_id, i, j, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, depth AS z FROM p WHERE sqrt(pow(x - cx, 2) + pow(y - cy, 2)) <= radius * (1 + 1e-9)""")
def disc_points_regular(t):
    return ops.disc_points_regular(t.table("zones")).select("group_id", "i", "j", rd("x").alias("x"), rd("y").alias("y"), "z")


@query("within_zone", """
    SELECT p.point_id, z.group_id AS zone_id FROM points p JOIN zones z ON p.x BETWEEN cx - radius AND cx + radius AND p.y BETWEEN cy - radius AND cy + radius
    WHERE sqrt(pow(p.x - cx, 2) + pow(p.y - cy, 2)) <= radius""")
def within_zone(t):
    return ops.within_zone(t.points, t.table("zones")).select("point_id", "zone_id")


@query("create_release_zones", """
    SELECT group_id, round(pi() * radius * radius, 6) + 0.0 AS area, CAST(CASE WHEN cy - 5 >= 0 THEN 32600 ELSE 32700 END + floor((cx - 4 + 180) / 6) + 1 AS INT) AS epsg FROM zones""")
def create_release_zones(t):
    z = t.table("zones").withColumns({"cx": C("cx") - 4, "cy": C("cy") - 5})
    return ops.create_release_zones(z, "geographic").select("group_id", rd("area").alias("area"), "epsg")


def _series(coefficients, a, b):
    """Terms of the projection's series: coefficient · a(2j·x) · b(2j·y)."""
    return "".join(f" + ({c!r}) * {a}({2 * j + 2} * x0) * {b}({2 * j + 2} * y0)" for j, c in enumerate(coefficients))


TM = proj._NORTH
SCALE = repr(TM.k0 * TM.radius)

# centres to UTM, draws in metres, and back to degrees, with the projection's fixed coefficients
@query("zone_particles", f"""
    WITH z AS (SELECT group_id, cx - 4 AS lon, cy - 5 AS lat, radius * 1000 AS radius, n, depth, floor((cx - 4 + 180) / 6) + 1 AS zone, CASE WHEN cy - 5 >= 0 THEN 0 ELSE 1e7 END AS shift FROM zones),
    a AS (SELECT *, radians(lon) - radians(zone * 6 - 183) AS d, sinh(atanh(sin(radians(lat))) - {TM.e!r} * atanh({TM.e!r} * sin(radians(lat)))) AS t FROM z),
    b AS (SELECT *, atan2(t, cos(d)) AS x0, atanh(sin(d) / sqrt(t * t + 1)) AS y0 FROM a),
    c AS (SELECT group_id, radius, n, depth, zone, {TM.fe!r} + {SCALE} * (y0{_series(TM.alpha, 'cos', 'sinh')}) AS ux, {TM.fn!r} + {SCALE} * (x0{_series(TM.alpha, 'sin', 'cosh')}) AS uy FROM b),
    p AS (SELECT group_id, i, depth, zone, ux + radius * sqrt({draw("'r'", "'3'", 'group_id', 'i')}) * cos(2 * pi() * {draw("'t'", "'3'", 'group_id', 'i')}) AS e,
      uy + radius * sqrt({draw("'r'", "'3'", 'group_id', 'i')}) * sin(2 * pi() * {draw("'t'", "'3'", 'group_id', 'i')}) AS n FROM c, LATERAL (SELECT unnest(range(n)) AS i) r),
    q AS (SELECT *, (n - {TM.fn!r}) / {SCALE} AS x0, (e - {TM.fe!r}) / {SCALE} AS y0 FROM p),
    r AS (SELECT *, x0{_series([-v for v in TM.beta], 'sin', 'cosh')} AS xi, y0{_series([-v for v in TM.beta], 'cos', 'sinh')} AS eta FROM q),
    s AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM r)
    SELECT group_id, i AS index, round(degrees(radians(zone * 6 - 183) + atan2(sinh(eta), cos(xi))), 6) + 0.0 AS x,
      round(degrees(chi{"".join(f" + ({v!r}) * sin({2 * j + 2} * chi)" for j, v in enumerate(TM.delta))}), 6) + 0.0 AS y, depth AS z FROM s""")
def zone_particles(t):
    z = t.table("zones").withColumns({"cx": C("cx") - 4, "cy": C("cy") - 5, "radius": C("radius") * 1000})
    return ops.zone_particles(z, 3, "geographic").select("group_id", "index", rd("x").alias("x"), rd("y").alias("y"), "z")


SHARED["lines"] = """
    SELECT o_orderkey AS line_id, CAST(o_orderkey % 97 AS DOUBLE) AS x1, CAST(o_orderkey % 89 AS DOUBLE) AS y1,
      CAST(o_custkey % 83 AS DOUBLE) + CAST(0.317 AS DOUBLE) AS x2, CAST(o_custkey % 79 AS DOUBLE) + CAST(0.719 AS DOUBLE) AS y2 FROM orders"""


@query("zones_along_line", """
    WITH l AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM lines), n AS (SELECT *, CAST(floor(len / 14) AS BIGINT) AS n FROM l)
    SELECT line_id, i AS index, round(x1 + (x2 - x1) * (14 * i + 7 + (len - 14 * n) / 2) / len, 6) + 0.0 AS cx,
      round(y1 + (y2 - y1) * (14 * i + 7 + (len - 14 * n) / 2) / len, 6) + 0.0 AS cy, 7.0::DOUBLE AS radius
    FROM n, LATERAL (SELECT unnest(range(n)) AS i) r""")
def zones_along_line(t):
    return ops.zones_along_line(t.table("lines"), 7.0).select("line_id", "index", rd("cx").alias("cx"), rd("cy").alias("cy"), "radius")


# rings of 12 vertices per supplier, anticlockwise for even keys
SHARED["rings"] = """
    SELECT polygon_id, idx, cx + r * cos(a) AS x, cy + r * sin(a) AS y FROM (
      SELECT s_suppkey AS polygon_id, CAST(k AS INT) AS idx, CAST(s_suppkey % 50 AS DOUBLE) AS cx, CAST(s_suppkey % 30 AS DOUBLE) AS cy,
        CAST(3 AS DOUBLE) + CAST((s_suppkey * 7 + k * 5) % 10 AS DOUBLE) / 7 AS r,
        (CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END) * CAST(k AS DOUBLE) * pi() / 6 AS a
      FROM (SELECT s_suppkey, KLIST(12) AS k FROM supplier) s) q"""
SHARED["starts"] = "SELECT s_suppkey AS polygon_id, CAST(s_suppkey % 50 AS DOUBLE) + 2 AS sx, CAST(s_suppkey % 30 AS DOUBLE) - 3 AS sy FROM supplier"


@query("zones_around_polygon")
def zones_around_polygon(t):
    out = ops.zones_around_polygon(t.table("rings"), t.table("starts"), 0.8)
    return out.select("polygon_id", "index", rd("cx").alias("cx"), rd("cy").alias("cy"), "radius")


@query("is_clockwise", """
    SELECT polygon_id, sum(x * yn - xn * y) < 0 AS clockwise FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS xn,
      coalesce(lead(y) OVER w, first_value(y) OVER w) AS yn FROM rings WINDOW w AS (PARTITION BY polygon_id ORDER BY idx)) q GROUP BY 1""")
def is_clockwise(t):
    return ops.is_clockwise(t.table("rings"))


@query("nearest_vertex", """
    SELECT polygon_id, idx, round(d, 6) + 0.0 AS distance FROM (SELECT r.polygon_id, idx, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS d,
      row_number() OVER (PARTITION BY r.polygon_id ORDER BY sqrt(pow(x - sx, 2) + pow(y - sy, 2)), idx) AS rn FROM rings r JOIN starts USING (polygon_id)) q WHERE rn = 1""")
def nearest_vertex(t):
    return ops.nearest_vertex(t.table("rings"), t.table("starts"), 50.0).select("polygon_id", "idx", rd("distance").alias("distance"))


@query("zone_overlaps", """
    SELECT a.group_id AS a, b.group_id AS b, round((a.radius + b.radius - sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) / (a.radius + b.radius), 6) + 0.0 AS overlap
    FROM zones a JOIN zones b ON a.group_id < b.group_id
    WHERE (a.radius + b.radius - sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) / (a.radius + b.radius) > 0.05""")
def zone_overlaps(t):
    return ops.zone_overlaps(t.table("zones"), 0.05).select("a", "b", rd("overlap").alias("overlap"))


# the lower and the upper chain by exact integer cross products: fixes lie on a grid of tenths
@query("zone_hull", """
    WITH e AS (SELECT group_id, x, min(y) AS lo, max(y) AS hi, CAST(round((x - 0.013721357) * 10) AS BIGINT) AS i,
        min(CAST(round((y - 0.007193751) * 10) AS BIGINT)) AS a, max(CAST(round((y - 0.007193751) * 10) AS BIGINT)) AS b FROM fixes GROUP BY group_id, x),
    g AS (SELECT group_id, min(i) AS i0, max(i) AS i1 FROM e GROUP BY 1),
    below AS (SELECT DISTINCT p.group_id, p.i FROM e p JOIN e l ON l.group_id = p.group_id AND l.i < p.i JOIN e r ON r.group_id = p.group_id AND r.i > p.i
      WHERE (p.i - l.i) * (r.a - l.a) - (p.a - l.a) * (r.i - l.i) <= 0),
    above AS (SELECT DISTINCT p.group_id, p.i FROM e p JOIN e l ON l.group_id = p.group_id AND l.i < p.i JOIN e r ON r.group_id = p.group_id AND r.i > p.i
      WHERE (p.i - l.i) * (r.b - l.b) - (p.b - l.b) * (r.i - l.i) >= 0),
    c AS (SELECT group_id, 0 AS up, i AS o, x, lo AS y FROM e WHERE (group_id, i) NOT IN (SELECT group_id, i FROM below)
      UNION ALL SELECT e.group_id, 1, -i, x, hi FROM e JOIN g ON g.group_id = e.group_id
        WHERE (e.group_id, i) NOT IN (SELECT group_id, i FROM above) AND NOT ((i = i0 OR i = i1) AND a = b))
    SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY up, o) - 1 AS idx, x, y FROM c""")
def zone_hull(t):
    return ops.zone_hull(t.fixes.select("group_id", "x", "y"))


@query("zone_counts", "SELECT group_id, count(*) AS n FROM fixes GROUP BY group_id UNION ALL SELECT NULL, count(*) FROM fixes")
def zone_counts(t):
    return ops.zone_counts(t.fixes)


@query("resolve_seed_depth", """
    SELECT point_id, round(greatest(z + 0.5, -20 - point_id % 8), 6) + 0.0 AS below, round(CASE WHEN -z - 20 - point_id % 8 > 0.5 THEN 0.5 ELSE -z - 20 - point_id % 8 END, 6) + 0.0 AS above FROM points""")
def resolve_seed_depth(t):
    p = t.points.withColumns({"zmin": F.lit(-20.0) - C("point_id") % 8, "zmax": F.lit(0.5)})
    below = seed_ops.resolve_seed_depth(p.withColumn("below", C("z")), "depth_below_surface", "below")
    both = seed_ops.resolve_seed_depth(below.withColumn("above", -C("z")), "height_above_bottom", "above")
    return both.select("point_id", rd("below").alias("below"), rd("above").alias("above"))


@query("place_seeds", """
    SELECT row_number() OVER (ORDER BY point_id * 3 + 5) AS particle_id, point_id, CASE WHEN t.mask_c <> 2 THEN l.host ELSE -999 END AS host,
      CAST(coalesce(t.mask_c <> 2, false) AS INT) AS in_domain, CAST(coalesce(t.mask_c <> 2 AND l.host % 5 = 0, false) AS INT) AS is_beached
    FROM points LEFT JOIN located l USING (point_id) LEFT JOIN tri t ON t.element_id = l.host""")
def place_seeds(t):
    wet = t.mesh.elements.select("element_id", (C("element_id") % 5 != 0).cast("int").alias("wet"))
    seeds = t.points.select("point_id", (C("point_id") * 3 + 5).alias("line"), "x", "y")
    return seed_ops.place_seeds(seeds, t.mesh, wet).select("particle_id", "point_id", "host", "in_domain", "is_beached")
