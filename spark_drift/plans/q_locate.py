"""Queries: point location and boundary geometry."""

from pyspark.sql import functions as F

from spark_drift.operators import locate as ops
from spark_drift.operators import mesh as mesh_ops
from spark_drift.plans.q_mesh import SLOTS_SQL, UNIT_SQL
from spark_drift.plans.registry import query, rd
from spark_drift.plans.tables import ORACLE_ONLY
from spark_drift.schema import Mesh

C = F.col

# host, φ and flag of every point, by brute force over boxes of all elements
HOSTS_SQL = """
    hosts AS (SELECT p.*, CASE WHEN t.mask_c <> 2 THEN l.host END AS host, CASE WHEN t.mask_c <> 2 THEN 0 ELSE -3 END AS flag,
      ((x1-x0)*(p.y-y0)-(y1-y0)*(p.x-x0)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f2,
      ((y2-y0)*(p.x-x2)-(x2-x0)*(p.y-y2)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f1
      FROM points p LEFT JOIN located l USING (point_id) LEFT JOIN tri t ON t.element_id = l.host)"""


@query("locate_points", f"""
    WITH {HOSTS_SQL.strip()} SELECT point_id, host, CAST(coalesce(flag, -3) AS INT) AS flag,
      CASE WHEN flag = 0 THEN round(1 - f1 - f2, 6) + 0.0 END AS phi0, CASE WHEN flag = 0 THEN round(f1, 6) + 0.0 END AS phi1,
      CASE WHEN flag = 0 THEN round(f2, 6) + 0.0 END AS phi2 FROM hosts""")
def locate_points(t):
    out = ops.locate_points(t.points.select("point_id", "x", "y"), t.mesh)
    return out.select("point_id", "host", "flag", *[rd(f"phi{k}").alias(f"phi{k}") for k in range(3)])


ORACLE_ONLY["geo_located"] = f"""
    WITH {UNIT_SQL.strip()},
    e AS (SELECT element_id, by_*cz-bz*cy AS p0, bz*cx-bx*cz AS q0, bx*cy-by_*cx AS r0, cy*az-cz*ay AS p1, cz*ax-cx*az AS q1, cx*ay-cy*ax AS r1,
        ay*bz-az*by_ AS p2, az*bx-ax*bz AS q2, ax*by_-ay*bx AS r2, ax, ay, az, least(az, bz, cz) - 0.001 AS zlo, greatest(az, bz, cz) + 0.001 AS zhi,
        least(ax, bx, cx) - 0.001 AS xlo, greatest(ax, bx, cx) + 0.001 AS xhi FROM g3),
    s AS (SELECT *, sign(ax * p0 + ay * q0 + az * r0) AS w FROM e),
    u AS (SELECT point_id, cos(radians(x)) * cos(radians(y)) AS ux, sin(radians(x)) * cos(radians(y)) AS uy, sin(radians(y)) AS uz FROM geo_points),
    h AS (SELECT point_id, element_id, w * (ux*p0+uy*q0+uz*r0) AS s0, w * (ux*p1+uy*q1+uz*r1) AS s1, w * (ux*p2+uy*q2+uz*r2) AS s2
      FROM u JOIN s ON uz >= zlo AND uz <= zhi AND ux >= xlo AND ux <= xhi)
    SELECT point_id, min(element_id) AS host, arg_min(s0 / (s0 + s1 + s2), element_id) AS phi0, arg_min(s1 / (s0 + s1 + s2), element_id) AS phi1
    FROM h WHERE s0 >= -1e-12 AND s1 >= -1e-12 AND s2 >= -1e-12 GROUP BY point_id"""


@query("locate_points_on_sphere", """
    SELECT p.point_id, CASE WHEN t.mask_c <> 2 THEN l.host END AS host, CASE WHEN t.mask_c <> 2 THEN round(phi0, 6) + 0.0 END AS phi0,
      CASE WHEN t.mask_c <> 2 THEN round(phi1, 6) + 0.0 END AS phi1, CAST(CASE WHEN t.mask_c <> 2 THEN 0 ELSE -3 END AS INT) AS flag
    FROM points p LEFT JOIN geo_located l USING (point_id) LEFT JOIN tri t ON t.element_id = l.host""")
def locate_points_on_sphere(t):
    out = ops.locate_points(t.geo_points.select("point_id", "x", "y"), t.geo_mesh)
    return out.select("point_id", "host", "flag", rd("phi0").alias("phi0"), rd("phi1").alias("phi1"))


# the hint is right for two points in three; a hinted land element gives −4
@query("locate_with_hint", f"""
    WITH {HOSTS_SQL.strip()} SELECT h.point_id, h.host,
      CAST(CASE WHEN l.host IS NOT NULL AND t.mask_c = 2 AND h.point_id % 3 <> 0 THEN -4 ELSE coalesce(flag, -3) END AS INT) AS flag
    FROM hosts h LEFT JOIN located l USING (point_id) LEFT JOIN tri t ON t.element_id = l.host""")
def locate_with_hint(t):
    bare = Mesh(t.mesh.nodes, t.mesh.elements.drop("mask_c"))
    pts = ops.locate_points(t.points.select("point_id", "x", "y"), bare)
    hinted = pts.select("point_id", "x", "y", F.when(C("point_id") % 3 != 0, C("host")).otherwise(F.lit(0).cast("long")).alias("hint"))
    return ops.locate_with_hint(hinted, t.mesh).select("point_id", "host", "flag")


def _rho_mesh(t):
    """A coarser mesh: every other lon line of the same lattice."""
    lons = t.table("axis_x").where("idx % 2 = 0 OR idx < 0").select((C("idx") / 2).cast("long").alias("idx"), "v")
    m = mesh_ops.lattice_mesh(lons, t.table("axis_y").select("idx", "v"))
    return Mesh(m.nodes, m.elements.withColumn("mask_c", F.lit(0)))


COARSE_SQL = """
    ca AS (SELECT idx // 2 AS i, v FROM axis_x WHERE idx % 2 = 0), cb AS (SELECT idx AS j, v FROM axis_y),
    cn AS (SELECT ca.i * (SELECT count(*) FROM cb) + cb.j AS node_id, ca.v AS x, cb.v AS y, ca.i, cb.j FROM ca, cb),
    cc AS (SELECT i, j, (SELECT count(*) FROM cb) AS nb FROM cn WHERE i < (SELECT max(i) FROM ca) AND j < (SELECT max(j) FROM cb)),
    ce AS (SELECT 2 * (i * (nb - 1) + j) AS element_id, i * nb + j AS n0, (i + 1) * nb + j + 1 AS n1, (i + 1) * nb + j AS n2 FROM cc
      UNION ALL SELECT 2 * (i * (nb - 1) + j) + 1, i * nb + j, i * nb + j + 1, (i + 1) * nb + j + 1 FROM cc),
    ct AS (SELECT element_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2
      FROM ce JOIN cn a ON n0 = a.node_id JOIN cn b ON n1 = b.node_id JOIN cn c ON n2 = c.node_id),
    ch AS (SELECT point_id, min(element_id) AS host FROM (SELECT point_id, element_id,
        ((x1-x0)*(p.y-y0)-(y1-y0)*(p.x-x0)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f2,
        ((y2-y0)*(p.x-x2)-(x2-x0)*(p.y-y2)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f1
      FROM points p JOIN ct ON p.x >= least(x0,x1,x2) AND p.x <= greatest(x0,x1,x2) AND p.y >= least(y0,y1,y2) AND p.y <= greatest(y0,y1,y2)) q
      WHERE f1 >= 0 AND f2 >= 0 AND 1 - f1 - f2 >= 0 GROUP BY 1)"""


@query("locate_on_grids", f"""
    WITH {HOSTS_SQL.strip()}, {COARSE_SQL.strip()}
    SELECT point_id, h.host AS psi, ch.host AS rho, CAST(coalesce(CASE WHEN h.host IS NULL THEN -3 END, CASE WHEN ch.host IS NULL THEN -3 END, 0) AS INT) AS flag
    FROM hosts h LEFT JOIN ch USING (point_id)""")
def locate_on_grids(t):
    out = ops.locate_on_grids(t.points.select("point_id", "x", "y"), {"psi": t.mesh, "rho": _rho_mesh(t)}, "psi", composite=True)
    return out.select("point_id", F.element_at("hosts", F.lit("psi")).alias("psi"), F.element_at("hosts", F.lit("rho")).alias("rho"), "flag")


MOVE = "x + (CAST(point_id % 7 AS DOUBLE) - 3) * 0.3"
MOVE_Y = "y + (CAST(point_id % 5 AS DOUBLE) - 2) * 0.3"


def moves(t, mesh=None, points=None):
    """Each located point moved by up to 0.9 in x and 0.6 in y."""
    found = ops.locate_points((points or t.points).select(C("point_id").alias("move_id"), "x", "y"), mesh or t.mesh)
    pid = C("move_id")
    return found.where("host is not null").select(
        "move_id", "x", "y", (C("x") + ((pid % 7).cast("double") - 3) * F.lit(0.3)).alias("x_new"),
        (C("y") + ((pid % 5).cast("double") - 2) * F.lit(0.3)).alias("y_new"), "host")


# every wall against every move whose box it meets
MOVES_SQL = f"""
    {HOSTS_SQL.strip()},
    mv AS (SELECT point_id AS move_id, x, y, x + (CAST(point_id % 7 AS DOUBLE) - 3) * 0.3::DOUBLE AS x_new,
      y + (CAST(point_id % 5 AS DOUBLE) - 2) * 0.3::DOUBLE AS y_new, host FROM hosts WHERE host IS NOT NULL),
    walls AS (SELECT a.element_id, a.slot, na.x AS sx, na.y AS sy, nb_.x AS ex, nb_.y AS ey FROM adjacency a JOIN tri t ON t.element_id = a.element_id
      LEFT JOIN tri o ON o.element_id = a.nb JOIN nodes na ON na.node_id = a.va JOIN nodes nb_ ON nb_.node_id = a.vb
      WHERE t.mask_c <> 2 AND (a.nb = -1 OR o.mask_c = 2)),
    pairs_ AS (SELECT m.*, w.element_id AS we, w.sx, w.sy, w.ex, w.ey, (ex - sx) * (y_new - y) - (ey - sy) * (x_new - x) AS d FROM mv m JOIN walls w
      ON least(sx, ex) <= greatest(x, x_new) AND greatest(sx, ex) >= least(x, x_new) AND least(sy, ey) <= greatest(y, y_new) AND greatest(sy, ey) >= least(y, y_new)),
    par AS (SELECT *, ((x - sx) * (y_new - y) - (y - sy) * (x_new - x)) / nullif(d, 0) AS s, ((x - sx) * (ey - sy) - (y - sy) * (ex - sx)) / nullif(d, 0) AS u FROM pairs_),
    wall AS (SELECT move_id, arg_min(we, u) AS we, min(u) AS u, arg_min(sx, u) AS sx, arg_min(sy, u) AS sy, arg_min(ex, u) AS ex, arg_min(ey, u) AS ey
      FROM par WHERE s BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 GROUP BY move_id),
    ends AS (SELECT m.move_id, min(t.element_id) AS e FROM mv m JOIN tri t ON x_new >= least(x0,x1,x2) AND x_new <= greatest(x0,x1,x2)
        AND y_new >= least(y0,y1,y2) AND y_new <= greatest(y0,y1,y2)
        AND ((x1-x0)*(y_new-y0)-(y1-y0)*(x_new-x0)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) >= 0
        AND ((y2-y0)*(x_new-x2)-(x2-x0)*(y_new-y2)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) >= 0
        AND 1 - ((y2-y0)*(x_new-x2)-(x2-x0)*(y_new-y2)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) - ((x1-x0)*(y_new-y0)-(y1-y0)*(x_new-x0)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) >= 0
      GROUP BY m.move_id)"""


@query("crossings", f"""
    WITH {MOVES_SQL.strip()}
    SELECT move_id, CASE WHEN we IS NOT NULL THEN we WHEN t.mask_c <> 2 THEN e END AS new_host,
      CAST(CASE WHEN we IS NOT NULL THEN -1 WHEN t.mask_c <> 2 THEN 0 ELSE -3 END AS INT) AS flag
    FROM mv LEFT JOIN wall USING (move_id) LEFT JOIN ends USING (move_id) LEFT JOIN tri t ON t.element_id = e""")
def crossings(t):
    return ops.crossings(moves(t), t.mesh).select("move_id", "new_host", "flag")


# the sides of the host itself: no neighbour, or a neighbour with two or more land sides
@query("boundary_intersection", f"""
    WITH {MOVES_SQL.strip()}, closed AS (SELECT element_id FROM adjacency WHERE nb = -1 GROUP BY 1 HAVING count(*) >= 2),
    hs AS (SELECT a.element_id, (a.slot + 1) % 3 AS rank, na.x AS sx, na.y AS sy, nb_.x AS ex, nb_.y AS ey FROM adjacency a
      JOIN nodes na ON na.node_id = a.va JOIN nodes nb_ ON nb_.node_id = a.vb WHERE a.nb = -1 OR a.nb IN (SELECT element_id FROM closed)),
    k AS (SELECT m.move_id, rank, h.*, (ex - sx) * (y_new - y) - (ey - sy) * (x_new - x) AS d, x, y, x_new, y_new FROM mv m JOIN hs h ON h.element_id = m.host),
    c AS (SELECT *, ((x - sx) * (y_new - y) - (y - sy) * (x_new - x)) / nullif(d, 0) AS s, ((x - sx) * (ey - sy) - (y - sy) * (ex - sx)) / nullif(d, 0) AS u FROM k)
    SELECT move_id, round(arg_min(sx + s * (ex - sx), rank), 6) + 0.0 AS xi, round(arg_min(sy + s * (ey - sy), rank), 6) + 0.0 AS yi
    FROM c WHERE s BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 GROUP BY move_id""")
def boundary_intersection(t):
    out = ops.boundary_intersection(moves(t), t.mesh, strict=False)
    return out.select("move_id", rd("xi").alias("xi"), rd("yi").alias("yi"))


@query("reflect_across_side", f"""
    WITH {MOVES_SQL.strip()}, f AS (SELECT *, ((x_new - sx) * (ex - sx) + (y_new - sy) * (ey - sy)) / ((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) AS k
      FROM mv JOIN wall USING (move_id))
    SELECT move_id, round(2 * (sx + k * (ex - sx)) - x_new, 6) + 0.0 AS x_ref, round(2 * (sy + k * (ey - sy)) - y_new, 6) + 0.0 AS y_ref FROM f""")
def reflect_across_side(t):
    m = moves(t)
    out = ops.reflect_across_side(m.join(ops.first_walls(m, t.mesh), "move_id"))
    return out.select("move_id", rd("x_ref").alias("x_ref"), rd("y_ref").alias("y_ref"))


@query("snap_to_centre", f"""
    WITH {HOSTS_SQL.strip()} SELECT point_id, round((x0 + x1 + x2) / 3, 6) + 0.0 AS x, round((y0 + y1 + y2) / 3, 6) + 0.0 AS y
    FROM hosts JOIN tri ON element_id = host""")
def snap_to_centre(t):
    pts = ops.locate_points(t.points.select("point_id", "x", "y"), t.mesh).where("host is not null")
    out = ops.snap_to_centre(pts.select("point_id", "host", "x", "y"), t.mesh)
    return out.select("point_id", rd("x").alias("x"), rd("y").alias("y"))


@query("local_coordinates", f"""
    WITH {HOSTS_SQL.strip()} SELECT point_id, host, round(1 - f1 - f2, 6) + 0.0 AS phi0, round(f1, 6) + 0.0 AS phi1, round(f2, 6) + 0.0 AS phi2
    FROM hosts WHERE host IS NOT NULL""")
def local_coordinates(t):
    pts = ops.locate_points(t.points.select("point_id", "x", "y"), t.mesh).where("host is not null").select("point_id", "host", "x", "y")
    return ops.local_coordinates(pts, t.mesh).select("point_id", "host", *[rd(f"phi{k}").alias(f"phi{k}") for k in range(3)])


# an element is wet unless it lies in a block of 8 by id; rings by breadth-first search
@query("nearest_wet_element", f"""
    WITH RECURSIVE {HOSTS_SQL.strip()}, w AS (SELECT element_id, CASE WHEN element_id // 8 % 3 = 0 THEN 0 ELSE 1 END AS wet FROM elems),
    src AS (SELECT DISTINCT host AS s FROM hosts JOIN w ON w.element_id = host WHERE wet = 0),
    bfs(s, e, d) AS (SELECT s, s, 0 FROM src UNION SELECT b.s, a.nb, b.d + 1 FROM bfs b JOIN adjacency a ON a.element_id = b.e JOIN w x ON x.element_id = b.e
      WHERE a.nb >= 0 AND b.d < 9 AND x.wet = 0),
    first AS (SELECT s, e, min(d) AS d FROM bfs GROUP BY 1, 2),
    ring AS (SELECT f.s, min(f.d) AS d FROM first f JOIN w ON w.element_id = f.e WHERE wet = 1 GROUP BY 1),
    cand AS (SELECT f.s, f.e FROM first f JOIN ring r ON r.s = f.s AND r.d = f.d JOIN w ON w.element_id = f.e WHERE wet = 1)
    SELECT h.point_id, max(b.wet_host) AS wet_host FROM hosts h LEFT JOIN (
      SELECT point_id, arg_min(e, struct_pack(r := sqrt(pow(h.x - (x0+x1+x2)/3, 2) + pow(h.y - (y0+y1+y2)/3, 2)), k := e)) AS wet_host
      FROM hosts h JOIN cand ON s = host JOIN tri t ON t.element_id = e GROUP BY point_id) b ON b.point_id = h.point_id
    WHERE h.host IS NOT NULL GROUP BY 1""")
def nearest_wet_element(t):
    pts = ops.locate_points(t.points.select("point_id", "x", "y"), t.mesh).where("host is not null").select("point_id", "host", "x", "y")
    wet = t.mesh.elements.select("element_id", F.when(F.floor(C("element_id") / 8) % 3 == 0, 0).otherwise(1).alias("wet"))
    return ops.nearest_wet_element(pts, t.mesh, wet).select("point_id", "wet_host")


@query("boundary_edges", "SELECT element_id, CAST(slot AS INT) AS slot, va AS na, vb AS nb, CAST(nb AS INT) AS kind FROM adjacency a WHERE a.nb < 0".replace("vb AS nb, CAST(nb", "vb AS nb, CAST(a.nb"))
def boundary_edges(t):
    return ops.boundary_edges(t.mesh)
