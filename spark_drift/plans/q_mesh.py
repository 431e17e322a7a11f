"""Queries: mesh building."""

from pyspark.sql import functions as F

from spark_drift.operators import mesh as ops
from spark_drift.plans.registry import query, rd
from spark_drift.schema import Mesh

C = F.col

SLOTS_SQL = """
    nb3 AS (SELECT element_id, max(CASE WHEN slot = 0 THEN nb END) AS b0, max(CASE WHEN slot = 1 THEN nb END) AS b1,
      max(CASE WHEN slot = 2 THEN nb END) AS b2 FROM adjacency GROUP BY element_id)"""


def _flat(df, *extra):
    cols = [C("nv")[k].alias(f"n{k}") for k in range(3)] + [C("nbe")[k].alias(f"b{k}") for k in range(3)]
    return df.select("element_id", *cols, *extra)


@query("lattice_mesh", f"""
    WITH {SLOTS_SQL.strip()} SELECT e.element_id, n0, n1, n2, b0, b1, b2, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y
    FROM elems e JOIN nb3 USING (element_id) JOIN nodes n ON n.node_id = e.n0""")
def lattice_mesh(t):
    m = ops.lattice_mesh(t.table("axis_x"), t.table("axis_y"))
    nodes = m.nodes.select(C("node_id").alias("n0"), rd("x").alias("x"), rd("y").alias("y"))
    return _flat(m.elements).join(nodes, "n0")


@query("orient_elements", f"WITH {SLOTS_SQL.strip()} SELECT element_id, n0, n1, n2, b0, b1, b2 FROM elems JOIN nb3 USING (element_id)")
def orient_elements(t):
    swap = lambda c: F.when(C("element_id") % 2 == 1, F.array(C(c)[0], C(c)[2], C(c)[1])).otherwise(C(c))
    mixed = Mesh(t.raw_mesh.nodes, t.raw_mesh.elements.withColumns({"nv": swap("nv"), "nbe": swap("nbe")}))
    return _flat(ops.orient_elements(mixed).elements)


@query("element_neighbours", f"WITH {SLOTS_SQL.strip()} SELECT element_id, n0, n1, n2, b0, b1, b2 FROM elems JOIN nb3 USING (element_id)")
def element_neighbours(t):
    return _flat(ops.element_neighbours(t.mesh.elements.drop("nbe")))


UNIT_SQL = """
    gu AS (SELECT node_id, cos(radians(x)) * cos(radians(y)) AS ux, sin(radians(x)) * cos(radians(y)) AS uy, sin(radians(y)) AS uz FROM geo_nodes),
    g3 AS (SELECT e.element_id, a.ux AS ax, a.uy AS ay, a.uz AS az, b.ux AS bx, b.uy AS by_, b.uz AS bz, c.ux AS cx, c.uy AS cy, c.uz AS cz
      FROM elems e JOIN gu a ON a.node_id = n0 JOIN gu b ON b.node_id = n1 JOIN gu c ON c.node_id = n2)"""


@query("element_areas", f"""
    WITH {UNIT_SQL.strip()}
    SELECT t.element_id, round(abs((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) / 2, 6) + 0.0 AS area,
      round(6371.0 * 6371 * abs(2 * atan2(ax * (by_ * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by_ * cx),
        1 + ax * bx + ay * by_ + az * bz + bx * cx + by_ * cy + bz * cz + cx * ax + cy * ay + cz * az)), 2) + 0.0 AS km2
    FROM tri t JOIN g3 USING (element_id)""")
def element_areas(t):
    plane = ops.element_areas(t.raw_mesh).select("element_id", rd("area").alias("area"))
    sphere = ops.element_areas(t.geo_mesh).select("element_id", rd(C("area") / 1e6, 2).alias("km2"))
    return plane.join(sphere, "element_id")


@query("element_midpoints", f"""
    WITH {UNIT_SQL.strip()}
    SELECT t.element_id, round((x0 + x1 + x2) / 3, 6) + 0.0 AS xc, round((y0 + y1 + y2) / 3, 6) + 0.0 AS yc,
      round(degrees(atan2(ay + by_ + cy, ax + bx + cx)), 6) + 0.0 AS lon,
      round(degrees(atan2(az + bz + cz, sqrt(pow(ax + bx + cx, 2) + pow(ay + by_ + cy, 2)))), 6) + 0.0 AS lat
    FROM tri t JOIN g3 USING (element_id)""")
def element_midpoints(t):
    plane = ops.element_midpoints(t.mesh).select("element_id", rd("xc").alias("xc"), rd("yc").alias("yc"))
    sphere = ops.element_midpoints(t.geo_mesh).select("element_id", rd("xc").alias("lon"), rd("yc").alias("lat"))
    return plane.join(sphere, "element_id")


@query("element_mask", """
    SELECT element_id, CAST(CASE WHEN m0 + m1 + m2 = 0 THEN 0 WHEN m0 + m1 + m2 <= 1 THEN 1 ELSE 2 END AS INT) AS mask_1, CAST(mask_c AS INT) AS mask_2 FROM tri""")
def element_mask(t):
    one = ops.element_mask(t.raw_mesh.elements.drop("mask_c"), t.raw_mesh.nodes, 1).select("element_id", C("mask_c").alias("mask_1"))
    return one.join(t.raw_mesh.elements.select("element_id", C("mask_c").alias("mask_2")), "element_id")


@query("mask_two_boundary", """
    WITH hit AS (SELECT a.element_id FROM adjacency a JOIN tri t ON t.element_id = a.element_id JOIN tri n ON n.element_id = a.nb
      WHERE t.m0 + t.m1 + t.m2 = 0 AND n.m0 + n.m1 + n.m2 > 0 GROUP BY 1 HAVING count(*) = 2)
    SELECT element_id, CAST(CASE WHEN m0 + m1 + m2 > 0 OR element_id IN (SELECT element_id FROM hit) THEN 2 ELSE 0 END AS INT) AS mask_c FROM tri""")
def mask_two_boundary(t):
    strict = ops.element_mask(t.raw_mesh.elements.drop("mask_c"), t.raw_mesh.nodes, 0)
    return ops.mask_two_boundary(strict).select("element_id", "mask_c")


@query("mask_two_land_sides", """
    SELECT element_id, CAST(CASE WHEN count(*) FILTER (WHERE nb = -1) = 2 THEN 2 ELSE 0 END AS INT) AS mask_c FROM adjacency GROUP BY 1""")
def mask_two_land_sides(t):
    return ops.mask_two_land_sides(t.mesh.elements).select("element_id", "mask_c")


@query("flag_open_boundary", f"""
    WITH {SLOTS_SQL.strip()}, f AS (SELECT element_id, max(CASE WHEN n.lat_index <> 0 THEN k END) AS third, count(*) FILTER (WHERE n.lat_index = 0) AS c
      FROM (SELECT element_id, 0 AS k, n0 AS v FROM elems UNION ALL SELECT element_id, 1, n1 FROM elems UNION ALL SELECT element_id, 2, n2 FROM elems) q
      JOIN nodes n ON n.node_id = v GROUP BY 1)
    SELECT element_id, CASE WHEN c = 2 AND third = 0 AND b0 = -1 THEN -2 ELSE b0 END AS b0, CASE WHEN c = 2 AND third = 1 AND b1 = -1 THEN -2 ELSE b1 END AS b1,
      CASE WHEN c = 2 AND third = 2 AND b2 = -1 THEN -2 ELSE b2 END AS b2 FROM nb3 JOIN f USING (element_id)""")
def flag_open_boundary(t):
    out = ops.flag_open_boundary(t.mesh.elements, t.mesh.nodes.where("lat_index = 0"))
    return out.select("element_id", *[C("nbe")[k].alias(f"b{k}") for k in range(3)])


@query("mask_by_points", f"""
    WITH {SLOTS_SQL.strip()}, f AS (SELECT p.point_id, host, ((x1-x0)*(p.y-y0)-(y1-y0)*(p.x-x0)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f2,
        ((y2-y0)*(p.x-x2)-(x2-x0)*(p.y-y2)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f1
      FROM located JOIN points p USING (point_id) JOIN tri t ON t.element_id = host WHERE point_id % 3 = 0),
    g AS (SELECT *, 1 - f1 - f2 AS f0 FROM f),
    hit AS (SELECT host AS e FROM g UNION SELECT CASE WHEN f0 <= f1 AND f0 <= f2 THEN b0 WHEN f1 <= f2 THEN b1 ELSE b2 END FROM g JOIN nb3 ON host = element_id)
    SELECT element_id, CAST(CASE WHEN element_id IN (SELECT e FROM hit) THEN 2 ELSE 0 END AS INT) AS mask_c FROM elems""")
def mask_by_points(t):
    pts = t.points.withColumn("mask", (C("point_id") % 3 == 0).cast("int"))
    return ops.mask_by_points(t.mesh, pts).select("element_id", "mask_c")


@query("bathymetry_from_mask", """
    SELECT node_id, CASE node_id % 5 WHEN 0 THEN 0.0 ELSE (node_id % 5 - 1) * 8.0 END::DOUBLE AS h FROM nodes""")
def bathymetry_from_mask(t):
    fields = t.fields("thetao").withColumn("value", F.when(C("level") < C("node_id") % 5, C("value")))
    levels = t.spark.range(4).select(C("id").cast("int").alias("level"), (C("id") * F.lit(8.0)).alias("depth"))
    return ops.bathymetry_from_mask(fields, levels)


@query("node_mask_from_field", "SELECT node_id, CAST(node_id % 7 = 0 AS INT) AS mask, CAST(node_id % 7 <> 0 AS INT) AS inverted FROM nodes")
def node_mask_from_field(t):
    fields = t.fields("thetao").withColumn("value", F.when((C("node_id") + C("level")) % 7 != 0, C("value")))
    mask = ops.node_mask_from_field(fields)
    return ops.invert_mask(mask.withColumn("inverted", C("mask")), "inverted")


@query("level_interfaces", """
    WITH layers AS (SELECT s_suppkey AS id, CAST(l AS INT) AS level, -(l + 0.3 + (s_suppkey % 4) / 10) / 5 AS sigma FROM supplier, range(5) r(l))
    SELECT i.id, k AS level, round(CASE k WHEN 0 THEN 0 WHEN 5 THEN -1 ELSE (a.sigma + b.sigma) / 2 END, 6) + 0.0 AS sigma
    FROM (SELECT DISTINCT id FROM layers) i, (SELECT CAST(unnest([0,1,2,3,4,5]) AS INT) AS k) q
    LEFT JOIN layers a ON a.id = i.id AND a.level = k - 1 LEFT JOIN layers b ON b.id = i.id AND b.level = k""")
def level_interfaces(t):
    layers = t.base("supplier").select(C("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"))
    sigma = -(C("level").cast("double") + F.lit(0.3) + (C("id") % 4).cast("double") / 10) / 5
    out = ops.level_interfaces(layers.withColumn("sigma", sigma), ["id"])
    return out.select("id", "level", rd("sigma").alias("sigma"))


UNSTAGGER = """
    WITH s AS (SELECT {line} AS line, {index} AS i, nullif(CASE WHEN node_id % 11 = 0 THEN 0 ELSE x + y * 2 + wx END, 0) AS v, (SELECT max({index}) FROM nodes) AS m FROM nodes),
    o AS (SELECT line, i, m, (v + lag(v) OVER (PARTITION BY line ORDER BY i)) / 2 AS v FROM s WHERE i > 0 OR i = 0),
    w AS (SELECT line, max(CASE WHEN i = 1 THEN v END) AS f1, max(CASE WHEN i = 2 THEN v END) AS f2, max(CASE WHEN i = 3 THEN v END) AS f3,
      max(CASE WHEN i = m THEN v END) AS g1, max(CASE WHEN i = m - 1 THEN v END) AS g2, max(m) + 1 AS n FROM o GROUP BY line)
    SELECT line, CAST(i AS INT) AS i, round(coalesce(v, 0), 6) + 0.0 AS value FROM (
      SELECT line, i, v FROM o WHERE i > 0 UNION ALL SELECT line, 0, f1 + (f2 - f3) FROM w UNION ALL SELECT line, n, g1 + (g1 - g2) FROM w) q"""


def _staggered(t, line, index):
    v = F.when(C("node_id") % 11 == 0, F.lit(0.0)).otherwise(C("x") + C("y") * 2 + C("wx"))
    return t.mesh.nodes.select(C(line).alias("line"), C(index).cast("int").alias("i"), v.alias("value"))


@query("unstagger_u", UNSTAGGER.format(line="lat_index", index="lon_index"))
def unstagger_u(t):
    return ops.unstagger_u(_staggered(t, "lat_index", "lon_index"), ["line"], "i").select("line", "i", rd("value").alias("value"))


@query("unstagger_v", UNSTAGGER.format(line="lon_index", index="lat_index"))
def unstagger_v(t):
    return ops.unstagger_v(_staggered(t, "lon_index", "lat_index"), ["line"], "i").select("line", "i", rd("value").alias("value"))


@query("permute_nodes", "SELECT (SELECT max(node_id) FROM nodes) - node_id AS node_id, round(x, 6) + 0.0 AS x FROM nodes")
def permute_nodes(t):
    n = t.mesh.nodes.count()
    permutation = t.spark.range(n).select(C("id").alias("node_id"), (F.lit(n - 1) - C("id")).alias("place"))
    return ops.permute_nodes(t.mesh.nodes.select("node_id", rd("x").alias("x")), permutation)
