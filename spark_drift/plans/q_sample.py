"""Queries: field interpolation joins and regridding."""

import uuid

from pyspark.sql import functions as F

from spark_drift.operators import archive
from spark_drift.operators import sample as ops
from spark_drift.operators.locate import locate_points
from spark_drift.operators.regrid import regrid as regrid_op
from spark_drift.operators.time import asof_frames
from spark_drift.plans.q_locate import HOSTS_SQL
from spark_drift.plans.registry import query, rd
from spark_drift.plans.tables import LEVEL_DEPTHS, ORACLE_ONLY
from spark_drift.util import scratch_folder

C = F.col


def located_points(t):
    return locate_points(t.points.select("point_id", "x", "y"), t.mesh).where("host is not null")


def framed_fixes(t, *extra):
    """Fixes in sea and boundary elements with host, φ and frames."""
    found = locate_points(t.fixes.select("fix_id", "time", "x", "y", "z", *extra), t.mesh).where("host is not null")
    return asof_frames(found.drop("mask_c", "flag"), t.frame_times)


# ζ, h and the host level of every fix on fixed levels 0, 8, 16, 24 m
ORACLE_ONLY["fix_place"] = """
    SELECT q.*, CASE WHEN rel <= 0 AND rel >= -8 THEN 0 WHEN rel <= -8 AND rel >= -16 THEN 1 WHEN rel <= -16 AND rel >= -24 THEN 2
        WHEN rel <= -24 AND z >= -h THEN 3 END AS k,
      CASE WHEN rel <= 0 AND rel >= -8 THEN (rel + 8) / 8 WHEN rel <= -8 AND rel >= -16 THEN (rel + 16) / 8
        WHEN rel <= -16 AND rel >= -24 THEN (rel + 24) / 8 END AS omega
    FROM (SELECT f.*, s.value AS zeta, f.z - s.value AS rel, phi0 * a.h + phi1 * b.h + phi2 * c.h AS h
      FROM fix_hosts f JOIN fix_levels s ON s.fix_id = f.fix_id AND s.variable = 'zeta'
      JOIN nodes a ON a.node_id = n0 JOIN nodes b ON b.node_id = n1 JOIN nodes c ON c.node_id = n2) q"""
# every 3-D variable at the depth of every fix
ORACLE_ONLY["fix_values"] = """
    SELECT p.fix_id, u.variable, CASE WHEN p.k = 3 THEN u.value ELSE (1 - omega) * l.value + omega * u.value END AS value
    FROM fix_place p JOIN fix_levels u ON u.fix_id = p.fix_id AND u.level = p.k
    LEFT JOIN fix_levels l ON l.fix_id = p.fix_id AND l.level = p.k + 1 AND l.variable = u.variable
    WHERE u.variable IN ('thetao', 'uo', 'vo', 'wo', 'kz')"""
# node values at the time of the fix, with the gradient weights of each node
ORACLE_ONLY["fix_nodes"] = """
    SELECT w.fix_id, w.slot, w.area, f.variable, f.level, w.gx, w.gy, sum(w.wt * f.value) AS value FROM (
      SELECT h.fix_id, s.slot, abs(a2) / 2 AS area, CASE s.slot WHEN 0 THEN h.n0 WHEN 1 THEN h.n1 ELSE h.n2 END AS node_id,
        CASE f.k WHEN 0 THEN h.t_last ELSE h.t_next END AS time, CASE f.k WHEN 0 THEN 1 - tf ELSE tf END AS wt,
        CASE s.slot WHEN 0 THEN y1 - y2 WHEN 1 THEN y2 - y0 ELSE y0 - y1 END / a2 AS gx,
        CASE s.slot WHEN 0 THEN x2 - x1 WHEN 1 THEN x0 - x2 ELSE x1 - x0 END / a2 AS gy
      FROM fix_hosts h JOIN (SELECT *, (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS a2 FROM tri) t ON t.element_id = h.host,
        (SELECT unnest([0, 1, 2]) AS slot) s, (SELECT unnest([0, 1]) AS k) f) w
    JOIN fields f ON f.node_id = w.node_id AND f.time = w.time GROUP BY ALL"""
ORACLE_ONLY["fix_grads"] = """
    SELECT fix_id, variable, level, max(area) AS area, sum(gx * value) AS dx, sum(gy * value) AS dy FROM fix_nodes GROUP BY 1, 2, 3"""


@query("interp_2d", """
    SELECT point_id, round((1 - f1 - f2) * a.h + f1 * b.h + f2 * c.h, 6) + 0.0 AS h FROM
      (SELECT p.*, l.host, ((x1-x0)*(p.y-y0)-(y1-y0)*(p.x-x0)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f2,
        ((y2-y0)*(p.x-x2)-(x2-x0)*(p.y-y2)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f1, n0, n1, n2
      FROM points p JOIN located l USING (point_id) JOIN tri t ON t.element_id = l.host WHERE t.mask_c <> 2) q
    JOIN nodes a ON a.node_id = n0 JOIN nodes b ON b.node_id = n1 JOIN nodes c ON c.node_id = n2""")
def interp_2d(t):
    return ops.interp_2d(located_points(t), t.mesh.nodes, "h", "h").select("point_id", rd("h").alias("h"))


@query("interp_2d_time", "SELECT fix_id, round(value, 6) + 0.0 AS zeta FROM fix_levels WHERE variable = 'zeta'")
def interp_2d_time(t):
    return ops.interp_2d_time(framed_fixes(t), t.fields("zeta"), "zeta").select("fix_id", rd("zeta").alias("zeta"))


@query("interp_2d_time_archive", "SELECT fix_id, round(value, 6) + 0.0 AS zeta FROM fix_levels WHERE variable = 'zeta'")
def interp_2d_time_archive(t):
    order = archive.curve_permutation(t.mesh.nodes)
    mesh = archive.renumber_mesh(t.mesh, order)
    fields = archive.permute_nodes(t.fields("zeta"), order)
    stored = archive.write_archive(fields, f"fields_{uuid.uuid4().hex}", scratch_folder(t.spark, "archive"), 65_536, 16)
    found = locate_points(t.fixes.select("fix_id", "time", "x", "y"), mesh).where("host is not null")
    framed = asof_frames(found, t.frame_times)
    return ops.interp_2d_time(framed, stored, "zeta").select("fix_id", rd("zeta").alias("zeta"))


@query("interp_level_time", "SELECT fix_id, round(value, 6) + 0.0 AS thetao FROM fix_levels WHERE variable = 'thetao' AND level = 2")
def interp_level_time(t):
    return ops.interp_level_time(framed_fixes(t), t.fields("thetao"), "thetao", 2).select("fix_id", rd("thetao").alias("thetao"))


@query("adjust_boundary_phi", f"""
    WITH {HOSTS_SQL.strip()}, q AS (SELECT point_id, 1 - f1 - f2 AS f0, f1, f2, t.mask_c, m0, m1, m2 FROM hosts JOIN tri t ON t.element_id = host),
    g AS (SELECT *, CASE WHEN m0 = 0 THEN f0 ELSE -1 END AS g0, CASE WHEN m1 = 0 THEN f1 ELSE -1 END AS g1, CASE WHEN m2 = 0 THEN f2 ELSE -1 END AS g2 FROM q),
    b AS (SELECT *, CASE WHEN g0 >= g1 AND g0 >= g2 THEN 0 WHEN g1 >= g2 THEN 1 ELSE 2 END AS best FROM g)
    SELECT point_id, round(CASE WHEN mask_c = 1 THEN (best = 0)::INT ELSE f0 END::DOUBLE, 6) + 0.0 AS phi0,
      round(CASE WHEN mask_c = 1 THEN (best = 1)::INT ELSE f1 END::DOUBLE, 6) + 0.0 AS phi1,
      round(CASE WHEN mask_c = 1 THEN (best = 2)::INT ELSE f2 END::DOUBLE, 6) + 0.0 AS phi2 FROM b""")
def adjust_boundary_phi(t):
    out = ops.adjust_boundary_phi(located_points(t), t.mesh)
    return out.select("point_id", *[rd(f"phi{k}").alias(f"phi{k}") for k in range(3)])


@query("grad_2d_time", "SELECT fix_id, round(dx, 5) + 0.0 AS dx, round(dy, 5) + 0.0 AS dy FROM fix_grads WHERE variable = 'thetao' AND level = 1")
def grad_2d_time(t):
    out = ops.grad_2d_time(framed_fixes(t), t.fields("thetao"), t.mesh, "thetao", 1)
    return out.select("fix_id", rd("dthetao_dx", 5).alias("dx"), rd("dthetao_dy", 5).alias("dy"))


AROUND_SQL = """
    around AS (SELECT element_id AS e, element_id AS near FROM elems UNION ALL SELECT element_id, nb FROM adjacency WHERE nb >= 0),
    centre AS (SELECT element_id, (x0 + x1 + x2) / 3 AS xc, (y0 + y1 + y2) / 3 AS yc FROM tri)"""


@query("idw_neighbours", f"""
    WITH {HOSTS_SQL.strip()}, {AROUND_SQL.strip()}, w AS (SELECT point_id, near, 1 / (pow(x - xc, 2) + pow(y - yc, 2)) AS w
      FROM hosts JOIN around ON e = host JOIN centre ON element_id = near)
    SELECT point_id, round(sum(w * (near % 13)) / sum(w), 6) + 0.0 AS value FROM w GROUP BY 1""")
def idw_neighbours(t):
    values = t.mesh.elements.select("element_id", (C("element_id") % 13).cast("double").alias("value"))
    pts = located_points(t).select("point_id", "x", "y", "host")
    return ops.idw_neighbours(pts, values, t.mesh).select("point_id", rd("value").alias("value"))


@query("zmin_zmax", "SELECT fix_id, round(-h, 6) + 0.0 AS zmin, round(zeta, 6) + 0.0 AS zmax FROM fix_place")
def zmin_zmax(t):
    out = ops.zmin_zmax(framed_fixes(t), t.mesh.nodes, t.fields("zeta"))
    return out.select("fix_id", rd("zmin").alias("zmin"), rd("zmax").alias("zmax"))


@query("locate_level", """
    SELECT fix_id, CAST(k AS INT) AS k, round(omega, 6) + 0.0 AS omega, 0 AS in_surface, CAST(coalesce(k, 0) = 3 AS INT) AS in_bottom,
      CAST(CASE WHEN k IS NULL THEN -3 ELSE 0 END AS INT) AS level_flag FROM fix_place""")
def locate_level(t):
    out = ops.sample_variable(framed_fixes(t), t.fields("zeta", "thetao"), ["thetao"], LEVEL_DEPTHS, t.mesh.nodes)
    return out.select("fix_id", C("k").cast("int").alias("k"), rd("omega").alias("omega"), C("in_surface").cast("int").alias("in_surface"),
                      C("in_bottom").cast("int").alias("in_bottom"), "level_flag")


@query("sample_variable", """
    SELECT p.fix_id, round(v.value, 6) + 0.0 AS thetao FROM fix_place p LEFT JOIN fix_values v ON v.fix_id = p.fix_id AND v.variable = 'thetao'""")
def sample_variable(t):
    out = ops.sample_variable(framed_fixes(t), t.fields("zeta", "thetao"), ["thetao"], LEVEL_DEPTHS, t.mesh.nodes)
    return out.select("fix_id", rd("thetao").alias("thetao"))


@query("sample_velocity", """
    SELECT p.fix_id, round(u.value, 6) + 0.0 AS uo, round(v.value, 6) + 0.0 AS vo, round(w.value, 6) + 0.0 AS wo FROM fix_place p
    LEFT JOIN fix_values u ON u.fix_id = p.fix_id AND u.variable = 'uo' LEFT JOIN fix_values v ON v.fix_id = p.fix_id AND v.variable = 'vo'
    LEFT JOIN fix_values w ON w.fix_id = p.fix_id AND w.variable = 'wo'""")
def sample_velocity(t):
    out = ops.sample_velocity(framed_fixes(t), t.fields("zeta", "uo", "vo", "wo"), LEVEL_DEPTHS, t.mesh.nodes)
    return out.select("fix_id", *[rd(c).alias(c) for c in ("uo", "vo", "wo")])


# element data on two σ layers centred at −0.25 and −0.75
@query("sample_velocity_elements", f"""
    WITH {AROUND_SQL.strip()}, w AS (SELECT fix_id, near, 1 / (pow(x - xc, 2) + pow(y - yc, 2)) AS w FROM fix_place JOIN around ON e = host JOIN centre ON element_id = near),
    i AS (SELECT fix_id, sum(w * (near % 13)) / sum(w) AS i13, sum(w * (near % 7)) / sum(w) AS i7 FROM w GROUP BY 1),
    v AS (SELECT p.fix_id, (z - zeta) / (zeta + h) AS s, 0.1 * i13 + 0.05 * (DAYNUM(t_last) - 19723 + tf) AS v0,
      0.1 * i13 + 0.1 * (DAYNUM(t_last) - 19723 + tf) - 0.2 * i7 AS v1 FROM fix_place p JOIN i USING (fix_id))
    SELECT fix_id, CASE WHEN s <= 0 AND s >= -1 THEN round(CASE WHEN s >= -0.25 THEN v0 WHEN s <= -0.75 THEN v1 ELSE v1 + (s + 0.75) / 0.5 * (v0 - v1) END, 6) + 0.0 END AS uo FROM v""")
def sample_velocity_elements(t):
    placed = ops.sample_layers(framed_fixes(t), t.fields("zeta"), t.mesh.nodes, (0, -0.5, -1), (-0.25, -0.75))
    elems = t.mesh.elements.select("element_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("level"))
    lo, hi = t.first_and_last_frame
    rows = elems.withColumn("time", F.explode(F.sequence(F.lit(str(lo)).cast("timestamp_ntz"), F.lit(str(hi)).cast("timestamp_ntz"), F.expr("INTERVAL 1 DAY"))))
    day, e, k = F.unix_date(C("time").cast("date")) - 19723, C("element_id"), C("level")
    value = (e % 13) * F.lit(0.1) + day * F.lit(0.05) * (k + 1) - k * (e % 7) * F.lit(0.2)
    rows = rows.select("element_id", "time", "level", F.lit("uo").alias("variable"), value.alias("value"))
    pts = placed.select("fix_id", "x", "y", "host", "t_last", "t_next", "t_frac", "k", "in_surface", "in_bottom", "k_upper", "k_lower", "omega_layers")
    return ops.sample_velocity_elements(pts, rows, t.mesh, 2, ["uo"]).select("fix_id", rd("uo").alias("uo"))


@query("log_layer_velocity", """
    SELECT fix_id, round(CASE WHEN z + 30 <= 0.01 THEN 0 WHEN z < -25 THEN x * ln((z + 30) / 0.01) / ln(5 / 0.01) ELSE x END, 6) + 0.0 AS u FROM fixes""")
def log_layer_velocity(t):
    u = ops.log_layer_velocity(C("x"), C("z"), F.lit(-30.0), F.lit(-25.0), 0.01)
    return t.fixes.select("fix_id", rd(u).alias("u"))


# interfaces at σ 0, −0.2, −0.8, −1
SIGMA_SQL = """
    s AS (SELECT p.fix_id, z, zeta, h, (z - zeta) / (zeta + h) AS s, zeta + h AS d, max(CASE WHEN l.level = 0 THEN l.value END) AS k0, max(CASE WHEN l.level = 1 THEN l.value END) AS k1,
        max(CASE WHEN l.level = 2 THEN l.value END) AS k2, max(CASE WHEN l.level = 3 THEN l.value END) AS k3
      FROM fix_place p JOIN fix_levels l ON l.fix_id = p.fix_id AND l.variable = 'kz' GROUP BY ALL),
    g AS (SELECT *, (k0 - k1) / (0.2 * d) AS g0, (k0 - k2) / (0.8 * d) AS g1, (k1 - k3) / (0.8 * d) AS g2, (k2 - k3) / (0.2 * d) AS g3 FROM s)"""
SIGMA = dict(sigma_levels=(0, -0.2, -0.8, -1), sigma_layers=(-0.1, -0.5, -0.9))


@query("vertical_diffusivity", f"""
    WITH {SIGMA_SQL.strip()} SELECT fix_id, round(CASE WHEN s > 0 OR s < -1 THEN NULL WHEN s >= -0.2 THEN k1 + (s + 0.2) / 0.2 * (k0 - k1) WHEN s >= -0.8 THEN k2 + (s + 0.8) / 0.6 * (k1 - k2)
      ELSE k3 + (s + 1) / 0.2 * (k2 - k3) END, 6) + 0.0 AS kz FROM g""")
def vertical_diffusivity(t):
    out = ops.vertical_diffusivity(framed_fixes(t), t.fields("zeta", "kz"), t.mesh.nodes, **SIGMA)
    return out.select("fix_id", rd("kz").alias("kz"))


@query("vertical_diffusivity_gradient", f"""
    WITH {SIGMA_SQL.strip()} SELECT fix_id, round(CASE WHEN s > 0 OR s < -1 THEN NULL WHEN s >= -0.2 THEN g1 + (s + 0.2) / 0.2 * (g0 - g1) WHEN s >= -0.8 THEN g2 + (s + 0.8) / 0.6 * (g1 - g2)
      ELSE g3 + (s + 1) / 0.2 * (g2 - g3) END, 6) + 0.0 AS dkz_dz FROM g""")
def vertical_diffusivity_gradient(t):
    out = ops.vertical_diffusivity_gradient(framed_fixes(t), t.fields("zeta", "kz"), t.mesh.nodes, **SIGMA)
    return out.select("fix_id", rd("dkz_dz").alias("dkz_dz"))


# interfaces whose depths are fields: σ of each node, or s-levels with a critical depth
def _interfaces_sql(depths):
    z = ", ".join(f"sum(wt * ({d})) AS z{k}" for k, d in enumerate(depths))
    return f"""
    WITH w AS (SELECT h.fix_id, CASE s.slot WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS node_id, CASE f.k WHEN 0 THEN t_last ELSE t_next END AS time,
        CASE s.slot WHEN 0 THEN phi0 WHEN 1 THEN phi1 ELSE phi2 END * CASE f.k WHEN 0 THEN 1 - tf ELSE tf END AS wt
      FROM fix_hosts h, (SELECT unnest([0, 1, 2]) AS slot) s, (SELECT unnest([0, 1]) AS k) f),
    d AS (SELECT w.fix_id, {z} FROM w JOIN (SELECT node_id, time, value AS zeta FROM fields WHERE variable = 'zeta') f ON f.node_id = w.node_id AND f.time = w.time
      JOIN nodes n ON n.node_id = w.node_id GROUP BY 1),
    k AS (SELECT fix_id, max(CASE WHEN level = 0 THEN value END) AS k0, max(CASE WHEN level = 1 THEN value END) AS k1, max(CASE WHEN level = 2 THEN value END) AS k2,
        max(CASE WHEN level = 3 THEN value END) AS k3 FROM fix_levels WHERE variable = 'kz' GROUP BY 1)
    SELECT h.fix_id, round(CASE WHEN z > z0 OR z < z3 THEN NULL WHEN z >= z1 THEN k1 + (z - z1) / (z0 - z1) * (k0 - k1) WHEN z >= z2 THEN k2 + (z - z2) / (z1 - z2) * (k1 - k2)
      ELSE k3 + (z - z3) / (z2 - z3) * (k2 - k3) END, 6) + 0.0 AS kz FROM fix_hosts h JOIN d ON d.fix_id = h.fix_id JOIN k ON k.fix_id = h.fix_id"""


def _on_depth_fields(t, levels, **kw):
    fields = t.fields("zeta", "kz")
    depths = ops.depth_fields(fields, t.mesh.nodes, levels, **kw)
    out = ops.sample_layers(framed_fixes(t), fields.unionByName(depths.select(fields.columns)), t.mesh.nodes, on_levels=["kz"], n_levels=4)
    return out.select("fix_id", rd("kz").alias("kz"))


@query("sample_sigma_by_node", _interfaces_sql([f"zeta + ({s}) * (zeta + h)" for s in ("0", "-0.2 - (n.node_id % 5) / 100.0::DOUBLE", "-0.8 + (n.node_id % 7) / 100.0::DOUBLE", "-1")]))
def sample_sigma_by_node(t):
    sigma = F.array(F.lit(0.0), F.lit(-0.2) - (C("node_id") % 5) / 100.0, F.lit(-0.8) + (C("node_id") % 7) / 100.0, F.lit(-1.0))
    return _on_depth_fields(t, t.mesh.nodes.select("node_id", F.posexplode(sigma).alias("level", "sigma")))


S_LEVELS = ((0.0, 0.0), (-0.3, -0.1), (-0.7, -0.5), (-1.0, -1.0))


@query("sample_s_levels", _interfaces_sql([f"zeta + (zeta + h) * ((5 * ({a}::DOUBLE) + ({b}::DOUBLE) * h) / (5 + h))" for a, b in S_LEVELS]))
def sample_s_levels(t):
    return _on_depth_fields(t, S_LEVELS, hc=5.0)


# layer centres at σ −0.1, −0.3, −0.6, −0.9
@query("horizontal_diffusivity_layers", """
    WITH s AS (SELECT fix_id, (z - zeta) / (zeta + h) AS s FROM fix_place),
    g AS (SELECT fix_id, level, dx, dy FROM fix_grads WHERE variable = 'kz'), v AS (SELECT fix_id, level, value FROM fix_levels WHERE variable = 'kz'),
    p AS (SELECT *, CASE WHEN s > 0 OR s < -1 THEN NULL WHEN s >= -0.1 THEN 0 WHEN s >= -0.3 THEN 0 WHEN s >= -0.6 THEN 1 WHEN s > -0.9 THEN 2 ELSE 3 END AS a,
      CASE WHEN s >= -0.1 OR s <= -0.9 THEN 1 WHEN s >= -0.3 THEN (s + 0.3) / 0.2 WHEN s >= -0.6 THEN (s + 0.6) / 0.3 ELSE (s + 0.9) / 0.3 END AS o FROM s)
    SELECT p.fix_id, round(o * a.value + (1 - o) * coalesce(b.value, 0), 6) + 0.0 AS kz, round(o * c.dx + (1 - o) * coalesce(d.dx, 0), 5) + 0.0 AS dx,
      round(o * c.dy + (1 - o) * coalesce(d.dy, 0), 5) + 0.0 AS dy
    FROM p LEFT JOIN v a ON a.fix_id = p.fix_id AND a.level = p.a LEFT JOIN v b ON b.fix_id = p.fix_id AND b.level = p.a + 1
    LEFT JOIN g c ON c.fix_id = p.fix_id AND c.level = p.a LEFT JOIN g d ON d.fix_id = p.fix_id AND d.level = p.a + 1""")
def horizontal_diffusivity_layers(t):
    out = ops.horizontal_diffusivity_layers(framed_fixes(t), t.fields("zeta", "kz"), t.mesh, (0, -0.2, -0.4, -0.8, -1), (-0.1, -0.3, -0.6, -0.9), "kz")
    return out.select("fix_id", rd("kz").alias("kz"), rd("dkz_dx", 5).alias("dx"), rd("dkz_dy", 5).alias("dy"))


AT_DEPTH = "CASE WHEN p.k = 3 THEN {u} ELSE (1 - omega) * {l} + omega * {u} END"


@query("horizontal_diffusivity", f"""
    SELECT p.fix_id, round(v.value, 6) + 0.0 AS kz, round({AT_DEPTH.format(u='u.dx', l='l.dx')}, 5) + 0.0 AS dx, round({AT_DEPTH.format(u='u.dy', l='l.dy')}, 5) + 0.0 AS dy
    FROM fix_place p LEFT JOIN fix_values v ON v.fix_id = p.fix_id AND v.variable = 'kz'
    LEFT JOIN fix_grads u ON u.fix_id = p.fix_id AND u.variable = 'kz' AND u.level = p.k LEFT JOIN fix_grads l ON l.fix_id = p.fix_id AND l.variable = 'kz' AND l.level = p.k + 1""")
def horizontal_diffusivity(t):
    out = ops.horizontal_diffusivity(framed_fixes(t), t.fields("zeta", "kz"), t.mesh, LEVEL_DEPTHS, "kz")
    return out.select("fix_id", rd("kz").alias("kz"), rd("dkz_dx", 5).alias("dx"), rd("dkz_dy", 5).alias("dy"))


@query("smagorinsky_diffusivity", f"""
    WITH a AS (SELECT u.fix_id, u.level, 0.1 * u.area * sqrt(u.dx * u.dx + v.dy * v.dy + 0.5 * pow(u.dy + v.dx, 2)) AS value
      FROM fix_grads u JOIN fix_grads v ON v.fix_id = u.fix_id AND v.level = u.level AND v.variable = 'vo' WHERE u.variable = 'uo')
    SELECT p.fix_id, round({AT_DEPTH.format(u='u.value', l='l.value')}, 6) + 0.0 AS ah FROM fix_place p
    LEFT JOIN a u ON u.fix_id = p.fix_id AND u.level = p.k LEFT JOIN a l ON l.fix_id = p.fix_id AND l.level = p.k + 1""")
def smagorinsky_diffusivity(t):
    out = ops.smagorinsky_diffusivity(framed_fixes(t), t.fields("zeta", "uo", "vo"), t.mesh, LEVEL_DEPTHS)
    return out.select("fix_id", rd("ah").alias("ah"))


def _level_mask(t):
    """A node is dry on every fifth day counted from its id."""
    day = F.unix_date(C("time").cast("date"))
    return t.fields("zeta").select("node_id", "time", "level", ((C("node_id") + day) % 29 == 0).cast("int").alias("masked"))


WET_SQL = """
    wet AS (SELECT t.element_id, f.time, CAST(CASE WHEN (n0 + DAYNUM(f.time)) % 29 = 0 OR (n1 + DAYNUM(f.time)) % 29 = 0 OR (n2 + DAYNUM(f.time)) % 29 = 0
      THEN 0 ELSE 1 END AS INT) AS wet FROM tri t CROSS JOIN frame_times f WHERE t.mask_c <> 2)"""


@query("wet_elements", f"WITH {WET_SQL.strip()} SELECT element_id, time, wet FROM wet")
def wet_elements(t):
    return ops.wet_elements(t.mesh.elements, _level_mask(t))


@query("is_wet", f"""
    WITH {WET_SQL.strip()} SELECT fix_id, CAST(min(wet) AS INT) AS wet FROM fix_hosts h JOIN wet w ON w.element_id = h.host AND (w.time = h.t_last OR w.time = h.t_next) GROUP BY 1""")
def is_wet(t):
    pts = framed_fixes(t).select("fix_id", "host", "t_last", "t_next")
    return ops.is_wet(pts, ops.wet_elements(t.mesh.elements, _level_mask(t))).select("fix_id", "wet")


SURFACE_SQL = """
    SELECT a.fix_id, round(a.value, 6) + 0.0 AS {u}, round(b.value, 6) + 0.0 AS {v} FROM fix_levels a JOIN fix_levels b ON a.fix_id = b.fix_id
    WHERE a.variable = '{u}' AND b.variable = '{v}'"""


@query("sample_wind", SURFACE_SQL.format(u="u10", v="v10"))
def sample_wind(t):
    return ops.sample_wind(framed_fixes(t), t.fields("u10", "v10")).select("fix_id", rd("u10").alias("u10"), rd("v10").alias("v10"))


@query("sample_stokes", SURFACE_SQL.format(u="usd", v="vsd"))
def sample_stokes(t):
    return ops.sample_stokes(framed_fixes(t), t.fields("usd", "vsd")).select("fix_id", rd("usd").alias("usd"), rd("vsd").alias("vsd"))


def _profile_points(t):
    """One depth per order, in the month of its date."""
    return t.sql("SELECT o_orderkey AS id, TRUNC_MONTH(o_orderdate) AS time, -(o_totalprice % 29) - 1 AS z FROM orders")


@query("profile_linear", """
    WITH p AS (SELECT *, lag(z) OVER w AS z0, lead(z) OVER w AS z2, lag(value) OVER w AS v0, lead(value) OVER w AS v2 FROM profiles WINDOW w AS (PARTITION BY time ORDER BY z)),
    g AS (SELECT time, z, value, (coalesce(v2, value) - coalesce(v0, value)) / (coalesce(z2, z) - coalesce(z0, z)) AS g, z2, v2 FROM p),
    l AS (SELECT *, lead(g) OVER (PARTITION BY time ORDER BY z) AS g2 FROM g),
    o AS (SELECT o_orderkey AS id, TRUNC_MONTH(o_orderdate) AS time, -(o_totalprice % 29) - 1 AS zz FROM orders)
    SELECT id, round(arg_min(value + (zz - z) / (z2 - z) * (v2 - value), z), 6) + 0.0 AS value, round(arg_min(g + (zz - z) / (z2 - z) * (g2 - g), z), 6) + 0.0 AS gradient
    FROM o LEFT JOIN l ON l.time = o.time AND zz >= z AND zz <= z2 GROUP BY id""")
def profile_linear(t):
    out = ops.profile_linear(_profile_points(t), t.table("profiles"))
    return out.select("id", rd("value").alias("value"), rd("gradient").alias("gradient"))


# levels and values of the months around an order's day, interpolated in time before depth
@query("profile_in_time", """
    WITH o AS (SELECT o_orderkey AS id, TRUNC_MONTH(o_orderdate) AS t0, -(o_totalprice % 29) - 1 AS zz, CAST(SECS(o_orderdate) AS DOUBLE) AS s FROM orders),
    n AS (SELECT t0, (SELECT min(time) FROM profiles WHERE time > t0) AS t1 FROM (SELECT DISTINCT time AS t0 FROM profiles) q),
    f AS (SELECT o.id, o.zz, n.t0, n.t1, (s - SECS(n.t0)) / (SECS(n.t1) - SECS(n.t0)) AS f FROM o JOIN n ON n.t0 = o.t0 WHERE n.t1 IS NOT NULL),
    p AS (SELECT id, zz, (1 - f) * a.z + f * b.z AS z, (1 - f) * a.value + f * b.value AS v FROM f JOIN profiles a ON a.time = t0 JOIN profiles b ON b.time = t1 AND b.level = a.level),
    l AS (SELECT *, lead(z) OVER w AS z2, lead(v) OVER w AS v2 FROM p WINDOW w AS (PARTITION BY id ORDER BY z)),
    v AS (SELECT id, arg_min(v + (zz - z) / (z2 - z) * (v2 - v), z) AS value FROM l WHERE zz >= z AND zz <= z2 GROUP BY id)
    SELECT f.id, round(v.value, 6) + 0.0 AS value FROM f LEFT JOIN v ON v.id = f.id""")
def profile_in_time(t):
    profile = t.table("profiles")
    pts = t.sql("SELECT o_orderkey AS id, o_orderdate, -(o_totalprice % 29) - 1 AS z FROM orders").withColumn("time", C("o_orderdate").cast("timestamp_ntz"))
    framed = asof_frames(pts.select("id", "time", "z"), profile.select("time").distinct(), missing="drop")
    return ops.profile_in_time(framed, profile).select("id", rd("value").alias("value"))


@query("profile_spline", """
    WITH RECURSIVE p AS (SELECT time, z, value AS v, row_number() OVER (PARTITION BY time ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY time) AS n FROM profiles),
    q AS (SELECT a.*, b.z - a.z AS h, b.v AS v2, b.z AS z2 FROM p a LEFT JOIN p b ON b.time = a.time AND b.i = a.i + 1),
    up AS (SELECT time, i, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS d FROM q WHERE i = 0
      UNION ALL SELECT q.time, q.i, q.h / (2 * (l.h + q.h) - l.h * f.c), (6 * ((q.v2 - q.v) / q.h - (q.v - l.v) / l.h) - l.h * f.d) / (2 * (l.h + q.h) - l.h * f.c)
      FROM up f JOIN q ON q.time = f.time AND q.i = f.i + 1 JOIN q l ON l.time = f.time AND l.i = f.i WHERE q.i <= q.n - 2),
    down AS (SELECT time, n - 1 AS i, CAST(0 AS DOUBLE) AS m FROM q WHERE i = 0
      UNION ALL SELECT b.time, b.i - 1, f.d - f.c * b.m FROM down b JOIN up f ON f.time = b.time AND f.i = b.i - 1),
    l AS (SELECT q.*, a.m AS ma, b.m AS mb FROM q JOIN down a ON a.time = q.time AND a.i = q.i JOIN down b ON b.time = q.time AND b.i = q.i + 1),
    o AS (SELECT o_orderkey AS id, TRUNC_MONTH(o_orderdate) AS time, -(o_totalprice % 29) - 1 AS zz FROM orders)
    SELECT id, round(arg_min((ma * pow(z2 - zz, 3) + mb * pow(zz - z, 3)) / (6 * h) + (v / h - ma * h / 6) * (z2 - zz) + (v2 / h - mb * h / 6) * (zz - z), z), 5) + 0.0 AS value,
      round(arg_min((mb * pow(zz - z, 2) - ma * pow(z2 - zz, 2)) / (2 * h) + (v2 - v) / h - (mb - ma) * h / 6, z), 4) + 0.0 AS gradient
    FROM o LEFT JOIN l ON l.time = o.time AND zz >= z AND zz <= z2 GROUP BY id""")
def profile_spline(t):
    out = ops.profile_spline(_profile_points(t), t.table("profiles"))
    return out.select("id", rd("value", 5).alias("value"), rd("gradient", 4).alias("gradient"))


@query("time_series_at_depth", """
    WITH a AS (SELECT time, max(CASE WHEN z <= -12.5 THEN z END) AS z0, min(CASE WHEN z >= -12.5 THEN z END) AS z1 FROM profiles GROUP BY time)
    SELECT a.time, round(CASE WHEN z0 IS NULL THEN q.value WHEN z1 IS NULL OR z0 = z1 THEN p.value
      ELSE p.value + (-12.5 - z0) / (z1 - z0) * (q.value - p.value) END, 6) + 0.0 AS value
    FROM a LEFT JOIN profiles p ON p.time = a.time AND p.z = z0 LEFT JOIN profiles q ON q.time = a.time AND q.z = z1""")
def time_series_at_depth(t):
    return ops.time_series_at_depth(t.table("profiles"), -12.5).select("time", rd("value").alias("value"))


@query("profile_at", "SELECT time, level, z, value FROM profiles WHERE time = TIMESTAMP '1999-03-01'")
def profile_at(t):
    return ops.profile_at(t.table("profiles"), "1999-03-10").select("time", "level", "z", "value")


@query("hovmoller", """
    SELECT p.time, p.level, p.value, round(coalesce((p.z + a.z) / 2, 0), 6) + 0.0 AS z_upper, round(coalesce((p.z + b.z) / 2, -40), 6) + 0.0 AS z_lower
    FROM profiles p LEFT JOIN profiles a ON a.time = p.time AND a.level = p.level - 1 LEFT JOIN profiles b ON b.time = p.time AND b.level = p.level + 1
    WHERE b.time IS NOT NULL OR p.level = 5""")
def hovmoller(t):
    p = t.table("profiles")
    up = p.select("time", (C("level") + 1).alias("level"), C("z").alias("za"))
    edges = p.join(up, ["time", "level"], "left").select("time", "level", F.coalesce((C("z") + C("za")) / 2, F.lit(0.0)).alias("z"))
    floor = p.where("level = 5").select("time", F.lit(6).alias("level"), F.lit(-40.0).alias("z"))
    out = ops.hovmoller(p, edges.unionByName(floor))
    return out.select("time", "level", "value", rd("z_upper").alias("z_upper"), rd("z_lower").alias("z_lower"))


@query("sample_column", """
    WITH c AS (SELECT fix_id, depth_index, zeta, h, k0.*, -h + (zeta + h) / 4 * depth_index AS z FROM fix_place, (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS depth_index) k0),
    r AS (SELECT *, z - zeta AS rel FROM c),
    p AS (SELECT *, CASE WHEN rel >= -8 THEN 0 WHEN rel >= -16 THEN 1 WHEN rel >= -24 THEN 2 ELSE 3 END AS k, CASE WHEN rel >= -8 THEN (rel + 8) / 8 WHEN rel >= -16 THEN (rel + 16) / 8
      WHEN rel >= -24 THEN (rel + 24) / 8 ELSE 1 END AS omega FROM r),
    v AS (SELECT p.fix_id, p.depth_index, p.z, a.variable, (1 - omega) * coalesce(b.value, 0) + omega * a.value AS value FROM p JOIN fix_levels a ON a.fix_id = p.fix_id AND a.level = p.k
      LEFT JOIN fix_levels b ON b.fix_id = p.fix_id AND b.level = p.k + 1 AND b.variable = a.variable WHERE a.variable IN ('uo', 'vo'))
    SELECT fix_id, depth_index, round(z, 5) + 0.0 AS z, round(sqrt(sum(value * value)), 5) + 0.0 AS speed FROM v GROUP BY ALL""")
def sample_column(t):
    fields = t.fields("zeta", "uo", "vo")
    got = ops.zmin_zmax(framed_fixes(t), t.mesh.nodes, fields)
    rows = ops.sample_column(got.drop("z"), 5).drop("zmin", "zmax")
    out = ops.sample_velocity(rows, fields, LEVEL_DEPTHS, t.mesh.nodes, has_w=False)
    return out.select("fix_id", "depth_index", rd("z", 5).alias("z"), rd(ops.speed(), 5).alias("speed"))


# --- flagship -----------------------------------------------------------------------


@query("regrid", f"""
    WITH {HOSTS_SQL.strip()}, tm AS (SELECT unnest([TIMESTAMP '2024-01-03 05:00:00', TIMESTAMP '2024-01-11 17:30:00']) AS time),
    w AS (SELECT point_id, z AS depth, host, tm.time, n.node_id, CASE f.k WHEN 0 THEN TRUNC_DAY(tm.time) ELSE MKTS((DAYNUM(tm.time) + 1) * 86400) END AS ft,
        CASE s.slot WHEN 0 THEN 1 - f1 - f2 WHEN 1 THEN f1 ELSE f2 END AS phi,
        CASE f.k WHEN 0 THEN 1 - CAST(SECS(tm.time) % 86400 AS DOUBLE) / 86400 ELSE CAST(SECS(tm.time) % 86400 AS DOUBLE) / 86400 END AS tw, n.h
      FROM hosts JOIN tri t ON t.element_id = host, tm, (SELECT unnest([0, 1, 2]) AS slot) s, (SELECT unnest([0, 1]) AS k) f, nodes n
      WHERE n.node_id = CASE s.slot WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END),
    v AS (SELECT point_id, w.time, variable, level, sum(phi * tw * value) AS value FROM w JOIN fields f ON f.node_id = w.node_id AND f.time = w.ft
      WHERE variable IN ('zeta', 'uo', 'thetao') GROUP BY ALL),
    b AS (SELECT point_id, time, max(depth) AS rel, sum(phi * tw * h) AS h FROM w GROUP BY 1, 2),
    p AS (SELECT b.*, z.value AS zeta, rel + z.value >= -h AND rel <= 0 AS ok, CASE WHEN rel >= -8 THEN 0 WHEN rel >= -16 THEN 1 WHEN rel >= -24 THEN 2 ELSE 3 END AS k,
      CASE WHEN rel >= -8 THEN (rel + 8) / 8 WHEN rel >= -16 THEN (rel + 16) / 8 WHEN rel >= -24 THEN (rel + 24) / 8 ELSE 1 END AS omega
      FROM b JOIN v z ON z.point_id = b.point_id AND z.time = b.time AND z.variable = 'zeta'),
    o AS (SELECT p.point_id, p.time, a.variable, CASE WHEN ok THEN (1 - omega) * coalesce(l.value, 0) + omega * a.value END AS value
      FROM p JOIN v a ON a.point_id = p.point_id AND a.time = p.time AND a.level = p.k
      LEFT JOIN v l ON l.point_id = p.point_id AND l.time = p.time AND l.level = p.k + 1 AND l.variable = a.variable WHERE a.variable <> 'zeta')
    SELECT h.point_id, tm.time, h.host, round(u.value, 6) + 0.0 AS uo, round(c.value, 6) + 0.0 AS thetao FROM hosts h CROSS JOIN tm
    LEFT JOIN o u ON u.point_id = h.point_id AND u.time = tm.time AND u.variable = 'uo'
    LEFT JOIN o c ON c.point_id = h.point_id AND c.time = tm.time AND c.variable = 'thetao'""")
def regrid(t):
    targets = t.points.select("point_id", "x", "y", C("z").alias("depth"))
    out = regrid_op(t.fields("zeta", "uo", "thetao"), t.mesh, targets, ["2024-01-03 05:00:00", "2024-01-11 17:30:00"], ["uo", "thetao"],
                    LEVEL_DEPTHS, t.frame_times)
    return out.select("point_id", "time", "host", rd("uo").alias("uo"), rd("thetao").alias("thetao"))


@query("regrid_layers", f"""
    WITH {HOSTS_SQL.strip()}, tm AS (SELECT unnest([TIMESTAMP '2024-01-03 05:00:00', TIMESTAMP '2024-01-11 17:30:00']) AS time),
    w AS (SELECT point_id, z AS depth, host, tm.time, n.node_id, CASE f.k WHEN 0 THEN TRUNC_DAY(tm.time) ELSE MKTS((DAYNUM(tm.time) + 1) * 86400) END AS ft,
        CASE s.slot WHEN 0 THEN 1 - f1 - f2 WHEN 1 THEN f1 ELSE f2 END AS phi,
        CASE f.k WHEN 0 THEN 1 - CAST(SECS(tm.time) % 86400 AS DOUBLE) / 86400 ELSE CAST(SECS(tm.time) % 86400 AS DOUBLE) / 86400 END AS tw, n.h
      FROM hosts JOIN tri t ON t.element_id = host, tm, (SELECT unnest([0, 1, 2]) AS slot) s, (SELECT unnest([0, 1]) AS k) f, nodes n
      WHERE n.node_id = CASE s.slot WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END),
    v AS (SELECT point_id, w.time, variable, level, sum(phi * tw * value) AS value FROM w JOIN fields f ON f.node_id = w.node_id AND f.time = w.ft
      WHERE variable IN ('zeta', 'thetao') GROUP BY ALL),
    b AS (SELECT point_id, time, max(depth) AS rel, sum(phi * tw * h) AS h FROM w GROUP BY 1, 2),
    p AS (SELECT b.*, z.value AS zeta, rel / (z.value + h) AS s FROM b JOIN v z ON z.point_id = b.point_id AND z.time = b.time AND z.variable = 'zeta'),
    q AS (SELECT *, CASE WHEN s >= -0.3 THEN 0 WHEN s >= -0.6 THEN 1 WHEN s > -0.9 THEN 2 ELSE 3 END AS a,
      CASE WHEN s >= -0.1 OR s <= -0.9 THEN 1 WHEN s >= -0.3 THEN (s + 0.3) / 0.2 WHEN s >= -0.6 THEN (s + 0.6) / 0.3 ELSE (s + 0.9) / 0.3 END AS o FROM p WHERE s <= 0 AND s >= -1),
    r AS (SELECT q.point_id, q.time, o * a.value + (1 - o) * coalesce(l.value, 0) AS value FROM q JOIN v a ON a.point_id = q.point_id AND a.time = q.time AND a.level = q.a AND a.variable = 'thetao'
      LEFT JOIN v l ON l.point_id = q.point_id AND l.time = q.time AND l.level = q.a + 1 AND l.variable = 'thetao')
    SELECT h.point_id, tm.time, h.host, round(c.value, 6) + 0.0 AS thetao FROM hosts h CROSS JOIN tm LEFT JOIN r c ON c.point_id = h.point_id AND c.time = tm.time""")
def regrid_layers(t):
    targets = t.points.select("point_id", "x", "y", C("z").alias("depth"))
    out = regrid_op(t.fields("zeta", "thetao"), t.mesh, targets, ["2024-01-03 05:00:00", "2024-01-11 17:30:00"], ["thetao"], None, t.frame_times,
                    layers=dict(sigma_levels=(0, -0.2, -0.4, -0.8, -1), sigma_layers=(-0.1, -0.3, -0.6, -0.9)))
    return out.select("point_id", "time", "host", rd("thetao").alias("thetao"))


# the same lattice on the sphere: boundary elements take their nearest sea node
@query("regrid_on_sphere", """
    WITH tm AS (SELECT unnest([TIMESTAMP '2024-01-03 05:00:00', TIMESTAMP '2024-01-11 17:30:00']) AS time),
    g AS (SELECT p.point_id, p.z AS depth, l.host, n0, n1, n2, mask_c, phi0, phi1, 1 - phi0 - phi1 AS phi2,
        CASE WHEN m0 = 0 THEN phi0 ELSE -1 END AS g0, CASE WHEN m1 = 0 THEN phi1 ELSE -1 END AS g1, CASE WHEN m2 = 0 THEN 1 - phi0 - phi1 ELSE -1 END AS g2
      FROM points p JOIN geo_located l USING (point_id) JOIN tri t ON t.element_id = l.host WHERE mask_c <> 2),
    b AS (SELECT *, CASE WHEN mask_c <> 1 THEN -1 WHEN g0 >= g1 AND g0 >= g2 THEN 0 WHEN g1 >= g2 THEN 1 ELSE 2 END AS best FROM g),
    w AS (SELECT point_id, depth, host, tm.time, CASE s.slot WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS node_id,
        CASE f.k WHEN 0 THEN TRUNC_DAY(tm.time) ELSE MKTS((DAYNUM(tm.time) + 1) * 86400) END AS ft,
        CASE WHEN best >= 0 THEN CASE WHEN best = s.slot THEN 1.0::DOUBLE ELSE 0 END WHEN s.slot = 0 THEN phi0 WHEN s.slot = 1 THEN phi1 ELSE phi2 END AS phi,
        CASE f.k WHEN 0 THEN 1 - CAST(SECS(tm.time) % 86400 AS DOUBLE) / 86400 ELSE CAST(SECS(tm.time) % 86400 AS DOUBLE) / 86400 END AS tw
      FROM b, tm, (SELECT unnest([0, 1, 2]) AS slot) s, (SELECT unnest([0, 1]) AS k) f),
    v AS (SELECT point_id, w.time, variable, level, sum(phi * tw * value) AS value FROM w JOIN fields f ON f.node_id = w.node_id AND f.time = w.ft
      WHERE variable IN ('zeta', 'thetao') GROUP BY ALL),
    d AS (SELECT point_id, w.time, max(host) AS host, max(depth) AS rel, sum(phi * tw * h) AS h FROM w JOIN nodes n ON n.node_id = w.node_id GROUP BY 1, 2),
    p AS (SELECT d.*, rel + z.value >= -h AND rel <= 0 AS ok, CASE WHEN rel >= -8 THEN 0 WHEN rel >= -16 THEN 1 WHEN rel >= -24 THEN 2 ELSE 3 END AS k,
      CASE WHEN rel >= -8 THEN (rel + 8) / 8 WHEN rel >= -16 THEN (rel + 16) / 8 WHEN rel >= -24 THEN (rel + 24) / 8 ELSE 1 END AS omega
      FROM d JOIN v z ON z.point_id = d.point_id AND z.time = d.time AND z.variable = 'zeta'),
    o AS (SELECT p.point_id, p.time, host, CASE WHEN ok THEN (1 - omega) * coalesce(l.value, 0) + omega * a.value END AS value
      FROM p JOIN v a ON a.point_id = p.point_id AND a.time = p.time AND a.level = p.k AND a.variable = 'thetao'
      LEFT JOIN v l ON l.point_id = p.point_id AND l.time = p.time AND l.level = p.k + 1 AND l.variable = 'thetao')
    SELECT q.point_id, tm.time, o.host, round(o.value, 6) + 0.0 AS thetao FROM points q CROSS JOIN tm LEFT JOIN o ON o.point_id = q.point_id AND o.time = tm.time""")
def regrid_on_sphere(t):
    targets = t.geo_points.select("point_id", "x", "y", C("z").alias("depth"))
    out = regrid_op(t.fields("zeta", "thetao"), t.geo_mesh, targets, ["2024-01-03 05:00:00", "2024-01-11 17:30:00"], ["thetao"], LEVEL_DEPTHS, t.frame_times)
    return out.select("point_id", "time", "host", rd("thetao").alias("thetao"))


# three components, here on one mesh: the horizontal ones on layers, the vertical one on interfaces
@query("sample_velocity_staggered", """
    WITH s AS (SELECT p.fix_id, (z - zeta) / (zeta + h) AS s FROM fix_place p),
    l AS (SELECT fix_id, variable, max(CASE WHEN level = 0 THEN value END) AS v0, max(CASE WHEN level = 1 THEN value END) AS v1, max(CASE WHEN level = 2 THEN value END) AS v2,
      max(CASE WHEN level = 3 THEN value END) AS v3 FROM fix_levels WHERE variable IN ('uo', 'wo') GROUP BY 1, 2)
    SELECT fix_id, round(CASE WHEN s > 0 OR s < -1 THEN NULL WHEN s >= -0.1 THEN u.v0 WHEN s <= -0.9 THEN u.v2 WHEN s >= -0.5 THEN u.v1 + (s + 0.5) / 0.4 * (u.v0 - u.v1)
        ELSE u.v2 + (s + 0.9) / 0.4 * (u.v1 - u.v2) END, 6) + 0.0 AS uo,
      round(CASE WHEN s > 0 OR s < -1 THEN NULL WHEN s >= -0.2 THEN w.v1 + (s + 0.2) / 0.2 * (w.v0 - w.v1) WHEN s >= -0.8 THEN w.v2 + (s + 0.8) / 0.6 * (w.v1 - w.v2)
        ELSE w.v3 + (s + 1) / 0.2 * (w.v2 - w.v3) END, 6) + 0.0 AS wo
    FROM s JOIN l u USING (fix_id) JOIN l w USING (fix_id) WHERE u.variable = 'uo' AND w.variable = 'wo'""")
def sample_velocity_staggered(t):
    placed = ops.sample_layers(framed_fixes(t), t.fields("zeta"), t.mesh.nodes, **SIGMA)
    sources = {"uo": (t.mesh, t.fields("uo").where("level < 3"), 3), "wo": (t.mesh, t.fields("wo"), 4)}
    pts = placed.select("fix_id", "x", "y", "t_last", "t_next", "t_frac", "k", "omega", "in_surface", "in_bottom", "k_upper", "k_lower", "omega_layers")
    return ops.sample_velocity_staggered(pts, sources, key="fix_id").select("fix_id", rd("uo").alias("uo"), rd("wo").alias("wo"))


@query("profile_diffusivity", """
    WITH p AS (SELECT *, value - 35 AS v FROM profiles), l AS (SELECT *, lead(z) OVER w AS z2, lead(v) OVER w AS v2 FROM p WINDOW w AS (PARTITION BY time ORDER BY z)),
    o AS (SELECT o_orderkey AS id, TRUNC_MONTH(o_orderdate) AS time, -(o_totalprice % 29) - 1 AS zz FROM orders)
    SELECT id, round(CASE WHEN max(z) IS NOT NULL THEN greatest(0, arg_min(v + (zz - z) / (z2 - z) * (v2 - v), z)) END, 6) + 0.0 AS value
    FROM o LEFT JOIN l ON l.time = o.time AND zz >= z AND zz <= z2 GROUP BY id""")
def profile_diffusivity(t):
    profile = t.table("profiles").withColumn("value", C("value") - 35)
    return ops.profile_diffusivity(_profile_points(t), profile).select("id", rd("value").alias("value"))
