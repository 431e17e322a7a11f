"""Queries: trajectory analytics."""

from pyspark.sql import functions as F

from spark_drift.operators import analytics as ops
from spark_drift.plans.registry import query, rd
from spark_drift.plans.tables import LEVEL_DEPTHS, ORACLE_ONLY
from spark_drift.util import shuffled

C = F.col


@query("sample_along_paths", """
    SELECT f.fix_id, f.particle_id, round(p.h, 6) + 0.0 AS h, round(p.zeta, 6) + 0.0 AS zeta, round(u.value, 6) + 0.0 AS thetao, round(w.value, 6) + 0.0 AS u10
    FROM fixes f LEFT JOIN fix_place p ON p.fix_id = f.fix_id LEFT JOIN fix_values u ON u.fix_id = f.fix_id AND u.variable = 'thetao'
    LEFT JOIN fix_levels w ON w.fix_id = f.fix_id AND w.variable = 'u10'""")
def sample_along_paths(t):
    out = ops.sample_along_paths(t.fixes, t.fields("zeta", "thetao", "u10"), t.mesh, t.frame_times, LEVEL_DEPTHS, ["thetao"], ["zeta", "u10"])
    return out.select("fix_id", "particle_id", *[rd(c).alias(c) for c in ("h", "zeta", "thetao", "u10")])


# layer centres at σ −0.1, −0.3, −0.6, −0.9 between interfaces at 0, −0.2, −0.4, −0.8, −1
LAYERS = dict(sigma_levels=(0, -0.2, -0.4, -0.8, -1), sigma_layers=(-0.1, -0.3, -0.6, -0.9))


@query("sample_along_paths_layers", """
    WITH s AS (SELECT fix_id, (z - zeta) / (zeta + h) AS s FROM fix_place), v AS (SELECT fix_id, level, value FROM fix_levels WHERE variable = 'thetao'),
    p AS (SELECT *, CASE WHEN s >= -0.3 THEN 0 WHEN s >= -0.6 THEN 1 WHEN s > -0.9 THEN 2 ELSE 3 END AS a,
      CASE WHEN s >= -0.1 OR s <= -0.9 THEN 1 WHEN s >= -0.3 THEN (s + 0.3) / 0.2 WHEN s >= -0.6 THEN (s + 0.6) / 0.3 ELSE (s + 0.9) / 0.3 END AS o FROM s WHERE s <= 0 AND s >= -1)
    SELECT f.fix_id, round(q.zeta, 6) + 0.0 AS zeta, round(o * a.value + (1 - o) * coalesce(b.value, 0), 6) + 0.0 AS thetao FROM fixes f LEFT JOIN fix_place q ON q.fix_id = f.fix_id
    LEFT JOIN p ON p.fix_id = f.fix_id LEFT JOIN v a ON a.fix_id = p.fix_id AND a.level = p.a LEFT JOIN v b ON b.fix_id = p.fix_id AND b.level = p.a + 1""")
def sample_along_paths_layers(t):
    out = ops.sample_along_paths(t.fixes, t.fields("zeta", "thetao"), t.mesh, t.frame_times, None, ["thetao"], layers=LAYERS)
    return out.select("fix_id", rd("zeta").alias("zeta"), rd("thetao").alias("thetao"))


# every eleventh node and level of thetao is masked: over a masked lower level the level above counts alone
@query("sample_along_paths_masked", """
    WITH w AS (SELECT h.fix_id, CASE s.slot WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS node_id, CASE f.k WHEN 0 THEN t_last ELSE t_next END AS time,
        CASE s.slot WHEN 0 THEN phi0 WHEN 1 THEN phi1 ELSE phi2 END * CASE f.k WHEN 0 THEN 1 - tf ELSE tf END AS wt
      FROM fix_hosts h, (SELECT unnest([0, 1, 2]) AS slot) s, (SELECT unnest([0, 1]) AS k) f),
    m AS (SELECT w.fix_id, f.level, sum(CASE WHEN (f.node_id + f.level) % 11 = 0 THEN 0 ELSE wt * f.value END) AS value,
        max(CASE WHEN (f.node_id + f.level) % 11 = 0 THEN 1 ELSE 0 END) AS gap
      FROM w JOIN fields f ON f.node_id = w.node_id AND f.time = w.time WHERE f.variable = 'thetao' GROUP BY 1, 2)
    SELECT f.fix_id, round(p.zeta, 6) + 0.0 AS zeta, round(CASE WHEN p.k = 3 THEN CASE WHEN a.gap = 0 THEN a.value END WHEN a.gap = 0 AND b.gap = 1 THEN a.value
      ELSE (1 - omega) * b.value + omega * a.value END, 6) + 0.0 AS thetao
    FROM fixes f LEFT JOIN fix_place p ON p.fix_id = f.fix_id LEFT JOIN m a ON a.fix_id = f.fix_id AND a.level = p.k LEFT JOIN m b ON b.fix_id = f.fix_id AND b.level = p.k + 1""")
def sample_along_paths_masked(t):
    hole = (C("variable") == "thetao") & ((C("node_id") + C("level")) % 11 == 0)
    fields = t.fields("zeta", "thetao").withColumn("value", F.when(~hole, C("value")))
    out = ops.sample_along_paths(t.fixes, fields, t.mesh, t.frame_times, LEVEL_DEPTHS, ["thetao"])
    return out.select("fix_id", rd("zeta").alias("zeta"), rd("thetao").alias("thetao"))


@query("select_group", "SELECT fix_id, group_id FROM fixes WHERE group_id IN (3, 22)")
def select_group(t):
    return ops.select_group(t.fixes, [3, 22]).select("fix_id", "group_id")


@query("positions_at", """
    WITH r AS (SELECT *, CAST(group_id AS INT) AS g FROM fixes), e AS (SELECT group_id, date_trunc('hour', min(time)) + to_seconds(CAST(d AS BIGINT)) AS at, d AS delta_s
      FROM fixes, (SELECT unnest([0.0::DOUBLE, 86400, 432000]) AS d) x GROUP BY group_id, d)
    SELECT fix_id, f.group_id, delta_s FROM fixes f JOIN e ON e.group_id = f.group_id AND date_trunc('hour', f.time) = e.at""")
def positions_at(t):
    hourly = t.fixes.withColumn("time", F.date_trunc("hour", "time").cast("timestamp_ntz"))
    return ops.positions_at(hourly, [0, 86400, 432000], release="group_id").select("fix_id", "group_id", "delta_s")


@query("paths_until", "SELECT particle_id, time, fix_id, x, y FROM fixes WHERE time <= TIMESTAMP '2024-01-10 12:00:00'")
def paths_until(t):
    return ops.paths_until(t.fixes, "2024-01-10 12:00:00").select("particle_id", "time", "fix_id", "x", "y")


# members (particle_id mod 4) and dates (days); six levels that move with the day, between −30 and 0.5
ORACLE_ONLY["day_levels"] = """
    SELECT time, CAST(k AS INT) AS level, -(k * 5.0::DOUBLE) - 1 - (DAYNUM(time) % 3) * 0.3::DOUBLE AS z, -30.0::DOUBLE AS lo, 0.5::DOUBLE AS hi FROM frame_times, range(6) r(k)"""
ORACLE_ONLY["member_density"] = """
    SELECT l.time, l.level, l.z, s.release, sum(exp(-0.5 * pow((l.z - f.z) / h, 2)) + exp(-0.5 * pow((l.z - 2 * lo + f.z) / h, 2)) + exp(-0.5 * pow((l.z - 2 * hi + f.z) / h, 2)))
      / (max(n) * max(h) * sqrt(2 * pi())) AS density
    FROM (SELECT release, time, count(*) AS n, stddev_samp(z) * pow(4 / (3 * count(*)), 0.2) AS h FROM day_fixes GROUP BY 1, 2) s
    JOIN day_fixes f ON f.release = s.release AND f.time = s.time JOIN day_levels l ON l.time = s.time GROUP BY 1, 2, 3, 4"""


def _levels(t):
    rows = t.frame_times.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(5))))
    day = F.unix_date(C("time").cast("date"))
    return rows.withColumns({"z": -(C("level") * F.lit(5.0)) - 1 - (day % 3) * F.lit(0.3), "lo": F.lit(-30.0), "hi": F.lit(0.5)})


@query("density_1d", "SELECT time, level, round(z, 6) + 0.0 AS z, round(avg(density), 8) + 0.0 AS density FROM member_density GROUP BY 1, 2, 3")
def density_1d(t):
    out = ops.density_1d(t.table("day_fixes"), _levels(t), 6)
    return out.select("time", "level", rd("z").alias("z"), rd("density", 8).alias("density"))


# evaluation points: one per nation
ORACLE_ONLY["eval_points"] = "SELECT CAST(n_nationkey AS INT) AS slot, CAST(n_nationkey % 5 AS DOUBLE) * 2 + 1 AS ex, floor(n_nationkey / 5) * 2.0::DOUBLE + 1 AS ey FROM nation"


def _points(t):
    k = C("n_nationkey")
    return t.base("nation").select(k.cast("int").alias("slot"), ((k % 5).cast("double") * 2 + 1).alias("ex"), (F.floor(k / 5) * F.lit(2.0) + 1).alias("ey"))


KERNEL_2D = """
    stat AS (SELECT {by}, count(*) AS n, var_samp(x) * pow(count(*), -1.0 / 3) AS xx, var_samp(y) * pow(count(*), -1.0 / 3) AS yy,
      covar_samp(x, y) * pow(count(*), -1.0 / 3) AS xy FROM {rows} GROUP BY ALL),
    det AS (SELECT *, xx * yy - xy * xy AS d FROM stat WHERE xx * yy - xy * xy > 1e-9 * xx * yy),
    dens AS (SELECT {by}, slot, sum(exp(-0.5 * (yy * pow(ex - x, 2) - 2 * xy * (ex - x) * (ey - y) + xx * pow(ey - y, 2)) / d)) / (max(n) * 2 * pi() * sqrt(max(d))) AS density
      FROM {rows} JOIN det USING ({by}) {evals} GROUP BY ALL)"""


@query("density_2d", f"""
    WITH first AS (SELECT release, min(time) AS t0 FROM day_fixes GROUP BY 1),
    sel AS (SELECT f.release, d AS delta_s, x, y FROM day_fixes f JOIN first USING (release), (SELECT unnest([0.0::DOUBLE, 86400, 864000]) AS d) q
      WHERE f.time = t0 + to_seconds(CAST(d AS BIGINT))),
    {KERNEL_2D.format(by='release, delta_s', rows='sel', evals='CROSS JOIN eval_points').strip()}
    SELECT delta_s, slot, round(avg(density), 8) + 0.0 AS density, count(*) AS members FROM dens GROUP BY 1, 2""")
def density_2d(t):
    out = ops.density_2d(t.table("day_fixes"), _points(t), [0, 86400, 864000])
    return out.select("delta_s", "slot", rd("density", 8).alias("density"), "members")


@query("density_hovmoller", """
    SELECT time, level, round(z, 6) + 0.0 AS z, round(avg(density) * 100, 6) + 0.0 AS concentration FROM member_density
    WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY 1, 2, 3""")
def density_hovmoller(t):
    out = ops.density_hovmoller(t.table("day_fixes"), _levels(t), "2024-01-05", "2024-01-12", 100.0)
    return out.select("time", "level", rd("z").alias("z"), rd("concentration").alias("concentration"))


@query("histogram_depth", """
    WITH e AS (SELECT CAST(k AS INT) AS bin, -30 + 5.0::DOUBLE * k AS lo, -25 + 5.0::DOUBLE * k AS hi FROM range(6) r(k))
    SELECT t.time, bin, count(f.fix_id) AS n FROM (SELECT DISTINCT time FROM day_fixes) t CROSS JOIN e
    LEFT JOIN day_fixes f ON f.time = t.time AND f.z >= lo AND (f.z < hi OR (bin = 5 AND f.z = hi)) GROUP BY 1, 2""")
def histogram_depth(t):
    return ops.histogram_depth(t.table("day_fixes"), [-30, -25, -20, -15, -10, -5, 0])


@query("mixing_check", """
    SELECT level, round(avg(density), 8) + 0.0 AS mean, round(stddev_pop(density), 8) + 0.0 AS std, CAST(200 AS DOUBLE) AS expected FROM member_density GROUP BY 1""")
def mixing_check(t):
    density = ops.member_density_1d(t.table("day_fixes"), _levels(t), 6)
    return ops.mixing_check(density, 1000, 6).select("level", rd("mean", 8).alias("mean"), rd("std", 8).alias("std"), "expected")


@query("survival_curve", """
    SELECT time, sum(CASE WHEN particle_id % 30 > DAYNUM(time) - 19723 THEN 1 ELSE 0 END)::BIGINT AS n_alive, count(*) AS n,
      round((SELECT sum(CASE WHEN particle_id % 30 > DAYNUM(time) - 19723 THEN 1 ELSE 0 END) FROM day_fixes WHERE time = (SELECT min(time) FROM day_fixes)) * exp(-1e-6 * (DAYNUM(time) - (SELECT min(DAYNUM(time)) FROM day_fixes)) * 86400), 6) + 0.0 AS expected FROM day_fixes GROUP BY time""")
def survival_curve(t):
    day = F.unix_date(C("time").cast("date")) - 19723
    fixes = t.table("day_fixes").withColumn("is_alive", (C("particle_id") % 30 > day).cast("int"))
    return ops.survival_curve(fixes, 1e-6).select("time", "n_alive", "n", rd("expected").alias("expected"))


@query("status_summary", """
    WITH d AS (SELECT date_trunc('day', time) AS time, group_id, in_domain, is_beached, error_status, land_boundary_encounters FROM fixes)
    SELECT time, group_id, count(*) AS n, sum(in_domain)::BIGINT AS n_in_domain, sum(is_beached)::BIGINT AS n_beached, sum(error_status)::BIGINT AS n_error,
      sum(land_boundary_encounters)::BIGINT AS land_encounters FROM d GROUP BY CUBE (time, group_id)""")
def status_summary(t):
    return ops.status_summary(t.fixes.withColumn("time", F.date_trunc("day", "time").cast("timestamp_ntz")))


INTEGRAL_SQL = """
    integral AS (SELECT f.time, f.node_id, (z.value + n.h) * sum(CASE f.level WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 WHEN 2 THEN 0.4 ELSE 0.1 END * f.value) AS value
      FROM fields f JOIN fields z ON z.variable = 'zeta' AND z.time = f.time AND z.node_id = f.node_id JOIN nodes n ON n.node_id = f.node_id
      WHERE f.variable = 'thetao' GROUP BY f.time, f.node_id, z.value, n.h)"""


def _integral(t):
    interfaces = t.spark.createDataFrame([(0, 0.0), (1, -0.2), (2, -0.5), (3, -0.9), (4, -1.0)], "level int, sigma double")
    surface = t.fields("zeta").select("time", "node_id", C("value").alias("zeta"))
    return ops.depth_integral(t.fields("thetao").select("time", "node_id", "level", "value"), interfaces, surface, t.mesh.nodes)


@query("depth_integral", f"WITH {INTEGRAL_SQL.strip()} SELECT time, node_id, round(value, 5) + 0.0 AS value FROM integral")
def depth_integral(t):
    return _integral(t).select("time", "node_id", rd("value", 5).alias("value"))


@query("rmse_profile", """
    SELECT round(sqrt(avg(pow(density * 10 - (0.3 + level * 0.01), 2))), 8) + 0.0 AS rmse FROM member_density""")
def rmse_profile(t):
    profile = _levels(t).withColumn("value", C("level") * F.lit(0.01) + F.lit(0.3))
    return ops.rmse_profile(t.table("day_fixes"), profile, 10.0, 6).select(rd("rmse", 8).alias("rmse"))


@query("rmse_field", f"""
    WITH {INTEGRAL_SQL.strip()}, top AS (SELECT * FROM (SELECT i.*, x AS ex, y AS ey, row_number() OVER (PARTITION BY time ORDER BY round(value, 5) DESC, node_id) - 1 AS slot
      FROM integral i JOIN nodes USING (node_id)) q WHERE slot < 20),
    {KERNEL_2D.format(by='release, time', rows='day_fixes', evals='JOIN top ev USING (time)').strip()}
    SELECT round(sqrt(avg(pow(density * 1000 - round(value, 5), 2))), 5) + 0.0 AS rmse, count(*) AS n FROM dens JOIN top USING (time, slot)""")
def rmse_field(t):
    field = _integral(t).join(shuffled(t.mesh.nodes.select("node_id", "x", "y")), "node_id").withColumn("value", F.round("value", 5))
    return ops.rmse_field(t.table("day_fixes"), field, 20, 1000.0).select(rd("rmse", 5).alias("rmse"), "n")


@query("plan_extent", "SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM fixes")
def plan_extent(t):
    return ops.plan_extent(t.fixes)


@query("cartesian_offset", """
    SELECT fix_id, round(x + 3 - (SELECT min(x) + 3 FROM nodes), 6) + 0.0 AS x, round(y - 2 - (SELECT min(y) - 2 FROM nodes), 6) + 0.0 AS y,
      round(x + 3, 6) + 0.0 AS back FROM fixes""")
def cartesian_offset(t):
    nodes = t.mesh.nodes.withColumns({"x": C("x") + 3, "y": C("y") - 2})
    moved = t.fixes.select("fix_id", (C("x") + 3).alias("x"), (C("y") - 2).alias("y"))
    there = ops.cartesian_offset(moved, nodes)
    back = ops.cartesian_offset(there, nodes, undo=True).select("fix_id", rd("x").alias("back"))
    return there.select("fix_id", rd("x").alias("x"), rd("y").alias("y")).join(back, "fix_id")
