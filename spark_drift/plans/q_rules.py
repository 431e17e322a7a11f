"""Queries: row rules on particle tables."""

from pyspark.sql import functions as F

from spark_drift.operators import rules as ops
from spark_drift.plans.q_locate import MOVES_SQL, moves
from spark_drift.plans.q_zones import draw
from spark_drift.plans.registry import query, rd

C = F.col


def _states(t):
    fid = C("fix_id")
    return t.fixes.withColumns({"zmin": F.lit(-20.0) - fid % 8, "zmax": (fid % 5) * F.lit(0.25) - 1, "z0": C("z")})


STATES = "st AS (SELECT *, -20.0::DOUBLE - fix_id % 8 AS zmin, (fix_id % 5) * 0.25::DOUBLE - 1 AS zmax FROM fixes)"


@query("total_velocity", """
    SELECT fix_id, round(x + 0.03 * y + CASE WHEN fix_id % 2 = 0 THEN z ELSE 0 END, 6) + 0.0 AS u, round(y + 0.03 * x, 6) + 0.0 AS v, round(z - 0.5, 6) + 0.0 AS w FROM fixes""")
def total_velocity(t):
    df = t.fixes.select("fix_id", C("x").alias("uo"), C("y").alias("vo"), C("z").alias("wo"), C("y").alias("u10"), C("x").alias("v10"),
                        F.when(C("fix_id") % 2 == 0, C("z")).alias("usd"), F.lit(None).cast("double").alias("vsd"), F.lit(0.5).alias("ws"))
    return ops.total_velocity(df, 0.03, "ws").select("fix_id", *[rd(c).alias(c) for c in "uvw"])


@query("settling_velocity", f"""
    WITH e AS (SELECT fix_id, particle_id, epoch(time) - epoch((SELECT min(time) FROM fixes)) AS s FROM fixes)
    SELECT fix_id, round(CASE WHEN s < 864000 THEN 0 ELSE 0.001 + {draw("'settling'", "'3'", 'particle_id')} * 0.004 END, 8) + 0.0 AS ws,
      CAST(s < 864000 AS INT) AS held FROM e""")
def settling_velocity(t):
    first = t.fixes.agg(F.min("time")).first()[0]
    elapsed = F.unix_seconds(C("time").cast("timestamp")) - F.unix_seconds(F.lit(str(first)).cast("timestamp_ntz").cast("timestamp"))
    df = t.fixes.select("fix_id", "particle_id", elapsed.alias("elapsed_s"))
    out = ops.settling_velocity(df, "uniform", low=0.001, high=0.005, delay_s=864000, seed=3)
    return out.select("fix_id", rd("ws", 8).alias("ws"), "held")


# the fold written as repeated mirrors
@query("reflect_vertical", f"""
    WITH RECURSIVE {STATES}, f(fix_id, z, zmin, zmax, k) AS (SELECT fix_id, z * 3, zmin, zmax, 0 FROM st UNION ALL
      SELECT fix_id, CASE WHEN z < zmin THEN 2 * zmin - z ELSE 2 * zmax - z END, zmin, zmax, k + 1 FROM f WHERE z < zmin OR z > zmax)
    SELECT fix_id, round(arg_max(z, k), 6) + 0.0 AS z FROM f GROUP BY fix_id""")
def reflect_vertical(t):
    return ops.reflect_vertical(_states(t).withColumn("z", C("z") * 3)).select("fix_id", rd("z").alias("z"))


@query("absorb_bottom", f"""
    WITH {STATES} SELECT fix_id, CAST(CASE WHEN z < zmin OR (z > zmax AND 2 * zmax - z < zmin) THEN -5 ELSE 0 END AS INT) AS flag,
      round(CASE WHEN z > zmax AND 2 * zmax - z >= zmin THEN 2 * zmax - z ELSE z END, 6) + 0.0 AS z FROM st""")
def absorb_bottom(t):
    return ops.absorb_bottom(_states(t)).select("fix_id", "flag", rd("z").alias("z"))


@query("apply_land_rule", f"""
    WITH {MOVES_SQL.strip()}, f AS (SELECT *, ((x_new - sx) * (ex - sx) + (y_new - sy) * (ey - sy)) / ((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) AS k
      FROM mv LEFT JOIN wall USING (move_id) LEFT JOIN ends USING (move_id) LEFT JOIN tri t ON t.element_id = e)
    SELECT move_id, round(CASE WHEN we IS NULL THEN x_new ELSE 2 * (sx + k * (ex - sx)) - x_new END, 6) + 0.0 AS x_end,
      round(CASE WHEN we IS NULL THEN y_new ELSE 2 * (sy + k * (ey - sy)) - y_new END, 6) + 0.0 AS y_end,
      round(CASE WHEN we IS NULL THEN x_new ELSE x END, 6) + 0.0 AS x_back,
      CAST(CASE WHEN we IS NOT NULL THEN 0 WHEN mask_c <> 2 THEN 0 ELSE -3 END AS INT) AS flag,
      CAST(CASE WHEN we IS NOT NULL THEN -6 WHEN mask_c <> 2 THEN 0 ELSE -3 END AS INT) AS absorbed, CAST(we IS NOT NULL AS INT) AS land_hits FROM f""")
def apply_land_rule(t):
    m = moves(t)
    out = ops.apply_land_rule(m, t.mesh, "reflecting").select("move_id", rd("x_end").alias("x_end"), rd("y_end").alias("y_end"), "flag", "land_hits")
    back = ops.apply_land_rule(m, t.mesh, "absorbing").select("move_id", rd("x_end").alias("x_back"), C("flag").alias("absorbed"))
    return out.join(back, "move_id")


@query("hold_depth", f"WITH {STATES} SELECT fix_id, round(zmax - 2, 6) + 0.0 AS below, round(zmin + 3, 6) + 0.0 AS above FROM st")
def hold_depth(t):
    below = ops.hold_depth(_states(t), depth=-2.0, z="below")
    return ops.hold_depth(below, height=3.0, z="above").select("fix_id", rd("below").alias("below"), rd("above").alias("above"))


@query("update_status", """
    WITH s AS (SELECT fix_id, CAST(-(fix_id % 7) AS INT) AS flag, CAST(fix_id % 4 > 0 AS INT) AS wet, is_beached AS b0 FROM fixes)
    SELECT fix_id, CAST(CASE WHEN flag IN (-2, -3, -5, -6) THEN 0 ELSE 1 END AS INT) AS in_domain, CAST(flag = -3 AS INT) AS error_status,
      CAST(CASE WHEN flag = 0 THEN (wet = 0)::INT ELSE b0 END AS INT) AS is_beached, CAST(0 AS INT) AS relocate FROM s""")
def update_status(t):
    fid = C("fix_id")
    df = t.fixes.select("fix_id", (-(fid % 7)).cast("int").alias("flag"), (fid % 4 > 0).cast("int").alias("wet"), "is_beached",
                        F.lit(1).alias("in_domain"), F.lit(0).alias("error_status"))
    return ops.update_status(df).select("fix_id", "in_domain", "error_status", "is_beached", "relocate")


@query("assign_death_age", f"""
    SELECT point_id, round(1000 + {draw("'death'", "'5'", 'point_id')} * 4000, 4) + 0.0 AS uni,
      round(500 + sqrt(-2 * ln(1 - {draw("'death'", "'5'", 'point_id', "'a'")})) * cos(2 * pi() * {draw("'death'", "'5'", 'point_id', "'b'")}) * 100, 4) + 0.0 AS gau,
      CAST(86400 AS DOUBLE) AS com FROM points""")
def assign_death_age(t):
    p = t.points.select("point_id")
    kw = {"key": "point_id", "seed": 5}
    uni = ops.assign_death_age(p, "uniform", low_s=1000, high_s=5000, **kw).withColumnRenamed("age_of_death", "uni")
    gau = ops.assign_death_age(uni, "gaussian", mean_s=500, std_s=100, **kw).withColumnRenamed("age_of_death", "gau")
    com = ops.assign_death_age(gau, "common", value_s=86400, **kw)
    return com.select("point_id", rd("uni", 4).alias("uni"), rd("gau", 4).alias("gau"), C("age_of_death").alias("com"))


AGE_SQL = "ages AS (SELECT *, epoch(time) - epoch(min(time) OVER (PARTITION BY particle_id)) AS age_s FROM fixes)"


@query("particle_age", f"WITH {AGE_SQL} SELECT fix_id, round(age_s, 6) + 0.0 AS age_s, round(age_s / 86400, 8) + 0.0 AS age FROM ages")
def particle_age(t):
    return ops.particle_age(t.fixes).select("fix_id", rd("age_s").alias("age_s"), rd("age", 8).alias("age"))


@query("mark_dead", f"""
    WITH {AGE_SQL} SELECT fix_id, CAST(1 - max(CASE WHEN age_s >= 86400 * (particle_id % 20) THEN 1 ELSE 0 END)
      OVER (PARTITION BY particle_id ORDER BY time RANGE UNBOUNDED PRECEDING) AS INT) AS is_alive FROM ages""")
def mark_dead(t):
    aged = ops.particle_age(t.fixes).withColumn("age_of_death", (C("particle_id") % 20) * F.lit(86400.0))
    return ops.mark_dead(aged).select("fix_id", "is_alive")


@query("mark_dead_random", f"""
    SELECT fix_id, CAST(1 - max(CASE WHEN {draw("'mortality'", "'11'", 'particle_id', "strftime(time, '%Y-%m-%d %H:%M:%S')")} < 0.02 THEN 1 ELSE 0 END)
      OVER (PARTITION BY particle_id ORDER BY time RANGE UNBOUNDED PRECEDING) AS INT) AS is_alive FROM fixes""")
def mark_dead_random(t):
    return ops.mark_dead_random(t.fixes, 0.0002, 100, seed=11).select("fix_id", "is_alive")


@query("dead_reckon", """
    SELECT fix_id, round(x + 0.1 * y * 60, 6) + 0.0 AS x_new, round(y - 0.05 * x * 60, 6) + 0.0 AS y_new, round(z + 0.06, 6) + 0.0 AS z_new,
      round(x + degrees(0.1 * y * 60 / (6371000 * cos(radians(y)))), 8) + 0.0 AS lon, round(y + degrees(-0.05 * x * 60 / 6371000), 8) + 0.0 AS lat FROM fixes""")
def dead_reckon(t):
    df = t.fixes.withColumns({"u": C("y") * F.lit(0.1), "v": C("x") * F.lit(-0.05), "w": F.lit(0.001)})
    plane = ops.dead_reckon(df, 60).select("fix_id", rd("x_new").alias("x_new"), rd("y_new").alias("y_new"), rd("z_new").alias("z_new"))
    sphere = ops.dead_reckon(df, 60, "geographic").select("fix_id", rd("x_new", 8).alias("lon"), rd("y_new", 8).alias("lat"))
    return plane.join(sphere, "fix_id")
