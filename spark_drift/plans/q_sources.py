"""Queries: readers, writers and the catalogue."""

from pyspark.sql import functions as F

from spark_drift.operators.locate import locate_points
from spark_drift.plans import q_locate  # noqa: F401  (its comparison SQL is used again)
from spark_drift.plans.registry import ORACLES, query, rd
from spark_drift.plans.tables import LEVEL_DEPTHS
from spark_drift.sources import readers as rdr
from spark_drift.sources import writers as wtr
from spark_drift.util import one_row, scratch_folder

C = F.col


def _field_folder(t, *variables):
    path = scratch_folder(t.spark, "fields")
    wtr.write_fields(t.fields(*variables), path)
    return path


@query("read_fields", """
    SELECT variable, time, level, count(*) AS n, round(sum(value), 4) + 0.0 AS total, round(min(value), 6) + 0.0 AS low FROM fields
    WHERE variable IN ('thetao', 'zeta') AND time BETWEEN TIMESTAMP '2024-01-06' AND TIMESTAMP '2024-01-20' GROUP BY 1, 2, 3""")
def read_fields(t):
    path = _field_folder(t, "thetao", "zeta", "kz")
    df = rdr.read_fields(t.spark, path, ["thetao", "zeta"], "2024-01-06", "2024-01-20", source="source")
    return df.groupBy("variable", "time", "level").agg(F.count(F.lit(1)).alias("n"), rd(F.sum("value"), 4).alias("total"), rd(F.min("value")).alias("low"))


@query("read_mesh", """
    SELECT node_id, round(x - (SELECT min(x) FROM nodes), 6) + 0.0 AS x, round(y - (SELECT min(y) FROM nodes), 6) + 0.0 AS y,
      round(x, 6) + 0.0 AS lon, round(y, 6) + 0.0 AS lat,
      (SELECT count(*) FROM elems) AS n_elements, CAST(-24 AS DOUBLE) AS deepest FROM nodes""")
def read_mesh(t):
    path = scratch_folder(t.spark, "mesh")
    levels = t.spark.createDataFrame([("s", k, float(d)) for k, d in enumerate(LEVEL_DEPTHS)], "source string, level int, depth double")
    wtr.write_mesh(t.mesh.nodes, t.mesh.elements, path, levels)
    plane, geo = rdr.read_mesh(t.spark, path), rdr.read_mesh(t.spark, path, "geographic")
    n = plane.elements.count()
    deepest = one_row(rdr.read_levels(t.spark, path).agg(F.min("depth").alias("d")))["d"]
    lonlat = geo.nodes.select("node_id", rd("x").alias("lon"), rd("y").alias("lat"))
    return plane.nodes.select("node_id", rd("x").alias("x"), rd("y").alias("y")).join(lonlat, "node_id").select(
        "*", F.lit(n).cast("long").alias("n_elements"), rd(F.lit(deepest), 1).alias("deepest"))


# a mesh that was written and read again finds the same hosts
@query("read_mesh_and_locate", ORACLES["locate_points_on_sphere"])
def read_mesh_and_locate(t):
    path = scratch_folder(t.spark, "mesh")
    wtr.write_mesh(t.geo_mesh.nodes, t.geo_mesh.elements, path)
    out = locate_points(t.geo_points.select("point_id", "x", "y"), rdr.read_mesh(t.spark, path, "geographic"))
    return out.select("point_id", "host", "flag", rd("phi0").alias("phi0"), rd("phi1").alias("phi1"))


@query("read_frames_at", """
    SELECT a.variable, a.level, a.node_id, round(a.value, 6) + 0.0 AS last, round(b.value, 6) + 0.0 AS next
    FROM fields a JOIN fields b ON a.variable = b.variable AND a.level = b.level AND a.node_id = b.node_id
    WHERE a.variable IN ('thetao', 'zeta') AND a.time = TIMESTAMP '2024-01-10' AND b.time = TIMESTAMP '2024-01-11'""")
def read_frames_at(t):
    out = rdr.read_frames_at(t.fields("thetao", "zeta"), "2024-01-10 07:00:00", ["thetao", "zeta"], t.frame_times)
    return out.select("variable", "level", "node_id", rd("last").alias("last"), rd("next").alias("next"))


def _trajectories(t):
    path = scratch_folder(t.spark, "trajectories")
    fixes = t.fixes.withColumnsRenamed({"x": "x1", "y": "x2", "z": "x3"})
    wtr.write_trajectories(fixes, path)
    return path


@query("read_trajectories", """
    SELECT release, particle_id, round(x, 6) + 0.0 AS x1, round(y, 6) + 0.0 AS x2 FROM fixes WHERE release IN (1, 3)""")
def read_trajectories(t):
    df = rdr.read_trajectories(t.spark, _trajectories(t) + "/fixes", [1, 3], ["release", "particle_id", "x1", "x2"])
    return df.select("release", "particle_id", rd("x1").alias("x1"), rd("x2").alias("x2"))


COVERAGE_SQL = "cov AS (SELECT release AS file, min(time) AS t_first, max(time) AS t_last FROM fixes GROUP BY release)"


@query("file_coverage", f"""
    WITH {COVERAGE_SQL}
    SELECT file, t_first, t_last, coalesce(abs(epoch(lead(t_first) OVER w - t_last)), 0) + 0.0 AS gap_next_s,
      coalesce(abs(epoch(t_first - lag(t_last) OVER w)), 0) + 0.0 AS gap_prev_s FROM cov WINDOW w AS (ORDER BY t_first, file)""")
def file_coverage(t):
    return rdr.file_coverage(t.fixes, "release")


@query("validate_period", """
    SELECT min(time) AS t_first, max(time) AS t_last, min(time) <= TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-02' < max(time) AS start_covered,
      min(time) <= TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-03-01' < max(time) AS end_covered FROM fixes""")
def validate_period(t):
    return rdr.validate_period(rdr.file_coverage(t.fixes, "release"), "2024-01-02", "2024-03-01", strict=False)


@query("time_slice", "SELECT level, node_id, round(value, 6) + 0.0 AS value FROM fields WHERE variable = 'thetao' AND time = TIMESTAMP '2024-01-12'")
def time_slice(t):
    return rdr.time_slice(t.fields("thetao", "zeta"), "thetao", "2024-01-12").select("level", "node_id", rd("value").alias("value"))


def _gappy(t):
    return t.fields("thetao").withColumn("value", F.when((C("node_id") + C("level")) % 7 != 0, C("value")))


@query("mask_of", """
    SELECT time, level, sum(CASE WHEN (node_id + level) % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_masked, count(*) AS n
    FROM fields WHERE variable = 'thetao' GROUP BY 1, 2""")
def mask_of(t):
    return rdr.mask_of(_gappy(t), "thetao").groupBy("time", "level").agg(F.sum("masked").alias("n_masked"), F.count(F.lit(1)).alias("n"))


@query("fill_masked", """
    SELECT node_id, level, round(sum(CASE WHEN (node_id + level) % 7 = 0 THEN 0 ELSE value END), 5) + 0.0 AS total
    FROM fields WHERE variable = 'thetao' GROUP BY 1, 2""")
def fill_masked(t):
    return rdr.fill_masked(_gappy(t)).groupBy("node_id", "level").agg(rd(F.sum("value"), 5).alias("total"))


# each vector as a 4 × (n/4) plane, rows = lat, columns = lon; the last lat row is trimmed
@query("unpivot_arrays", """
    WITH v AS (SELECT vec_id, CAST(len(embedding) / 4 AS BIGINT) AS w, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    SELECT vec_id, (i % w) * 3 + i // w AS node_id, CAST(value AS DOUBLE) AS value FROM v WHERE i // w < 3""")
def unpivot_arrays(t):
    w = (F.size("embedding") / 4).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(C("embedding"), i * w + 1, w))
    df = t.base("embeddings").select("vec_id", rows.alias("plane"))
    return rdr.unpivot_arrays(df, ["lat", "lon"], "plane", trim_last_lat=True)


@query("flip_levels", "SELECT time, 5 - level AS level, z FROM profiles")
def flip_levels(t):
    return rdr.flip_levels(t.table("profiles")).select("time", "level", "z")


@query("apply_variable_catalogue", """
    SELECT fix_id, CAST(x AS FLOAT) AS longitude, CAST(y AS FLOAT) AS latitude, CAST(z AS FLOAT) AS depth, CAST(group_id AS INT) AS group_id,
      CAST(x * 2 AS FLOAT) AS thetao, CAST(in_domain AS INT) AS in_domain FROM fixes""")
def apply_variable_catalogue(t):
    df = t.fixes.select("fix_id", C("x").alias("x1"), C("y").alias("x2"), C("z").alias("x3"), "group_id", (C("x") * 2).alias("temp"), "in_domain")
    return rdr.apply_variable_catalogue(df, "geographic", "s", "fvcom")


@query("invalid_to_null", """
    SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE id * 2 END AS host, CASE WHEN id % 7 = 0 THEN NULL ELSE ax END AS value,
      CASE WHEN id % 3 = 0 THEN -999 ELSE id END AS host_out, CASE WHEN id % 4 = 0 THEN 1e20 ELSE bx END AS value_out FROM pairs""")
def invalid_to_null(t):
    df = t.table("pairs")
    held = df.select("id", F.when(C("id") % 5 == 0, F.lit(-999).cast("long")).otherwise(C("id") * 2).alias("host"),
                     F.when(C("id") % 7 == 0, F.lit(1e20)).otherwise(C("ax")).alias("value"))
    gaps = df.select("id", F.when(C("id") % 3 != 0, C("id")).alias("host_out"), F.when(C("id") % 4 != 0, C("bx")).alias("value_out"))
    return rdr.invalid_to_null(held).join(rdr.null_to_invalid(gaps), "id")


def _seeds(t):
    return t.points.select((C("point_id") % 17).cast("int").alias("group_id"), C("x").alias("x1"), C("y").alias("x2"), C("z").alias("x3"), C("point_id").alias("line"))


# the line of the count is line 0; seeds follow by group, in the order given inside a group, over many files
@query("read_seeds", """
    SELECT row_number() OVER (ORDER BY point_id % 17, point_id) AS line, CAST(point_id % 17 AS INT) AS group_id, x AS x1, y AS x2, z AS x3 FROM points""")
def read_seeds(t):
    path = scratch_folder(t.spark, "seeds")
    wtr.write_seeds(_seeds(t), path)
    return rdr.read_seeds(t.spark, path).select("line", "group_id", "x1", "x2", "x3")


@query("write_seeds", """
    SELECT CASE WHEN n = -1 THEN CAST((SELECT count(*) FROM points) AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS first, count(*) AS n
    FROM (SELECT point_id % 17 AS n FROM points UNION ALL SELECT -1) q GROUP BY 1""")
def write_seeds(t):
    path = scratch_folder(t.spark, "seeds")
    wtr.write_seeds(_seeds(t), path)
    return t.spark.read.text(path).groupBy(F.split("value", " ")[0].alias("first")).agg(F.count(F.lit(1)).alias("n"))


def _hourly(t):
    """States at whole hours: the last fix of each particle and hour."""
    return t.sql("""SELECT TRUNC_HOUR(time) AS time, particle_id, max(group_id) AS group_id, max(x) AS x1, max(y) AS x2, min(z) AS x3
        FROM fixes GROUP BY TRUNC_HOUR(time), particle_id""")


HOURLY_SQL = "h AS (SELECT date_trunc('hour', time) AS time, particle_id, max(group_id) AS group_id, max(x) AS x1, max(y) AS x2, min(z) AS x3 FROM fixes GROUP BY 1, 2)"


@query("read_snapshot", f"WITH {HOURLY_SQL} SELECT group_id, x1, x2, x3 FROM h WHERE time = (SELECT min(time) FROM h)")
def read_snapshot(t):
    path = scratch_folder(t.spark, "snapshots")
    wtr.write_snapshot(_hourly(t), path, 86400)
    first = one_row(_hourly(t).agg(F.min("time").alias("t0")))["t0"]
    return rdr.read_snapshot(t.spark, f"{path}/snapshot_time={first:%Y%m%dT%H%M%S}", first)


@query("write_snapshot", f"""
    WITH {HOURLY_SQL} SELECT strftime(time, '%Y%m%dT%H%M%S') AS snapshot_time, count(*) AS n, round(sum(x1), 4) + 0.0 AS x1
    FROM h WHERE CAST(epoch(time) - (SELECT epoch(min(time)) FROM h) AS BIGINT) % 43200 = 0 GROUP BY 1""")
def write_snapshot(t):
    path = scratch_folder(t.spark, "snapshots")
    wtr.write_snapshot(_hourly(t), path, 43200)
    return t.spark.read.parquet(path).groupBy("snapshot_time").agg(F.count(F.lit(1)).alias("n"), rd(F.sum("x1"), 4).alias("x1"))


@query("write_trajectories", """
    SELECT release, strftime(time, '%Y-%m-%d') AS date, CAST(min(epoch(time)) AS BIGINT) + 315619200 AS first_s, count(*) AS n,
      sum(in_domain)::BIGINT AS n_in_domain FROM fixes GROUP BY 1, 2""")
def write_trajectories(t):
    df = t.spark.read.parquet(_trajectories(t) + "/fixes")
    return df.groupBy("release", C("date").cast("string").alias("date")).agg(
        F.min("time").alias("first_s"), F.count(F.lit(1)).alias("n"), F.sum("in_domain").alias("n_in_domain"))


@query("write_mesh", "SELECT mask_c, count(*) AS n FROM tri GROUP BY mask_c")
def write_mesh(t):
    path = scratch_folder(t.spark, "mesh")
    wtr.write_mesh(t.mesh.nodes, t.mesh.elements, path)
    return rdr.read_mesh(t.spark, path).elements.groupBy("mask_c").agg(F.count(F.lit(1)).alias("n"))


@query("read_open_boundary_nodes", "SELECT node_id FROM nodes WHERE lat_index = 0")
def read_open_boundary_nodes(t):
    path = scratch_folder(t.spark, "boundary")
    edge = t.mesh.nodes.where("lat_index = 0")
    lines = edge.select(F.concat_ws(" ", C("lon_index").cast("string"), (C("node_id") + 1).cast("string"), F.lit("1")).alias("value"))
    head = t.spark.range(1).select(F.lit(str(edge.count())).alias("value"))
    head.unionByName(lines).write.text(path)
    return rdr.read_open_boundary_nodes(t.spark, path)


@query("describe_variables", """
    SELECT variable, count(*) AS n, count(DISTINCT time) AS n_times, count(DISTINCT level) AS n_levels, count(DISTINCT node_id) AS n_nodes,
      'double' AS dtype, CASE variable WHEN 'thetao' THEN 'degC' ELSE 'meters (m)' END AS units,
      CASE variable WHEN 'thetao' THEN 'Sea Water Potential Temperature' ELSE 'Sea surface elevation' END AS long_name
    FROM fields WHERE variable IN ('thetao', 'zeta') GROUP BY variable""")
def describe_variables(t):
    return rdr.describe_variables(t.fields("thetao", "zeta"))
