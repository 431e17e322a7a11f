"""Joins whose sides grow with mesh, frames or points: nothing large is broadcast, and pairs are dealt evenly."""

import math
import re
import uuid
from collections import Counter

from pyspark.sql import functions as F

from spark_drift import util
from spark_drift.operators import analytics, archive, sample, zones
from spark_drift.operators.locate import locate_points
from spark_drift.operators.mesh import element_mask, lattice_mesh, permute_nodes
from spark_drift.operators.regrid import regrid
from spark_drift.schema import Mesh
from spark_drift.streaming import streams


def broadcast_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)


def fed(df):
    """Broadcast joins that bring fields or depths to hosts, or these to points."""
    return [k for k in broadcast_keys(df) if k.startswith(("node_id", "n0"))]


def small_mesh(spark, n=4):
    axis = spark.range(n).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("v"))
    m = lattice_mesh(axis, axis)
    return Mesh(m.nodes.withColumn("h", F.lit(30.0)), m.elements, m.cs)


def framed(spark):
    row = (0, 1, 5, 0.2, 0.3, 0.5, 0)
    return spark.createDataFrame([(i, *row) for i in range(4)], "fix_id long, n0 long, n1 long, n2 long, phi0 double, phi1 double, phi2 double, host long").withColumns({
        "t_last": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "t_next": F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), "t_frac": F.lit(0.25), "z": F.lit(-5.0)})


def field_rows(spark, mesh, variable, levels=1):
    days = F.expr("sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-02 00:00:00', interval 1 day)")
    rows = mesh.nodes.select("node_id", F.explode(days).alias("time")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return rows.select(F.lit(variable).alias("variable"), "time", "level", "node_id", (F.col("node_id") + F.col("level")).cast("double").alias("value"))


def test_fields_are_not_broadcast_to_points(spark):
    mesh = small_mesh(spark)
    out = sample.interp_2d_time(framed(spark), field_rows(spark, mesh, "zeta"), "zeta")
    assert [round(r["zeta"], 9) for r in out.collect()] == [0.2 * 0 + 0.3 * 1 + 0.5 * 5] * 4
    assert not fed(out)


def test_levels_and_depths_are_not_broadcast(spark):
    mesh = small_mesh(spark)
    fields = field_rows(spark, mesh, "zeta").unionByName(field_rows(spark, mesh, "uo", 2))
    out = sample.zmin_zmax(framed(spark), mesh.nodes, fields)
    assert out.count() == 4 and not fed(out)
    near = framed(spark).withColumns({"k_a": F.lit(0), "k_b": F.lit(1)})
    got = sample.gather_levels(near, fields, {"uo": 2})
    assert got.count() == 4 and not fed(got)


def test_gradients_and_wet_elements_are_not_broadcast(spark):
    mesh = small_mesh(spark)
    with_g = sample.with_gradients(framed(spark), mesh)
    assert with_g.count() == 4 and not any("host" in k for k in broadcast_keys(with_g))
    mask = field_rows(spark, mesh, "zeta").select("node_id", "time", "level", (F.col("node_id") == 5).cast("int").alias("masked"))
    elements = mesh.elements.withColumn("mask_c", F.lit(0))
    wet = sample.wet_elements(elements, mask)
    assert wet.count() == 2 * elements.count() and not any("node_id" in k for k in broadcast_keys(wet))
    flagged = sample.is_wet(framed(spark), wet)
    assert flagged.count() == 4 and not any("host" in k for k in broadcast_keys(flagged))


def test_hosts_are_not_broadcast(spark):
    points = spark.createDataFrame([(0, 0.5, 0.25), (1, 2.5, 1.5)], "point_id long, x double, y double")
    out = locate_points(points, small_mesh(spark))
    assert out.where("host is not null").count() == 2
    assert not any(k.startswith(("_pscale", "x", "knownfloating")) for k in broadcast_keys(out))


def test_depth_integral_keeps_the_field_in_place(spark):
    mesh = small_mesh(spark)
    interfaces = spark.createDataFrame([(0, 0.0), (1, -0.5), (2, -1.0)], "level int, sigma double")
    surface = field_rows(spark, mesh, "zeta").select("time", "node_id", F.lit(0.0).alias("zeta"))
    field = field_rows(spark, mesh, "thetao", 2).select("time", "node_id", "level", "value")
    out = analytics.depth_integral(field, interfaces, surface, mesh.nodes)
    assert all(math.isclose(r["value"], 30.0 * (r["node_id"] + 0.5)) for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[level#\d+\], \[level#\d+\], Inner, BuildRight", plan)
    assert not any("node_id" in k for k in broadcast_keys(out))


def test_renumbered_fields_are_not_broadcast(spark):
    mesh = small_mesh(spark)
    order = mesh.nodes.select("node_id", (F.lit(15) - F.col("node_id")).alias("place"))
    moved = permute_nodes(field_rows(spark, mesh, "zeta"), order)
    assert moved.count() == 32 and not any(k.startswith("node_id") for k in broadcast_keys(moved))
    renumbered = archive.renumber_mesh(mesh, order)
    assert renumbered.elements.count() == 18 and not any("element_id" in k for k in broadcast_keys(renumbered.elements))


def test_archived_fields_are_not_broadcast_to_points(spark, tmp_path):
    mesh = small_mesh(spark)
    stored = archive.write_archive(field_rows(spark, mesh, "zeta"), f"fields_{uuid.uuid4().hex}", str(tmp_path / "archive"), 8, 2)
    out = sample.interp_2d_time(framed(spark), stored, "zeta")
    assert [round(r["zeta"], 9) for r in out.collect()] == [0.2 * 0 + 0.3 * 1 + 0.5 * 5] * 4
    assert not fed(out)


def test_regridding_on_the_sphere_keeps_fields_in_place(spark):
    mesh = small_mesh(spark)
    nodes = mesh.nodes.withColumn("mask", (F.col("node_id") == 0).cast("int"))
    sphere = Mesh(nodes, element_mask(mesh.elements, nodes), "geographic")
    fields = field_rows(spark, mesh, "zeta").unionByName(field_rows(spark, mesh, "thetao", 2))
    targets = spark.createDataFrame([(0, 0.8, 0.6, 0.0), (1, 0.8, 0.6, 0.0), (2, 9.0, 9.0, 0.0)], "point_id long, x double, y double, depth double")
    out = regrid(fields, sphere, targets, ["2024-01-01 06:00:00"], ["thetao"], (0.0, 8.0), fields.select("time").distinct())
    # the element has a land node: its nearest sea node, number 5, alone
    assert {r["point_id"]: r["thetao"] for r in out.collect()} == {0: 5.0, 1: 5.0, 2: None}
    assert not fed(out)


def test_depths_by_s_levels_are_not_broadcast(spark):
    mesh = small_mesh(spark)
    out = sample.depth_fields(field_rows(spark, mesh, "zeta"), mesh.nodes, ((0.0, 0.0), (-0.3, -0.1), (-1.0, -1.0)), hc=5.0)
    rows = out.collect()
    assert len(rows) == 2 * 16 * 3 and not fed(out)
    stretch = {0: 0.0, 1: (5 * -0.3 + -0.1 * 30) / 35, 2: -1.0}
    assert all(math.isclose(r["value"], r["node_id"] + (r["node_id"] + 30) * stretch[r["level"]], abs_tol=1e-9) for r in rows)


def test_depths_by_sigma_of_nodes_are_not_broadcast(spark):
    mesh = small_mesh(spark)
    sigma = F.array(F.lit(0.0), F.lit(-0.2) - F.col("node_id") / 100.0, F.lit(-1.0))
    out = sample.depth_fields(field_rows(spark, mesh, "zeta"), mesh.nodes, mesh.nodes.select("node_id", F.posexplode(sigma).alias("level", "sigma")))
    rows = out.collect()
    assert len(rows) == 2 * 16 * 3 and not fed(out)
    assert all(math.isclose(r["value"], r["node_id"] + (r["node_id"] + 30) * (0.0, -0.2 - r["node_id"] / 100, -1.0)[r["level"]], abs_tol=1e-9) for r in rows)


def test_fixes_are_not_broadcast_to_their_members(spark):
    i = F.col("id")
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    fixes = spark.range(60).select((i % 2).alias("release"), day.alias("time"), (i % 7).cast("double").alias("x"), (i % 11).cast("double").alias("y"), (i % 5 * -1.0).alias("z"))
    nodes = spark.range(9).select(day.alias("time"), i.alias("node_id"), (i % 3).cast("double").alias("x"), F.floor(i / 3).cast("double").alias("y"), i.cast("double").alias("value"))
    plane = analytics.rmse_field(fixes, nodes, 3)
    got = plane.first()
    assert got["n"] == 2 * 3 and got["rmse"] > 0
    levels = spark.range(3).select(day.alias("time"), i.cast("int").alias("level"), (i * -2.0).alias("z"), F.lit(-5.0).alias("lo"), F.lit(0.0).alias("hi"))
    depth = analytics.member_density_1d(fixes, levels, 3)
    assert depth.count() == 2 * 3
    assert not any(k.startswith("release") for df in (plane, depth) for k in broadcast_keys(df))


def test_pairs_of_one_key_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(util, "BLOCK_ROWS", 16)
    monkeypatch.setattr(util, "TASK_PAIRS", 512)
    left = spark.range(100).select(F.col("id").alias("a"), F.when(F.col("id") < 90, 0).otherwise(F.col("id")).alias("k")).unionByName(
        spark.createDataFrame([(1, 0), (1, 0), (None, 0), (7, None)], "a long, k long"))
    right = spark.range(80).select(F.col("id").alias("b"), F.when(F.col("id") < 70, 0).otherwise(F.col("id") + 15).alias("k"))
    out = util.join_in_blocks(left, right, ["k"])
    assert Counter(map(tuple, out.select("k", "a", "b").collect())) == Counter(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 93 * 70 + 5 and len(sizes) > 4 and max(sizes) < sum(sizes) / 3


def test_points_of_one_zone_are_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(util, "BLOCK_ROWS", 32)
    monkeypatch.setattr(util, "TASK_PAIRS", 1024)
    points = spark.range(400).select(F.col("id").alias("point_id"), (F.col("id") * 0 + 0.1).alias("x"), (F.col("id") * 0 + 0.1).alias("y"))
    discs = spark.range(50).select(F.col("id").alias("group_id"), (F.col("id") * 0.0).alias("cx"), (F.col("id") * 0.0).alias("cy"), F.lit(1.0).alias("radius"))
    out = zones.within_zone(points, discs)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 * 50 and len(sizes) > 4 and max(sizes) < sum(sizes) / 3


def test_overlaps_without_a_shuffle_of_all_pairs(spark):
    rows = [(i, (i * 7 % 40) / 10, (i * 3 % 40) / 10, (0.05, 0.3, 0.5, 2.0)[i % 4]) for i in range(120)]
    shape = "group_id long, cx double, cy double, radius double"
    out = zones.zone_overlaps(spark.createDataFrame(rows, shape), 0.05)
    want = set()
    for a in rows:
        for b in rows:
            touch = a[3] + b[3]
            if a[0] < b[0] and (touch - math.hypot(a[1] - b[1], a[2] - b[2])) / touch > 0.05:
                want.add((a[0], b[0]))
    got = [(r["a"], r["b"]) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "HashAggregate(keys=[a#" not in out._jdf.queryExecution().executedPlan().toString()
    twice = zones.zone_overlaps(spark.createDataFrame(rows + rows[:9] + [(None, 1.0, 1.0, 0.4)], shape), 0.05)
    pairs = Counter((r["a"], r["b"], r["overlap"]) for r in twice.collect())
    assert set(pairs.values()) == {1} and want <= {k[:2] for k in pairs}


def test_rings_are_dealt_to_many_tasks(spark):
    corners = [(0, 0.0, 0.0), (1, 0.0, 8.0), (2, 8.0, 8.0), (3, 8.0, 0.0)]
    ring = spark.range(64).select(F.col("id").alias("polygon_id"), F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, x, y in corners])).alias("v"))
    ring = ring.select("polygon_id", "v.*")
    out = zones.zones_around_polygon(ring, spark.range(64).select(F.col("id").alias("polygon_id"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy")), 1.0)
    rows = out.withColumn("_p", F.spark_partition_id()).collect()
    assert Counter(r["polygon_id"] for r in rows) == {i: 17 for i in range(64)}
    assert len({r["_p"] for r in rows}) > 1


def test_streamed_values_are_not_broadcast(spark):
    mesh = small_mesh(spark)
    elements = mesh.elements.withColumn("mask_c", F.lit(0))
    fixes = spark.createDataFrame([(0, 0.5, 0.25)], "fix_id long, x double, y double").withColumn("time", F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"))
    fields = field_rows(spark, mesh, "zeta")
    out = streams.stream_sample(fixes, fields, fields.select("time").distinct(), Mesh(mesh.nodes, elements, mesh.cs), "zeta")
    assert out.count() == 1 and not any("host" in k or "_p0" in k for k in broadcast_keys(out))
