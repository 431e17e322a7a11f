"""Inputs that the test tables do not contain: gaps, equal rows, shared sides, many files, rows without an answer."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from spark_drift.operators import analytics, locate, sample, time, zones
from spark_drift.operators.regrid import regrid
from spark_drift.schema import Mesh
from spark_drift.sources import readers, writers
from spark_drift.streaming import state, streams

DEPTHS = (0.0, 4.0, 8.0)


def column(spark, values, times=(fx.T0, fx.T1)):
    """ζ = 0 and thetao with one value per level at every node."""
    rows = [(v, t, k, n, x) for t in times for n in fx.ZETA for v, k, x in [("zeta", 0, 0.0), *[("thetao", k, x) for k, x in enumerate(values)]]]
    return spark.createDataFrame(rows, "variable string, time timestamp_ntz, level int, node_id long, value double")


@pytest.mark.parametrize("z,values,want", [(-2.0, (10.0, None, 3.0), 10.0), (-2.0, (10.0, 20.0, 3.0), 15.0), (-9.0, (10.0, 20.0, 3.0), 3.0), (-9.0, (10.0, 20.0, None), None)])
def test_masked_lower_level(spark, z, values, want):
    """The level above counts alone; a boundary layer whose level is masked has no value."""
    m, fields = fx.plane(spark), column(spark, values)
    at = spark.createDataFrame([(0, 4 / 3, 5 / 3, z)], "point_id long, x double, y double, depth double")
    got = regrid(fields, m, at, [fx.T0 + timedelta(minutes=30)], ["thetao"], DEPTHS, fx.frames(spark)).first()["thetao"]
    fixes = at.select(F.col("point_id").alias("fix_id"), "x", "y", F.col("depth").alias("z"), F.lit(str(fx.T0)).cast("timestamp_ntz").alias("time"))
    path = analytics.sample_along_paths(fixes, fields, m, fx.frames(spark), DEPTHS, ["thetao"]).first()["thetao"]
    assert got == path == (want if want is None else pytest.approx(want))


def test_equal_rows_stay(spark):
    m = fx.plane(spark)
    pts = spark.createDataFrame([(4 / 3, 5 / 3)] * 2 + [(None, 1.0), (9.0, 9.0)] * 2, "x double, y double")
    found = locate.locate_points(pts, m)
    assert sorted((r["host"] is None, r["flag"]) for r in found.collect()) == [(False, 0)] * 2 + [(True, -3)] * 4
    inside = found.where("host is not null")
    flat = m.nodes.select("node_id", F.lit(7.0).alias("value"))
    assert [r["value"] for r in sample.interp_2d(inside, flat).collect()] == [pytest.approx(7.0)] * 2
    elems = m.elements.select("element_id", F.lit(7.0).alias("value"))
    assert [r["value"] for r in sample.idw_neighbours(inside, elems, m).collect()] == [pytest.approx(7.0)] * 2
    framed = time.asof_frames(inside.withColumn("time", F.lit(str(fx.T0)).cast("timestamp_ntz")), fx.frames(spark))
    assert sample.interp_2d_time(framed, column(spark, (1.0,)), "zeta").count() == 2
    wet = m.elements.select("element_id", F.explode(F.array(*[F.lit(str(t)).cast("timestamp_ntz") for t in (fx.T0, fx.T1)])).alias("time"), F.lit(1).alias("wet"))
    assert [r["wet"] for r in sample.is_wet(framed, wet).collect()] == [1, 1]


def test_levels_outside_the_list_raise(spark):
    m = fx.plane(spark)
    pts = locate.locate_points(spark.createDataFrame([(4 / 3, 5 / 3, -1.0)], "x double, y double, z double"), m)
    framed = time.asof_frames(pts.withColumn("time", F.lit(str(fx.T0)).cast("timestamp_ntz")), fx.frames(spark))
    with pytest.raises(Exception, match="outside the given"):
        sample.sample_variable(framed, column(spark, (1.0, 2.0, 3.0)), ["thetao"], DEPTHS[:2], m.nodes).collect()


def test_fields_are_pruned_by_date(spark, tmp_path):
    """Only the folders of the days around the times are scanned."""
    days = [fx.T0 + timedelta(days=d) for d in range(40)]
    writers.write_fields(column(spark, (1.0, 2.0, 3.0), days), str(tmp_path / "fields"))
    fields = readers.read_fields(spark, str(tmp_path / "fields"))
    frames = spark.createDataFrame([(t,) for t in days], "time timestamp_ntz")
    near = time.fields_around(fields, frames, F.lit(str(days[7])).cast("timestamp_ntz"), F.lit(str(days[8])).cast("timestamp_ntz"))
    assert {r["d"] for r in near.select(F.col("date").cast("string").alias("d")).distinct().collect()} == {str(days[d].date()) for d in (6, 7, 8, 9)}
    plan = near._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "date" in scan and "ubquery" in scan
    at = spark.createDataFrame([(0, 4 / 3, 5 / 3, -2.0)], "point_id long, x double, y double, depth double")
    got = regrid(fields, fx.plane(spark), at, [days[7] + timedelta(hours=5)], ["thetao"], DEPTHS, frames)
    assert got.first()["thetao"] == pytest.approx(1.5)


def test_streamed_fixes_on_a_shared_side(spark, tmp_path):
    """Two input files; every fix comes out once, on the lowest element of its side, none on land."""
    m = fx.plane(spark)
    side = [(4 / 3, 4 / 3), (1.0, 1.0), (1.5, 1.5), (4 / 3, 5 / 3), (0.9, 1.4), (50.0, 1.0)]
    rows = [(i, fx.T0 + timedelta(minutes=i), x, y) for i, (x, y) in enumerate(side * 2)]
    fixes = spark.createDataFrame(rows, "fix_id long, time timestamp_ntz, x double, y double")
    for k in (0, 1):
        fixes.where(F.col("fix_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fixes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run_to_parquet(streams.stream_sample(stream, fx.plane_fields(spark), fx.frames(spark), m, "zeta"), str(tmp_path / "out"))
    got = sorted((r["fix_id"], r["host"]) for r in out.collect())
    want = locate.locate_points(fixes, m).where("host is not null")
    assert got == sorted((r["fix_id"], r["host"]) for r in want.collect()) and len(got) >= 6
    framed = time.asof_frames(want, fx.frames(spark))
    value = {r["fix_id"]: r["zeta"] for r in sample.interp_2d_time(framed, fx.plane_fields(spark), "zeta").collect()}
    assert {r["fix_id"]: pytest.approx(r["value"]) for r in out.collect()} == value


def test_status_over_batches(spark, tmp_path):
    """One row per particle, the newest; who left stays out however long ago."""
    rows = [(1, fx.T0 + timedelta(days=90 * d), int(d != 1), 0, 1) for d in range(4)]
    fixes = spark.createDataFrame(rows, "particle_id long, time timestamp_ntz, in_domain int, is_beached int, land_boundary_encounters int")
    for d in range(4):
        fixes.where(F.col("time") == F.lit(str(rows[d][1])).cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fixes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run_to_parquet(state.stream_status(stream, 1e9, 1e9), str(tmp_path / "out"), "update", ["particle_id"]).collect()
    assert len(out) == 1 and out[0]["in_domain"] == 0 and out[0]["land_encounters"] == 4 and out[0]["age_s"] == 270 * 86400


def test_seeds_keep_their_order_over_files(spark, tmp_path):
    seeds = spark.createDataFrame([(i, i // 400, float(-i), 0.5, 0.0) for i in range(2000)], "line long, group_id int, x1 double, x2 double, x3 double")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 300)
    try:
        writers.write_seeds(seeds, str(tmp_path / "seeds"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        got = readers.read_seeds(spark, str(tmp_path / "seeds")).orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["x1"] for r in got] == [float(-i) for i in range(2000)] and [r["line"] for r in got] == list(range(1, 2001))


def test_geographic_mesh_is_read_as_operators_take_it(spark, tmp_path):
    m = fx.plane(spark)
    geo = Mesh(m.nodes.withColumns({"x": F.col("x") + 100, "y": F.col("y") + 50}), m.elements, "geographic")
    writers.write_mesh(geo.nodes, geo.elements, str(tmp_path / "mesh"))
    pts = spark.createDataFrame([(101.35, 51.65)], "x double, y double")
    assert locate.locate_points(pts, readers.read_mesh(spark, str(tmp_path / "mesh"), "geographic")).first()["host"] == 0


def test_survival_starts_from_the_first_time(spark):
    fixes = spark.createDataFrame([(fx.T0, 1)] * 4 + [(fx.T1, 1), (fx.T1, 0)], "time timestamp_ntz, is_alive int")
    got = {r["time"]: r["expected"] for r in analytics.survival_curve(fixes, 1e-3).collect()}
    assert got == {fx.T0: 4.0, fx.T1: pytest.approx(4 * np.exp(-3.6))}


def test_points_outside_a_profile_stay(spark):
    profile = spark.createDataFrame([(0, float(-z), float(z * z)) for z in range(5)], "time int, z double, value double")
    pts = spark.createDataFrame([(0, -1.5), (0, -9.0), (1, -1.0), (0, -2.0), (0, -2.0)], "time int, z double")
    for fn in (sample.profile_linear, lambda p, q: sample.profile_spline(p, q, "time")):
        rows = fn(pts, profile).collect()
        assert len(rows) == 5 and sum(r["value"] is None for r in rows) == 2
    exact = [r["value"] for r in sample.profile_linear(pts, profile).collect() if r["z"] == -2.0]
    assert exact == [pytest.approx(4.0)] * 2


@pytest.mark.parametrize("spline", [False, True])
def test_profile_between_frames(spark, spline):
    """Kz on interfaces −4, −3, −1, 0: 0, 1, 1, 0 at 0 s and 0, 2, 2, 0 at 3600 s."""
    rows = [(t, k, z, v * w) for t, w in ((fx.T0, 1.0), (fx.T1, 2.0)) for k, (z, v) in enumerate([(0.0, 0.0), (-1.0, 1.0), (-3.0, 1.0), (-4.0, 0.0)])]
    profile = spark.createDataFrame(rows, "time timestamp_ntz, level int, z double, value double")
    pts = spark.createDataFrame([(fx.T0 + timedelta(seconds=s), -2.0) for s in (0, 1800, 3599)], "time timestamp_ntz, z double")
    got = sample.profile_in_time(time.asof_frames(pts, fx.frames(spark)), profile, spline=spline).orderBy("time").collect()
    top = 1.0 if not spline else got[0]["value"]
    assert [r["value"] for r in got] == pytest.approx([top, 1.5 * top, top * (1 + 3599 / 3600)])
    assert [r["gradient"] for r in got] == pytest.approx([0, 0, 0], abs=1e-12)


@pytest.mark.parametrize("n", [2, 3, 4, 9])
def test_spline_against_a_dense_solve(spark, n):
    rng = np.random.default_rng(n)
    z, v = np.sort(rng.uniform(-10, 0, n)), rng.normal(size=n)
    h, m = np.diff(z), np.zeros(n)
    if n > 2:
        a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        m[1:-1] = np.linalg.solve(a, 6 * np.diff(np.diff(v) / h))
    profile = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(z, v)], "time int, z double, value double")
    layers = sample.spline_layers(profile).first()["layers"]
    assert [x["m_lo"] for x in layers] + [layers[-1]["m_hi"]] == pytest.approx(m.tolist(), abs=1e-9)


def test_wide_and_small_zones_overlap(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), float(r)) for i, (x, y, r) in enumerate(zip(rng.uniform(0, 40, 80), rng.uniform(0, 40, 80), 10 ** rng.uniform(-2, 1.2, 80)))]
    got = {(r["a"], r["b"]) for r in zones.zone_overlaps(spark.createDataFrame(rows, "group_id long, cx double, cy double, radius double")).collect()}
    want = {(a, b) for a, ax, ay, ar in rows for b, bx, by, br in rows if a < b and np.hypot(ax - bx, ay - by) < ar + br}
    assert got == want and len(want) > 100


def test_dry_points_without_a_wet_neighbour_stay(spark):
    m = fx.plane(spark)
    pts = spark.createDataFrame([(0, 4 / 3, 5 / 3), (1, 5 / 3, 4 / 3), (None, 9.0, 9.0)] * 2, "host long, x double, y double")
    dry = m.elements.select("element_id", F.lit(0).alias("wet"))
    assert [r["wet_host"] for r in locate.nearest_wet_element(pts, m, dry).collect()] == [None] * 6
    one = m.elements.select("element_id", (F.col("element_id") == 1).cast("int").alias("wet"))
    assert sorted((r["host"] is None, r["host"] or 0, r["wet_host"]) for r in locate.nearest_wet_element(pts, m, one).collect()) == [(False, 0, 1)] * 2 + [(False, 1, None)] * 2 + [(True, 0, None)] * 2


def test_rank_limits_reach_the_window(spark):
    """The nodes of highest value are cut to n per date inside each task."""
    from pyspark.sql import Window

    field = spark.range(100).select((F.col("id") % 3).alias("time"), F.col("id").alias("node_id"), F.rand(1).alias("value"))
    top = field.withColumn("_rank", F.row_number().over(Window.partitionBy("time").orderBy(F.desc("value"), "node_id"))).where(F.col("_rank") <= 5)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_variables_are_described_by_words_of_bits(spark):
    """Counts of distinct items across words of 64, negative numbers and nulls; cells are not shuffled."""
    rows = [("a", t, lev, node, 1.0) for t in (1, 2, 3) for lev in (-70, -1, 0, 63, 64) for node in (*range(0, 200, 3), 10**12, 10**12 + 63)]
    rows += rows[:50] + [("a", None, 5, 1, 1.0), ("a", 1, None, None, 1.0), ("b", None, None, None, 1.0)]
    fields = spark.createDataFrame(rows, "variable string, time long, level long, node_id long, value double")
    out = readers.describe_variables(fields)
    of = lambda v, i: len({r[i] for r in rows if r[0] == v and r[i] is not None})
    got = {r.variable: (r.n, r.n_times, r.n_levels, r.n_nodes) for r in out.collect()}
    assert got == {v: (sum(r[0] == v for r in rows), of(v, 1), of(v, 2), of(v, 3)) for v in ("a", "b")}
    dense = spark.range(100_000, numPartitions=1).selectExpr("'a' AS variable", "1 AS time", "0 AS level", "id AS node_id", "1.0 AS value")
    described = readers.describe_variables(dense)
    assert described.first().n_nodes == 100_000
    assert "SortAggregate" not in described._jdf.queryExecution().executedPlan().toString()
