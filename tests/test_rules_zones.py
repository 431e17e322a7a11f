import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_drift.operators import analytics, rules, seeds, time, zones
from spark_drift.sources import readers, writers
from spark_drift.util import number_rows


def ring(spark, pts, pid=0):
    return spark.createDataFrame([(pid, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "polygon_id int, idx int, x double, y double")


def test_orientation_and_nearest_vertex(spark):
    pts = [(0, 0), (0, 1), (1, 1), (1, 0)]
    both = ring(spark, pts).unionByName(ring(spark, pts[::-1], 1))
    assert {r["polygon_id"]: r["clockwise"] for r in zones.is_clockwise(both).collect()} == {0: True, 1: False}
    start = spark.createDataFrame([(0, 0.1, 1.1)], "polygon_id int, sx double, sy double")
    assert zones.nearest_vertex(ring(spark, pts), start).first()["idx"] == 1
    with pytest.raises(Exception, match="tolerance"):
        zones.nearest_vertex(ring(spark, pts), start, 0.1).collect()


def test_walk_round_a_ring(spark):
    pts = [(0, 0), (0, 10), (10, 10), (10, 0)]
    start = spark.createDataFrame([(0, 0.0, 0.0)], "polygon_id int, sx double, sy double")
    out = zones.zones_around_polygon(ring(spark, pts), start, 1.0).orderBy("index").collect()
    assert len(out) == 20 or len(out) == 21
    for a, b in zip(out, out[1:]):
        assert math.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"]) == pytest.approx(2.0)
    assert (out[1]["cx"], out[1]["cy"]) == pytest.approx((0, 2))
    short = zones.zones_around_polygon(ring(spark, pts), start, 1.0, 5.0).count()
    assert 1 < short < len(out)


def test_root_on_the_side():
    c = zones._walk_ring(np.array([[0.0, 0.0], [2.0, 2.0], [10.0, 10.0]]), 0, True, 8.0, None)
    assert c[1] == pytest.approx((math.sqrt(32), math.sqrt(32)))


def test_discs(spark):
    z = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 9000, 0.0), (2, 5.0, 5.0, 1.0, 10, 0.0)], "group_id int, cx double, cy double, radius double, n int, depth double")
    pts = zones.disc_points_random(z, 3)
    n = {r["group_id"]: r["n"] for r in zones.zone_counts(pts).collect()}
    assert n == {1: 9000, 2: 10, None: 9010}
    assert pts.join(z.select("group_id", "cx", "cy", "radius"), "group_id").where("sqrt(pow(x-cx,2)+pow(y-cy,2)) > radius + 1e-9").count() == 0
    regular = zones.disc_points_regular(z).where("group_id = 1").count()
    assert 0.9 * 9000 < regular <= 9000
    assert zones.create_release_zones(z).where("group_id = 1").first()["area"] == pytest.approx(4 * math.pi)
    inside = zones.within_zone(spark.createDataFrame([(0, 1.0, 0.0), (1, 4.0, 0.0)], "point_id int, x double, y double"), z.where("group_id = 1"))
    assert [r["point_id"] for r in inside.collect()] == [0]


def test_line_of_zones(spark):
    lines = spark.createDataFrame([(0, 0.0, 0.0, 3.0, 4.0), (1, 0.0, 0.0, 0.5, 0.0)], "line_id int, x1 double, y1 double, x2 double, y2 double")
    out = zones.zones_along_line(lines, 1.0).orderBy("index").collect()
    assert len(out) == 2 and (out[0]["cx"], out[0]["cy"]) == pytest.approx((0.9, 1.2))


def test_hull_against_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(500, 2))
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in pts], "group_id int, x double, y double").repartition(7)
    hull = {(r["x"], r["y"]) for r in zones.zone_hull(df, 5).collect()}
    for x, y in pts:
        d = pts - (x, y)
        angles = np.sort(np.arctan2(d[:, 1], d[:, 0])[np.hypot(*d.T) > 0])
        gap = max(np.max(np.diff(angles)), angles[0] + 2 * np.pi - angles[-1])
        assert ((float(x), float(y)) in hull) == (gap > np.pi)


def test_fold(spark):
    df = spark.createDataFrame([(z,) for z in (-25.0, -11.0, -10.0, -3.0, 0.0, 4.0, 13.0)], "z double").withColumns({"zmin": F.lit(-10.0), "zmax": F.lit(0.0)})
    assert [r["z"] for r in rules.reflect_vertical(df).collect()] == pytest.approx([-5, -9, -10, -3, 0, -4, -7])
    dry = df.withColumn("zmin", F.lit(1.0))
    assert {r["z"] for r in rules.reflect_vertical(dry).collect()} == {1.0}


def test_rows_are_numbered_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000 * 50).alias("k"))
    out = number_rows(df, "k", "n", width=64).orderBy("k").collect()
    assert [r["n"] for r in out] == list(range(1, 1001))


def test_seed_depth_errors(spark):
    df = spark.createDataFrame([(1.0, -10.0, 0.0)], "x3 double, zmin double, zmax double")
    with pytest.raises(Exception, match="above the free surface"):
        seeds.resolve_seed_depth(df, "depth_below_surface").collect()
    with pytest.raises(Exception, match="below the sea floor"):
        seeds.resolve_seed_depth(df.withColumn("x3", F.lit(-1.0)), "height_above_bottom").collect()
    deep = seeds.resolve_seed_depth(df.withColumn("x3", F.lit(-99.0)), "depth_below_surface")
    assert deep.first()["x3"] == -10.0


def frames(spark, *seconds):
    return spark.createDataFrame([(s,) for s in seconds], "s long").select(F.timestamp_seconds(F.lit(946684800) + F.col("s")).cast("timestamp_ntz").alias("time"))


def test_frames_across_files(spark):
    f = frames(spark, 0, 60, 120, 180, 240, 300, 300, 360, 420, 480)
    spans = time.frame_intervals(f)
    assert spans.count() == 8
    p = frames(spark, 0, 120, 300)
    at = lambda d: [(r["t_last"].minute, r["t_next"].minute) for r in time.asof_frames(p.where(F.lit(d == 1) | (F.col("time") > "2000-01-01")), f, d).orderBy("time").collect()]
    assert at(1) == [(0, 1), (2, 3), (5, 6)]
    assert at(-1) == [(1, 2), (4, 5)]
    with pytest.raises(Exception, match="outside the frames"):
        time.asof_frames(frames(spark, 480), f).collect()


def test_frames_of_very_different_spacing(spark):
    """10⁵ frames a minute apart, one a century before: no cell holds more than a few intervals."""
    dense = spark.range(100_000).select((F.col("id") * 60).alias("s"))
    f = dense.unionByName(spark.createDataFrame([(-100 * 31_557_600,)], "s long")).select(F.timestamp_seconds(F.lit(946684800) + F.col("s")).cast("timestamp_ntz").alias("time"))
    cells = time.interval_cells(time.frame_intervals(f)).groupBy("_level", "_cell").count()
    assert cells.agg(F.max("count")).first()[0] <= 4
    p = frames(spark, -50 * 31_557_600, -1, 0, 59, 60, 5_999_939, 5_999_940, -101 * 31_557_600)
    got = {r["time"].isoformat(): r for r in time.asof_frames(p, f, missing="null").collect()}
    assert len(got) == 8
    assert sorted(t[:4] for t, r in got.items() if r["t_last"] is None) == ["1898", "2000"]
    assert got["2000-03-10T10:39:00"]["t_last"] is None  # the last frame itself
    assert got["2000-01-01T00:00:59"]["t_last"].second == 0 and got["1999-12-31T23:59:59"]["t_last"].year == 1899
    back = {r["time"].isoformat(): r["t_next"] for r in time.asof_frames(p, f, -1, missing="null").collect()}
    assert back["2000-01-01T00:00:00"].year == 2000 and back["2000-01-01T00:01:00"].minute == 1
    assert time.asof_frames(p, f, missing="drop").count() == 6


def test_frames_of_several_series(spark):
    """Each series looks into its own levels; unknown series, null series and null times stay, repeated rows too."""
    at = lambda s: F.timestamp_seconds(F.lit(946684800) + F.col(s)).cast("timestamp_ntz").alias("time")
    f = spark.createDataFrame([("a", s) for s in (0, 1, 100, 100_000)] + [("b", 0), ("b", 60), (None, 0), (None, 5)], "k string, s long").select("k", at("s"))
    rows = [(0, "a", 0), (1, "a", 50), (2, "a", 50_000), (3, "b", 59), (4, "b", 60), (5, "c", 0), (6, None, 0), (7, "a", None), (3, "b", 59), (8, "a", 100_000)]
    p = spark.createDataFrame(rows, "id int, k string, s long").select("id", "k", at("s"))
    got = sorted((r["id"], r["t_last"] and r["t_last"].second) for r in time.asof_frames(p, f, by=["k"], missing="null").collect())
    assert got == [(0, 0), (1, 1), (2, 40), (3, 0), (3, 0), (4, None), (5, None), (6, None), (7, None), (8, None)]
    assert time.asof_frames(p, f.where("false"), by=["k"], missing="null").count() == len(rows)
    assert time.asof_frames(p, f.where("false"), missing="null").where("t_last is null").count() == len(rows)
    assert time.asof_frames(p, f, by=["k"], missing="drop").count() == 5


def test_frames_over_days(spark):
    """Neighbouring frames days apart meet over the bucket edge."""
    f = frames(spark, 0, 10 * 86400, 10 * 86400 + 5, 25 * 86400)
    got = [(r["t_last"].day, r["t_next"].day) for r in time.frame_intervals(f).orderBy("t_last").collect()]
    assert got == [(1, 11), (11, 11), (11, 26)]


def test_schedule_errors(spark):
    with pytest.raises(ValueError):
        time.release_schedule(spark, "2000-01-01", 3)
    with pytest.raises(Exception, match="contradicts"):
        time.release_schedule(spark, "2000-01-02", 1, end="2000-01-01").collect()


def test_seed_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.5, 2.5, 0.0), (1, -3.25, 4.0, -1.0)], "group_id int, x1 double, x2 double, x3 double")
    writers.write_seeds(df, str(tmp_path / "seeds"))
    assert {tuple(r) for r in readers.read_seeds(spark, str(tmp_path / "seeds")).drop("line").collect()} == {tuple(r) for r in df.collect()}
    (tmp_path / "bad.txt").write_text("3\n1 2 3 4\n")
    with pytest.raises(ValueError, match="declared"):
        readers.read_seeds(spark, str(tmp_path / "bad.txt"))
    with pytest.raises(ValueError, match="declared"):
        writers.write_seeds(df, str(tmp_path / "other"), n=5)


def test_kernel_density_integrates_to_one(spark):
    rng = np.random.default_rng(5)
    z = rng.uniform(-9.5, -0.5, 300)
    fixes = spark.createDataFrame([(0, float(v)) for v in z], "release int, z double").withColumn("time", F.lit("2000-01-01").cast("timestamp_ntz"))
    grid = np.linspace(-10, 0, 201)
    levels = spark.createDataFrame([(k, float(v), -10.0, 0.0) for k, v in enumerate(grid)], "level int, z double, lo double, hi double")
    levels = levels.withColumn("time", F.lit("2000-01-01").cast("timestamp_ntz"))
    d = np.array([r["density"] for r in analytics.density_1d(fixes, levels).orderBy("level").collect()])
    assert np.trapezoid(d, grid) == pytest.approx(1.0, abs=0.02)


def test_plane_density_against_numpy(spark):
    rng = np.random.default_rng(6)
    xy = rng.normal(size=(200, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]])
    fixes = spark.createDataFrame([(0, float(x), float(y)) for x, y in xy], "release int, x double, y double").withColumn("time", F.lit("2000-01-01").cast("timestamp_ntz"))
    ev = [(k, 0.1 * k - 2, 0.05 * k - 1) for k in range(40)]
    points = spark.createDataFrame(ev, "slot int, ex double, ey double")
    got = [r["density"] for r in analytics.density_2d(fixes, points, [0]).orderBy("slot").collect()]
    c = np.cov(xy.T) * len(xy) ** (-1 / 3)
    inv, norm = np.linalg.inv(c), len(xy) * 2 * np.pi * np.sqrt(np.linalg.det(c))
    want = [np.exp(-0.5 * np.einsum("ij,jk,ik->i", (xy - e[1:]), inv, (xy - e[1:]))).sum() / norm for e in ev]
    assert got == pytest.approx(want)


def test_reader_errors(spark):
    df = spark.createDataFrame([("a", 0, 1, 1.0)], "variable string, level int, node_id long, value double").withColumn("time", F.lit("2000-01-01").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="no mask"):
        readers.mask_of(df, "a")
    with pytest.raises(ValueError, match="one time point"):
        readers.validate_period(readers.file_coverage(df, "variable"), "2000-01-01", "2000-01-02")
    with pytest.raises(ValueError, match="dimensions"):
        readers.unpivot_arrays(df, ["time"], "value")


def test_unpivot_all_dimensions(spark):
    data = [[[[float(1000 * t + 100 * d + 10 * la + lo) for lo in range(3)] for la in range(2)] for d in range(2)] for t in range(2)]
    df = spark.createDataFrame([(data,)], "a array<array<array<array<double>>>>")
    out = readers.unpivot_arrays(df, ["time", "depth", "lat", "lon"], "a").collect()
    assert len(out) == 24
    for r in out:
        lo, la = divmod(r["node_id"], 2)
        assert r["value"] == 1000 * r["time_index"] + 100 * r["depth_index"] + 10 * la + lo
