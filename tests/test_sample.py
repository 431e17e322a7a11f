from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from spark_drift.operators import sample, time
from spark_drift.operators.locate import locate_points

SIGMA = dict(sigma_levels=(0, -0.2, -0.8, -1), sigma_layers=(-0.1, -0.5, -0.9))


def framed(spark, seconds, z, x=4 / 3, y=5 / 3):
    t = fx.T0 + timedelta(seconds=seconds)
    pts = spark.createDataFrame([(0, t, x, y, z)], "point_id long, time timestamp_ntz, x double, y double, z double")
    found = locate_points(pts, fx.plane(spark)).where("host is not null")
    return time.asof_frames(found, fx.frames(spark))


def layered(spark, seconds, z, **kw):
    m = fx.plane(spark)
    return sample.sample_layers(framed(spark, seconds, z), fx.plane_fields(spark), m.nodes, **SIGMA, **kw).first()


def test_layer_position(spark):
    r = layered(spark, 0, -2.6)
    assert (r["k"], r["k_upper"], r["k_lower"], r["level_flag"]) == (1, 0, 1, 0)
    assert r["omega"] == pytest.approx(0.8333, abs=1e-4) and r["omega_layers"] == pytest.approx(0.5)


@pytest.mark.parametrize("seconds,z,want", [(0, -2.6, 1.5), (1800, -2.25, 2.25)])
def test_layer_velocity(spark, seconds, z, want):
    assert layered(spark, seconds, z, on_layers=["uo"])["uo"] == pytest.approx(want)


def test_layer_temperature(spark):
    assert layered(spark, 0, -0.1, on_layers=["thetao"])["thetao"] == pytest.approx(0.01)


def test_diffusivity_and_its_gradient(spark):
    r = layered(spark, 0, -0.2, on_levels=["kz"], gradients=["kz"])
    assert r["kz"] == pytest.approx(0.005) and r["dkz_dz"] == pytest.approx(-0.0026042, abs=1e-6)


def test_outside_the_column(spark):
    assert layered(spark, 0, -50.0)["level_flag"] == -3


def test_basis_gradients(spark):
    r = sample.basis_gradients(fx.plane(spark)).where("element_id = 1").first()
    assert [r[f"gx{k}"] for k in range(3)] == pytest.approx([1, -1, 0])
    assert [r[f"gy{k}"] for k in range(3)] == pytest.approx([-1, 0, 1])


def test_linear_field_is_exact(spark):
    m = fx.plane(spark)
    nodes = m.nodes.withColumn("f", 3 + 2 * F.col("x") - 5 * F.col("y"))
    pts = spark.createDataFrame([(i, 1 + 0.09 * i, 1.9 - 0.05 * i) for i in range(10)], "point_id long, x double, y double")
    out = sample.interp_2d(locate_points(pts, m).where("host is not null"), nodes, "f", "f").collect()
    assert out and all(r["f"] == pytest.approx(3 + 2 * r["x"] - 5 * r["y"]) for r in out)


def test_shepard(spark):
    """Four centres on a diagonal; then the same without the last."""
    from spark_drift.schema import Mesh

    d = 0.1
    nodes, elements = [], []
    for e, c in enumerate((-2.0, -1.0, 1.0, 2.0)):
        base = 3 * e
        nodes += [(base, c - d, c - d), (base + 1, c - d, c + 2 * d), (base + 2, c + 2 * d, c - d)]
        elements.append((e, [base, base + 1, base + 2], [1, 2, 3] if e == 0 else [-1, -1, -1]))
    n = spark.createDataFrame(nodes, "node_id long, x double, y double")
    el = spark.createDataFrame(elements, "element_id long, nv array<bigint>, nbe array<bigint>")
    values = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 1.0), (3, 0.0)], "element_id long, value double")
    pts = spark.createDataFrame([(0, 0, 0.0, 0.0)], "point_id long, host long, x double, y double")
    assert sample.idw_neighbours(pts, values, Mesh(n, el)).first()["value"] == pytest.approx(0.4)
    short = el.withColumn("nbe", F.expr("transform(nbe, e -> if(e = 3, -1, e))"))
    assert sample.idw_neighbours(pts, values, Mesh(n, short)).first()["value"] == pytest.approx(4 / 9)
    on_centre = pts.withColumns({"x": F.lit(1.0), "y": F.lit(1.0)})
    assert sample.idw_neighbours(on_centre, values, Mesh(n, el)).first()["value"] == pytest.approx(1.0)


def test_fixed_levels_surface_and_bottom(spark):
    """Above the top level and below the last, the nearest level counts alone."""
    df = spark.createDataFrame([(0, 0.4), (1, -5.0), (2, -12.0), (3, -30.0)], "i int, z double")
    df = df.withColumns({"zmin": F.lit(-15.0), "zmax": F.lit(0.5), "a": F.lit(0.0), "b": F.lit(-10.0), "va": F.lit(1.0), "vb": F.lit(3.0)})
    out = sample.locate_level(df, "node_levels", levels=[F.col("a"), F.col("b")])
    out = out.withColumn("v", F.when(F.col("level_flag") == 0, sample.at_depth([F.col("va"), F.col("vb")], "node_levels")))
    got = {r["i"]: r for r in out.collect()}
    assert (got[0]["k"], got[0]["in_surface"], got[0]["v"]) == (0, True, 1.0)
    assert (got[1]["k"], got[1]["omega"], got[1]["v"]) == (0, 0.5, 2.0)
    assert (got[2]["k"], got[2]["in_bottom"], got[2]["v"]) == (1, True, 3.0)
    assert (got[3]["level_flag"], got[3]["v"]) == (-3, None)


def test_masked_lower_level_uses_the_upper(spark):
    df = spark.createDataFrame([(-5.0, 0, 1)], "z double, m0 int, m1 int").withColumns({"zmin": F.lit(-20.0), "zmax": F.lit(0.0)})
    out = sample.locate_level(df, "node_levels", levels=[F.lit(0.0), F.lit(-10.0)], masked=[F.col("m0"), F.col("m1")])
    r = out.withColumn("v", sample.at_depth([F.lit(1.0), F.lit(9.0)], "node_levels")).first()
    assert r["in_bottom"] and r["v"] == 1.0


def test_log_layer(spark):
    f = lambda z: spark.range(1).select(sample.log_layer_velocity(F.lit(2.0), F.lit(z), F.lit(-10.0), F.lit(-9.0), 0.01)).first()[0]
    assert f(-9.995) == 0.0 and f(-8.0) == 2.0
    assert f(-9.5) == pytest.approx(2 * np.log(0.5 / 0.01) / np.log(1 / 0.01))


def column(spark):
    rows = [(fx.T0, k, z, v) for k, (z, v) in enumerate(zip((-4.0, -3.0, -1.0, 0.0), (0.0, 1.0, 1.0, 0.0)))]
    return spark.createDataFrame(rows, "time timestamp_ntz, level int, z double, value double")


def test_column_profile(spark):
    pts = spark.createDataFrame([(0, fx.T0, -2.0), (1, fx.T0, 0.0), (2, fx.T0, -3.5)], "id int, time timestamp_ntz, z double")
    got = {r["id"]: r for r in sample.profile_linear(pts, column(spark)).collect()}
    assert (got[0]["value"], got[0]["gradient"]) == pytest.approx((1.0, 0.0))
    assert got[1]["gradient"] == pytest.approx(-1.0) and got[2]["value"] == pytest.approx(0.5)


def test_natural_spline(spark):
    """Against the same system written out for four levels."""
    z, v = np.array([-4.0, -3.0, -1.0, 0.0]), np.array([0.0, 1.0, 1.0, 0.0])
    h = np.diff(z)
    a = np.array([[2 * (h[0] + h[1]), h[1]], [h[1], 2 * (h[1] + h[2])]])
    m = np.concatenate([[0], np.linalg.solve(a, 6 * np.diff(np.diff(v) / h)), [0]])

    def at(x):
        k = min(max(np.searchsorted(z, x) - 1, 0), 2)
        p, q = z[k + 1] - x, x - z[k]
        return (m[k] * p**3 + m[k + 1] * q**3) / (6 * h[k]) + (v[k] / h[k] - m[k] * h[k] / 6) * p + (v[k + 1] / h[k] - m[k + 1] * h[k] / 6) * q

    xs = [-4.0, -3.7, -2.0, -0.3, 0.0]
    pts = spark.createDataFrame([(i, fx.T0, x) for i, x in enumerate(xs)], "id int, time timestamp_ntz, z double")
    got = {r["id"]: r for r in sample.profile_spline(pts, column(spark)).collect()}
    for i, x in enumerate(xs):
        assert got[i]["value"] == pytest.approx(at(x))
        assert got[i]["gradient"] == pytest.approx((at(x + 1e-6) - at(x - 1e-6)) / 2e-6, abs=1e-4)


def test_smagorinsky_of_pure_shear(spark):
    """u = y, v = 0: ½·c·A·√½ on every level."""
    m = fx.plane(spark)
    rows = [(v, t, k, n, float(y if v == "uo" else 0)) for v in ("uo", "vo", "zeta") for t in (fx.T0, fx.T1)
            for k in range(1 if v == "zeta" else 2) for n, _, y, _ in fx.NODES]
    fields = spark.createDataFrame(rows, "variable string, time timestamp_ntz, level int, node_id long, value double")
    r = sample.smagorinsky_diffusivity(framed(spark, 0, -1.0), fields, m, (0.0, 5.0), 0.2).first()
    assert r["ah"] == pytest.approx(0.5 * 0.2 * 0.5 * np.sqrt(0.5))


def test_gradients_on_the_sphere(spark):
    """A field that rises by one per metre northwards (and eastwards) has unit gradients."""
    from spark_drift.operators import mesh
    from spark_drift.schema import EARTH_RADIUS

    x = spark.createDataFrame([(0, 10.0), (1, 10.1), (2, 10.2)], "idx long, v double")
    y = spark.createDataFrame([(0, 50.0), (1, 50.1), (2, 50.2)], "idx long, v double")
    m = mesh.lattice_mesh(x, y, geographic=True)
    corners = mesh.element_corners(m).select("element_id", *[f"{c}{k}" for c in "xy" for k in range(3)])
    rows = sample.basis_gradients(m).join(corners, "element_id").collect()
    assert len(rows) == 8
    for r in rows:
        north = [EARTH_RADIUS * np.radians(r[f"y{k}"]) for k in range(3)]
        east = [EARTH_RADIUS * np.cos(np.radians(50.1)) * np.radians(r[f"x{k}"]) for k in range(3)]
        assert sum(r[f"gy{k}"] * v for k, v in enumerate(north)) == pytest.approx(1, abs=2e-3)
        assert sum(r[f"gx{k}"] * v for k, v in enumerate(east)) == pytest.approx(1, abs=5e-3)
        assert abs(sum(r[f"gx{k}"] * v for k, v in enumerate(north))) < 5e-3
