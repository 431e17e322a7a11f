import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from spark_drift.operators import locate, mesh
from spark_drift.schema import Mesh
from spark_drift.util import cut_lineage

PTS = "point_id long, x double, y double"


def test_plane_hosts(spark):
    pts = spark.createDataFrame([(0, 4 / 3, 5 / 3), (1, 5 / 3, 4 / 3), (2, 2 / 3, 4 / 3), (3, 9.0, 9.0)], PTS)
    rows = {r["point_id"]: r for r in locate.locate_points(pts, fx.plane(spark)).collect()}
    assert (rows[0]["host"], rows[0]["flag"]) == (0, 0)
    assert [rows[1][f"phi{k}"] for k in range(3)] == pytest.approx([1 / 3] * 3)
    assert rows[2]["host"] is None and rows[2]["flag"] == -3
    assert rows[3]["host"] is None and rows[3]["flag"] == -3


def test_corner_and_shared_side_take_lowest_id(spark):
    pts = spark.createDataFrame([(0, 1.5, 1.5), (1, 2.0, 2.0), (2, 1.0, 1.0)], PTS)
    found = {r["point_id"]: r["host"] for r in locate.locate_points(pts, fx.plane(spark)).collect()}
    assert found == {0: 0, 1: 0, 2: 0}


def test_known_corner_weights(spark):
    pts = spark.createDataFrame([(0, 2.0, 1.0, 1)], PTS + ", host long")
    r = locate.local_coordinates(pts, fx.plane(spark)).first()
    assert [r[f"phi{k}"] for k in range(3)] == pytest.approx([1, 0, 0])


def test_hint_agrees_with_full_search(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.uniform(0, 3), rnd.uniform(1, 3), rnd.randrange(5)) for i in range(200)]
    pts = spark.createDataFrame(rows, PTS + ", hint long")
    m = fx.plane(spark)
    full = {r["point_id"]: r["host"] for r in locate.locate_points(pts.drop("hint"), m).collect()}
    hinted = {r["point_id"]: (r["host"], r["flag"]) for r in locate.locate_with_hint(pts, m).collect()}
    assert {k: v[0] for k, v in hinted.items()} == full
    assert {v[1] for v in hinted.values()} == {0, -3, -4}


def lattice(spark, lons, lats, geographic=False):
    x = spark.createDataFrame(list(enumerate(map(float, lons))), "idx long, v double")
    y = spark.createDataFrame(list(enumerate(map(float, lats))), "idx long, v double")
    return mesh.lattice_mesh(x, y, geographic)


def test_lattice_neighbours_agree_with_sides(spark):
    m = lattice(spark, range(4), range(3))
    built = {r["element_id"]: list(r["nbe"]) for r in m.elements.collect()}
    found = {r["element_id"]: list(r["nbe"]) for r in mesh.element_neighbours(m.elements).collect()}
    assert built == found
    for e, nbs in built.items():
        for n in nbs:
            assert n < 0 or e in built[n]


def test_uneven_mesh_against_brute_force(spark):
    """Cells from 0.001 to 8 wide meet in one search."""
    axis = [0, 0.001, 0.003, 0.01, 0.1, 0.4, 2, 10]
    m = lattice(spark, axis, axis)
    nodes = {r["node_id"]: (r["x"], r["y"]) for r in m.nodes.collect()}
    tris = sorted((r["element_id"], [nodes[n] for n in r["nv"]]) for r in m.elements.collect())
    rnd = random.Random(2)
    rows = [(i, 10 ** rnd.uniform(-4, 1), 10 ** rnd.uniform(-4, 1)) for i in range(300)]

    def host(x, y):
        for e, ((x0, y0), (x1, y1), (x2, y2)) in tris:
            a = (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)
            p2 = ((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / a
            p1 = ((y2 - y0) * (x - x2) - (x2 - x0) * (y - y2)) / a
            if min(1 - p1 - p2, p1, p2) >= 0:
                return e

    got = {r["point_id"]: r["host"] for r in locate.locate_points(spark.createDataFrame(rows, PTS), m).collect()}
    assert got == {i: host(x, y) for i, x, y in rows}


def test_sphere_with_pole_and_date_line(spark):
    """An octahedron covers the sphere: every point has a host, poles and date line too."""
    verts = [(0, 0.0, 0.0), (1, 90.0, 0.0), (2, 180.0, 0.0), (3, -90.0, 0.0), (4, 0.0, 90.0), (5, 0.0, -90.0)]
    nodes = spark.createDataFrame(verts, "node_id long, x double, y double")
    faces = [[0, 1, 4], [1, 2, 4], [2, 3, 4], [3, 0, 4], [1, 0, 5], [2, 1, 5], [3, 2, 5], [0, 3, 5]]
    elements = mesh.element_neighbours(spark.createDataFrame([(i, f) for i, f in enumerate(faces)], "element_id long, nv array<bigint>"))
    m = Mesh(nodes, elements, "geographic")
    rnd = random.Random(3)
    rows = [(i, rnd.uniform(-180, 180), math.degrees(math.asin(rnd.uniform(-1, 1)))) for i in range(200)]
    rows += [(900, 33.0, 90.0), (901, -180.0, 40.0), (902, 180.0, -40.0), (903, 0.0, -90.0)]
    out = locate.locate_points(spark.createDataFrame(rows, PTS), m).collect()
    assert all(r["host"] is not None for r in out)
    assert all(abs(sum(r[f"phi{k}"] for k in range(3)) - 1) < 1e-9 for r in out)
    for r in out:
        if r["point_id"] < 900:
            east, north = int((r["x"] % 360) // 90), r["y"] > 0
            assert r["host"] == (east if north else 4 + east)


def test_polar_rows_are_trimmed(spark):
    m = lattice(spark, [0, 10, 200], [-90, -80, 0, 80, 90], geographic=True)
    assert m.nodes.agg(F.min("y"), F.max("y"), F.max("x"), F.count("*")).first()[0:4] == (-80.0, 80.0, 10.0, 9)


def move(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "move_id long, x double, y double, x_new double, y_new double, host long")


def test_reflection(spark):
    m = fx.plane(spark)
    moves = move(spark, (5 / 3, 1.2, 5 / 3, 0.9, 1), (1.4, 1.1, 1.6, 0.9, 1))
    hit = locate.boundary_intersection(moves, m)
    got = {r["move_id"]: (r["x_ref"], r["y_ref"]) for r in locate.reflect_across_side(hit).collect()}
    assert got[0] == pytest.approx((5 / 3, 1.1)) and got[1] == pytest.approx((1.6, 1.1))
    assert {r["flag"] for r in locate.crossings(moves, m).collect()} == {-1}


def test_open_side_and_free_move(spark):
    m = fx.plane(spark)
    opened = mesh.flag_open_boundary(m.elements, spark.createDataFrame([(0,), (1,)], "node_id long"))
    moves = move(spark, (5 / 3, 1.2, 5 / 3, 0.9, 1), (5 / 3, 4 / 3, 4 / 3, 5 / 3, 1))
    got = {r["move_id"]: (r["flag"], r["new_host"]) for r in locate.crossings(moves, Mesh(m.nodes, opened)).collect()}
    assert got == {0: (-2, 1), 1: (0, 0)}


def test_land_crossing_on_the_sphere(spark):
    m = lattice(spark, [1, 2, 3], [11, 12, 13, 14], geographic=True)
    nodes = m.nodes.withColumn("mask", (F.col("y") >= 13).cast("int"))
    el = mesh.open_lattice_boundary(mesh.element_mask(m.elements, nodes, 2))
    m = Mesh(nodes, el, "geographic")
    moves = move(spark, (1.99, 12.9, 1.99, 13.1, 0))
    hosts = locate.locate_points(moves.select(F.col("move_id").alias("point_id"), "x", "y"), m).first()["host"]
    moves = moves.withColumn("host", F.lit(hosts))
    walls = cut_lineage(locate.first_walls(moves, m))
    w = walls.first()
    assert (w["xi"], w["yi"]) == pytest.approx((1.99, 13.0), abs=1e-3)
    assert w["kind"] == -1
    r = locate.reflect_across_side(moves.join(walls, "move_id"), "geographic").first()
    assert r["y_ref"] < 13 and abs(r["x_ref"] - 1.99) < 0.01


def test_rings_reach_the_nearest_wet_element(spark):
    m = lattice(spark, range(6), range(6))
    wet = m.elements.select("element_id", (F.col("element_id") >= 40).cast("int").alias("wet"))
    pts = spark.createDataFrame([(0, 0.6, 0.3, 0), (1, 3.4, 4.2, 38)], PTS + ", host long")
    got = {r["point_id"]: r["wet_host"] for r in locate.nearest_wet_element(pts, m, wet).collect()}
    assert set(got) == {0, 1} and min(got.values()) >= 40
    assert got[1] in (40, 41, 47, 48, 49)


def _rings_by_hand(m, wet, source):
    """Elements of the first ring with a wet one, by a plain search from one source."""
    near = {r["element_id"]: [n for n in r["nbe"] if n >= 0] for r in m.elements.select("element_id", "nbe").collect()}
    seen, ring = {source}, {source}
    while ring:
        ring = {n for e in ring for n in near[e] if n in wet and n not in seen}
        hit = {e for e in ring if wet[e] == 1}
        if hit:
            return hit
        seen |= ring
    return set()


@pytest.mark.parametrize("seed", range(3))
def test_falling_distances_find_the_first_ring(spark, seed):
    """Few wet elements, some of unknown state, walls of unlisted elements: as a search from every source."""
    m = lattice(spark, range(9), range(8))
    rng = np.random.default_rng(seed)
    ids = sorted(r["element_id"] for r in m.elements.select("element_id").collect())
    state = {e: (1 if rng.random() < 0.04 else None if rng.random() < 0.1 else 0) for e in ids if rng.random() > 0.15}
    wet = spark.createDataFrame(list(state.items()), "element_id long, wet int")
    dry = [e for e, w in state.items() if w == 0]
    got = {}
    for r in locate.first_wet_ring(m, wet, spark.createDataFrame([(e,) for e in dry * 2], "element_id long")).collect():
        assert r["near"] not in got.setdefault(r["source"], set())
        got[r["source"]].add(r["near"])
    assert got == {e: hit for e in dry if (hit := _rings_by_hand(m, state, e))}


def test_distances_label_each_dry_element_once(spark):
    m = lattice(spark, range(7), range(7))
    wet = m.elements.select("element_id", (F.col("element_id") < 3).cast("int").alias("wet"))
    rings = [[r["element_id"] for r in ring.collect()] for ring in locate.wet_distances(m, wet)]
    flat = [e for ring in rings for e in ring]
    assert len(flat) == len(set(flat)) == m.elements.count() and all(rings)
    # only as far as the sources ask
    some = spark.createDataFrame([(rings[2][0],)], "element_id long")
    assert len(locate.wet_distances(m, wet, some)) == 3


def test_boundary_weights_on_the_sphere(spark):
    from spark_drift.operators.sample import adjust_boundary_phi, interp_2d

    m = lattice(spark, [1, 2, 3], [11, 12, 13, 14], geographic=True)
    h = F.element_at(F.create_map(*[F.lit(v) for v in (11.0, 25.0, 12.0, 10.0, 13.0, 999.0, 14.0, 999.0)]), F.col("y"))
    nodes = m.nodes.withColumns({"mask": (F.col("y") >= 13).cast("int"), "h": h})
    m = Mesh(nodes, mesh.element_mask(m.elements, nodes, 2), "geographic")
    pts = spark.createDataFrame([(0, 1.66707, 11.66705), (1, 1.66710, 12.66709)], PTS)
    found = adjust_boundary_phi(locate.locate_points(pts, m).where("host is not null"), m)
    got = {r["point_id"]: r["h"] for r in interp_2d(found, nodes, "h", "h").collect()}
    assert got[0] == pytest.approx(15, abs=0.01) and got[1] == pytest.approx(10)


def test_plans_hold_no_python_and_no_product(spark):
    m = lattice(spark, range(30), range(30))
    pts = spark.range(1000).select(F.col("id").alias("point_id"), (F.col("id") % 29 + 0.3).alias("x"), (F.col("id") % 23 + 0.1).alias("y"))
    plan = locate.locate_points(pts, m)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_long_moves_meet_short_walls(spark):
    """Against every wall of a mesh with sides from 0.01 to 6 long."""
    axis = [0, 0.01, 0.05, 0.4, 1, 4, 10]
    m = lattice(spark, axis, axis)
    nodes = m.nodes.withColumn("mask", ((F.col("node_id") % 5) < 2).cast("int"))
    m = Mesh(nodes, mesh.element_mask(m.elements, nodes, 0))
    rnd = random.Random(6)
    rows = [(rnd.uniform(0, 10) ** 2 / 10, rnd.uniform(0, 10) ** 2 / 10, rnd.uniform(0, 10), rnd.uniform(-1, 11), 0) for _ in range(60)]
    rows += [(0.2, 0.3, 0.2, 9.0, 0), (0.2, 0.3, 9.0, 0.3, 0)]
    walls = [(r["sx"], r["sy"], r["ex"], r["ey"]) for r in locate.wall_sides(m).collect()]
    want = {}
    for i, (x, y, xn, yn, _) in enumerate(rows):
        best = None
        for sx, sy, ex, ey in walls:
            d = (ex - sx) * (yn - y) - (ey - sy) * (xn - x)
            if d:
                t = ((x - sx) * (yn - y) - (y - sy) * (xn - x)) / d
                u = ((x - sx) * (ey - sy) - (y - sy) * (ex - sx)) / d
                if 0 <= t <= 1 and 0 <= u <= 1 and (best is None or u < best):
                    best = u
        if best is not None:
            want[i] = best * math.hypot(xn - x, yn - y)
    got = {r["move_id"]: math.hypot(r["xi"] - rows[r["move_id"]][0], r["yi"] - rows[r["move_id"]][1]) for r in locate.first_walls(move(spark, *rows), m).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_mirror_on_the_sphere_against_the_tangent_plane(spark):
    """The same mirror written with rotated axes in NumPy."""
    import numpy as np

    def frame(lon, lat):
        lon, lat = np.radians((lon, lat))
        return np.array([[-np.sin(lon), np.cos(lon), 0], [-np.sin(lat) * np.cos(lon), -np.sin(lat) * np.sin(lon), np.cos(lat)],
                         [np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]])

    unit = lambda lon, lat: frame(lon, lat)[2]
    row = dict(xi=12.3, yi=51.2, x_new=12.35, y_new=51.27, sx=12.0, sy=51.0, ex=12.9, ey=51.6)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    r = locate.reflect_across_side(df, "geographic").first()
    m = frame(row["xi"], row["yi"])
    b, s, e = (m @ unit(row[x], row[y]) for x, y in (("x_new", "y_new"), ("sx", "sy"), ("ex", "ey")))
    n = np.array([e[1] - s[1], s[0] - e[0]])
    flat = np.append(b[:2] - 2 * (n @ b[:2]) / (n @ n) * n, 1.0)
    back = m.T @ (flat / np.linalg.norm(flat))
    assert (r["x_ref"], r["y_ref"]) == pytest.approx((np.degrees(np.arctan2(back[1], back[0])), np.degrees(np.arcsin(back[2]))), abs=1e-9)
