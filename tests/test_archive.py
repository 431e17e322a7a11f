"""Field archives: numbering along a curve, and joins that read buckets and folders in place."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from spark_drift.operators import archive, locate, sample, time
from spark_drift.operators.mesh import element_mask, lattice_mesh
from spark_drift.schema import Mesh

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def mesh(spark):
    axis = lambda c: spark.range(40).select(F.col("id").alias("idx"), F.col("id").cast("double").alias(c))
    m = lattice_mesh(axis("x"), axis("y"))
    nodes = m.nodes.withColumns({"h": F.lit(10.0), "mask": F.lit(0)})
    return Mesh(nodes.cache(), element_mask(m.elements, nodes).cache(), "cartesian")


def test_numbers_along_the_curve(spark, mesh):
    rows = archive.curve_permutation(mesh.nodes)
    got = rows.join(mesh.nodes, "node_id").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1600))
    far = [max(r.x for r in got[i:i + 64]) - min(r.x for r in got[i:i + 64]) + max(r.y for r in got[i:i + 64]) - min(r.y for r in got[i:i + 64]) for i in range(0, 1600, 64)]
    assert sorted(far)[len(far) // 2] < 32  # blocks of 64 nodes are about 8 wide, not a line of 40 or more
    again = archive.renumber_mesh(mesh, rows)
    place = {r.node_id: r.place for r in rows.collect()}
    old = {r.element_id: [place[n] for n in r.nv] for r in mesh.elements.collect()}
    assert {r.element_id: list(r.nv) for r in again.elements.collect()} == old
    assert again.nodes.columns == mesh.nodes.columns and again.nodes.count() == 1600
    one = archive.curve_permutation(mesh.nodes.limit(1)).collect()
    assert [r.place for r in one] == [0]


def test_join_reads_the_archive_in_place(spark, mesh, tmp_path):
    m = archive.renumber_mesh(mesh, archive.curve_permutation(mesh.nodes))
    frames = spark.createDataFrame([(T0 + dt.timedelta(days=d),) for d in range(12)], "time timestamp_ntz")
    day = F.unix_date(F.col("time").cast("date")) - 19723
    fields = m.nodes.join(frames, F.lit(True)).select(F.lit("zeta").alias("variable"), "time", F.lit(0).alias("level"), "node_id", (F.col("x") + 100 * day).alias("value"))
    table = f"fields_{uuid.uuid4().hex}"
    stored = archive.write_archive(fields, table, str(tmp_path / "archive"), 400, 16)
    # two corners of the mesh, two times nine days apart
    fixes = spark.createDataFrame([(i, float(i % 3) + 0.25, float(i % 2) + 0.5, T0 + dt.timedelta(days=9 * (i % 2), hours=6)) for i in range(12)],
                                  "fix_id long, x double, y double, time timestamp_ntz")
    found = locate.locate_points(fixes, m).where("host is not null")
    framed = time.asof_frames(found, frames)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = sample.interp_2d_time(framed, stored, "zeta")
        got = {r.fix_id: r.zeta for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan()
        text = plan.toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.sql(f"DROP TABLE {table}")
    assert got == {i: pytest.approx(i % 3 + 0.25 + 100 * (9 * (i % 2) + 0.25)) for i in range(12)}
    lines = text.split("Initial Plan")[0].split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and table in line)
    assert "Bucketed: true" in lines[scan]
    assert len(re.findall(r"array_contains\(Subquery", lines[scan])) >= 1
    depth, above = lines[scan].index("FileScan"), []
    for line in reversed(lines[:scan]):
        here = re.search("[A-Za-z*]", line)
        if here and here.start() < depth:
            depth = here.start()
            above.append(line[depth:depth + 40])
    joins = [i for i, name in enumerate(above) if "Join" in name]
    # neither the choice of rows, nor their grouping, nor the join with the hosts moves the archive
    assert not any("Exchange" in name for name in above[:joins[1]]), above
    assert any("HashAggregate" in name for name in above[joins[0]:joins[1]])
    leaves = []

    def walk(node):
        if "FileScan parquet" in node.simpleString(500) and table in node.simpleString(5000):
            leaves.append(node)
        for child in [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)
        for name in ("executedPlan", "plan"):
            if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec",) and name == "executedPlan" or node.getClass().getSimpleName().endswith("QueryStageExec") and name == "plan":
                walk(getattr(node, name)())

    walk(plan)
    folders = max(int(n.metrics().apply("numPartitions").value()) for n in leaves)
    assert 0 < folders <= 8  # of 12 days × 4 blocks


def test_other_tables_are_left_as_they_are(spark):
    rows = spark.createDataFrame([("v", T0, 0, 1, 2.0)], "variable string, time timestamp_ntz, level int, node_id long, value double")
    assert archive.pruned(rows, rows.select("node_id", "time")) is rows
