"""Small meshes with known answers."""

from datetime import datetime

from spark_drift.schema import Mesh

T0, T1 = datetime(2000, 1, 1), datetime(2000, 1, 1, 1)

NODES = [(0, 2.0, 1.0, 10.0), (1, 1.0, 1.0, 11.0), (2, 0.0, 1.0, 10.0), (3, 2.0, 2.0, 11.0), (4, 1.0, 2.0, 11.0),
         (5, 1.5, 3.0, 10.0), (6, 3.0, 1.0, 10.0)]
ZETA = {0: (0, 0), 1: (1, 2), 2: (0, 0), 3: (1, 2), 4: (1, 2), 5: (0, 0), 6: (0, 0)}
ELEMENTS = [(0, [4, 3, 1], [1, 2, 3], 0), (1, [0, 1, 3], [0, 4, -1], 0), (2, [2, 4, 1], [0, -1, -1], 2),
            (3, [4, 5, 3], [-1, 0, -1], 2), (4, [3, 6, 0], [-1, 1, -1], 2)]


def plane(spark) -> Mesh:
    """Five elements, seven nodes, clockwise; elements 2, 3 and 4 are land."""
    nodes = spark.createDataFrame([(i, x, y, h, 0) for i, x, y, h in NODES], "node_id long, x double, y double, h double, mask int")
    elements = spark.createDataFrame(ELEMENTS, "element_id long, nv array<bigint>, nbe array<bigint>, mask_c int")
    return Mesh(nodes, elements)


def plane_fields(spark):
    """ζ, Kz on interfaces, T on layers, u on layers, at 0 s and 3600 s."""
    kz = ((0, .01, .01, 0), (0, .1, .1, 0))
    temp = ((.01, .01, 0), (.1, .1, 0))
    u = ((2, 1, 0), (4, 2, 0))
    rows = []
    for n, z in ZETA.items():
        for i, t in enumerate((T0, T1)):
            rows.append(("zeta", t, 0, n, float(z[i])))
            rows += [("kz", t, k, n, float(v)) for k, v in enumerate(kz[i])]
            rows += [("thetao", t, k, n, float(v)) for k, v in enumerate(temp[i])]
            rows += [("uo", t, k, n, float(v)) for k, v in enumerate(u[i])]
    return spark.createDataFrame(rows, "variable string, time timestamp_ntz, level int, node_id long, value double")


def frames(spark):
    return spark.createDataFrame([(T0,), (T1,)], "time timestamp_ntz")
