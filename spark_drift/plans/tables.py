"""The library's tables derived from the given test tables.

One SQL text per table serves Spark and the comparison engine; the few function names
that differ are written as macros. Lattice products are built by operators on the Spark
side and by SQL on the other."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spark_drift.schema import Mesh
from spark_drift.sources.writers import write_mesh
from spark_drift.util import scratch_folder, ts_literal

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

MACROS = {
    "TRUNC_SECOND": ("CAST(date_trunc('SECOND', {}) AS TIMESTAMP_NTZ)", "date_trunc('second', {})"),
    "TRUNC_DAY": ("CAST(date_trunc('DAY', {}) AS TIMESTAMP_NTZ)", "date_trunc('day', {})"),
    "TRUNC_HOUR": ("CAST(date_trunc('HOUR', {}) AS TIMESTAMP_NTZ)", "date_trunc('hour', {})"),
    "TRUNC_MONTH": ("CAST(date_trunc('MONTH', {}) AS TIMESTAMP_NTZ)", "date_trunc('month', {})"),
    "KLIST": ("explode(sequence(0, {} - 1))", "unnest(range({}))"),
    "DAYNUM": ("unix_date(CAST({} AS DATE))", "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))"),
    "SECS": ("unix_seconds(CAST({} AS TIMESTAMP))", "CAST(epoch({}) AS BIGINT)"),
    "MKTS": ("CAST(timestamp_seconds({}) AS TIMESTAMP_NTZ)", "make_timestamp(CAST({} AS BIGINT) * 1000000)"),
}

# Text common to both engines.
SHARED = {
    "fixes": """
        SELECT event_id AS fix_id, user_id AS particle_id, ascii(event_type) - 96 AS group_id,
          CAST(floor((DAYNUM(ts) - 19723) / 7) AS INT) AS release, TRUNC_SECOND(ts) AS time,
          CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) / 10 + CAST(0.013721357 AS DOUBLE) AS x,
          CAST(event_id * 37 % 100 AS DOUBLE) / 10 + CAST(0.007193751 AS DOUBLE) AS y,
          -(value % 30) AS z,
          CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_status,
          CASE WHEN event_type IN ('error', 'purchase') THEN 0 ELSE 1 END AS in_domain,
          CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS is_beached,
          CAST(event_id % 3 AS INT) AS land_boundary_encounters
        FROM events""",
    "points": """
        SELECT c_custkey AS point_id, CAST(c_custkey * 13 % 1050 AS DOUBLE) / 100 + CAST(0.003718291 AS DOUBLE) AS x,
          CAST(c_custkey * 29 % 1000 AS DOUBLE) / 100 + CAST(0.007193751 AS DOUBLE) AS y,
          -(abs(c_acctbal) % 30) AS z
        FROM customer""",
    "axis_x0": """
        SELECT CAST(floor(sqrt(p_partkey)) AS BIGINT) AS idx, CAST(sum(p_size) % 17 AS INT) AS wx
        FROM part GROUP BY 1""",
    "axis_y0": """
        SELECT CAST(floor(sqrt(c_custkey)) AS BIGINT) AS idx,
          CAST(sum(CAST(floor(abs(c_acctbal)) AS BIGINT)) % 13 AS INT) AS wy
        FROM customer GROUP BY 1""",
    "axis_x": "SELECT idx, wx, idx * CAST(10 AS DOUBLE) / (SELECT max(idx) FROM axis_x0) AS v FROM axis_x0",
    "axis_y": "SELECT idx, wy, idx * CAST(10 AS DOUBLE) / (SELECT max(idx) FROM axis_y0) AS v FROM axis_y0",
    "frame_times": """
        SELECT DISTINCT TRUNC_DAY(ts) AS time FROM events
        UNION SELECT MKTS((SELECT max(DAYNUM(ts)) + 1 FROM events) * 86400) AS time""",
    "profiles": """
        SELECT time, level, -CAST(level AS DOUBLE) * 6 - 1 + (DAYNUM(time) % 5) * CAST(0.1 AS DOUBLE) AS z,
          CAST(n AS DOUBLE) + level AS value
        FROM (SELECT TRUNC_MONTH(o_orderdate) AS time, CAST(o_custkey % 6 AS INT) AS level, count(*) AS n
          FROM orders GROUP BY TRUNC_MONTH(o_orderdate), CAST(o_custkey % 6 AS INT)) m""",
    "day_fixes": """
        SELECT fix_id, particle_id, CAST(particle_id % 4 AS INT) AS release, TRUNC_DAY(time) AS time, group_id, x, y, z FROM fixes""",
    "hours": "SELECT DISTINCT TRUNC_HOUR(ts) AS time FROM events",
    # pairs of geographic positions and plane segments, one per order
    "pairs": """
        SELECT o_orderkey AS id, CAST(o_orderkey * 7919 % 36000 AS DOUBLE) / 100 - 180 AS lon1,
          CAST(o_orderkey * 104729 % 17800 AS DOUBLE) / 100 - 89 AS lat1,
          CAST(o_custkey * 6007 % 36000 AS DOUBLE) / 100 - 180 AS lon2,
          CAST(o_custkey * 1301 % 17800 AS DOUBLE) / 100 - 89 AS lat2,
          CAST(o_orderkey * 17 % 1000 AS DOUBLE) / 100 AS ax, CAST(o_orderkey * 71 % 1000 AS DOUBLE) / 100 AS ay,
          CAST(o_orderkey * 29 % 1000 AS DOUBLE) / 100 AS bx, CAST(o_orderkey * 43 % 1000 AS DOUBLE) / 100 AS by_,
          CAST(o_custkey * 19 % 1000 AS DOUBLE) / 100 AS cx, CAST(o_custkey * 73 % 1000 AS DOUBLE) / 100 AS cy,
          CAST(o_custkey * 31 % 1000 AS DOUBLE) / 100 AS dx, CAST(o_custkey * 47 % 1000 AS DOUBLE) / 100 AS dy,
          o_totalprice AS p
        FROM orders""",
    "rad": """
        SELECT id, radians(lon1) AS a1, radians(lat1) AS b1, radians(lon2) AS a2, radians(lat2) AS b2,
          radians(lon2 * CAST(0.5 AS DOUBLE)) AS a3, radians(lat1 * CAST(-0.5 AS DOUBLE) + 3) AS b3, p FROM pairs""",
    "units": """
        SELECT id, cos(a1) * cos(b1) AS x1, sin(a1) * cos(b1) AS y1, sin(b1) AS z1,
          cos(a2) * cos(b2) AS x2, sin(a2) * cos(b2) AS y2, sin(b2) AS z2,
          cos(a3) * cos(b3) AS x3, sin(a3) * cos(b3) AS y3, sin(b3) AS z3, a1, b1, a2, b2 FROM rad""",
    "zones": """
        SELECT CAST(s_suppkey AS INT) AS group_id, CAST(s_suppkey * 7 % 100 AS DOUBLE) / 10 AS cx,
          CAST(s_suppkey * 31 % 100 AS DOUBLE) / 10 AS cy,
          CAST(0.3 AS DOUBLE) + CAST(s_suppkey % 3 AS DOUBLE) / 8 AS radius, 20 + s_nationkey AS n,
          CAST(0 AS DOUBLE) AS depth
        FROM supplier""",
}

# Masks, depths and field values on the lattice, the same text for both engines.
NODE_MASK = "CASE WHEN CAST(floor(lon_index / 4) + floor(lat_index / 3) AS INT) % 5 = 0 THEN 1 ELSE 0 END"
NODE_H = "CAST(30 AS DOUBLE) + wx * CAST(0.50213371 AS DOUBLE) + wy * CAST(0.25391173 AS DOUBLE)"
FIELD_VALUES = {
    "thetao": "10 + wx * CAST(0.40137913 AS DOUBLE) - level * CAST(1.5 AS DOUBLE) + day * CAST(0.05017391 AS DOUBLE) * (1 + wy)",
    "uo": "(wy - 6) * CAST(0.05013917 AS DOUBLE) * (4 - level) + day * CAST(0.01031793 AS DOUBLE)",
    "vo": "(wx - 8) * CAST(0.04019371 AS DOUBLE) * (4 - level) - day * CAST(0.02071933 AS DOUBLE)",
    "wo": "(wx + wy) * CAST(0.00101739 AS DOUBLE) * level",
    "zeta": "wx * CAST(0.02013179 AS DOUBLE) + day * CAST(0.01079317 AS DOUBLE)",
    "kz": "CAST(0.01017393 AS DOUBLE) * (1 + wx) * level * (4 - level) + day * CAST(0.00013179 AS DOUBLE)",
    "u10": "wx * CAST(1.01793931 AS DOUBLE) + day * CAST(0.10317917 AS DOUBLE)",
    "v10": "wy * CAST(1.03917317 AS DOUBLE) - day * CAST(0.10791371 AS DOUBLE)",
    "usd": "wx * CAST(0.01013937 AS DOUBLE)",
    "vsd": "wy * CAST(0.01073931 AS DOUBLE) + day * CAST(0.00103917 AS DOUBLE)",
}
SURFACE_ONLY = {"zeta", "u10", "v10", "usd", "vsd"}
N_LEVELS = 4
LEVEL_DEPTHS = (0.0, 8.0, 16.0, 24.0)

# Lattice tables of the comparison engine only.
ORACLE_ONLY = {
    "nodes": f"""
        SELECT a.idx * (SELECT count(*) FROM axis_y0) + b.idx AS node_id, a.v AS x, b.v AS y, a.idx AS lon_index,
          b.idx AS lat_index, wx, wy, h0.h, h0.mask
        FROM axis_x a CROSS JOIN axis_y b,
          LATERAL (SELECT {NODE_H} AS h, {NODE_MASK.replace('lon_index', 'a.idx').replace('lat_index', 'b.idx')} AS mask) h0""",
    "cells": """
        SELECT a.idx AS i, b.idx AS j, (SELECT count(*) FROM axis_x0) AS na, (SELECT count(*) FROM axis_y0) AS nb
        FROM axis_x0 a CROSS JOIN axis_y0 b
        WHERE a.idx < (SELECT max(idx) FROM axis_x0) AND b.idx < (SELECT max(idx) FROM axis_y0)""",
    "elems": """
        SELECT 2 * (i * (nb - 1) + j) AS element_id, i * nb + j AS n0, (i + 1) * nb + j + 1 AS n1,
          (i + 1) * nb + j AS n2 FROM cells
        UNION ALL
        SELECT 2 * (i * (nb - 1) + j) + 1, i * nb + j, i * nb + j + 1, (i + 1) * nb + j + 1 FROM cells""",
    "tri": """
        SELECT e.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2,
          a.mask AS m0, b.mask AS m1, c.mask AS m2,
          CASE a.mask + b.mask + c.mask WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS mask_c
        FROM elems e JOIN nodes a ON e.n0 = a.node_id JOIN nodes b ON e.n1 = b.node_id JOIN nodes c ON e.n2 = c.node_id""",
    "sides": """
        SELECT element_id, 0 AS slot, least(n1, n2) AS s, greatest(n1, n2) AS e, n1 AS va, n2 AS vb FROM elems
        UNION ALL SELECT element_id, 1, least(n2, n0), greatest(n2, n0), n2, n0 FROM elems
        UNION ALL SELECT element_id, 2, least(n0, n1), greatest(n0, n1), n0, n1 FROM elems""",
    "adjacency": """
        SELECT a.element_id, a.slot, coalesce(b.element_id, -1) AS nb, a.va, a.vb
        FROM sides a LEFT JOIN sides b ON a.s = b.s AND a.e = b.e AND a.element_id <> b.element_id""",
    "fields": "\nUNION ALL\n".join(
        f"""SELECT '{v}' AS variable, f.time, CAST(l.level AS INT) AS level, n.node_id, {expr} AS value
        FROM nodes n CROSS JOIN (SELECT time, DAYNUM(time) - 19723 AS day FROM frame_times) f
        CROSS JOIN (SELECT unnest([{', '.join(str(k) for k in range(1 if v in SURFACE_ONLY else N_LEVELS))}]) AS level) l"""
        for v, expr in FIELD_VALUES.items()),
    "located": """
        SELECT point_id, min(element_id) AS host FROM (
          SELECT p.point_id, t.element_id, ((x1-x0)*(p.y-y0)-(y1-y0)*(p.x-x0)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f2,
            ((y2-y0)*(p.x-x2)-(x2-x0)*(p.y-y2)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f1
          FROM points p JOIN tri t ON p.x >= least(x0,x1,x2) AND p.x <= greatest(x0,x1,x2)
            AND p.y >= least(y0,y1,y2) AND p.y <= greatest(y0,y1,y2)) q
        WHERE f1 >= 0 AND f2 >= 0 AND 1 - f1 - f2 >= 0 GROUP BY point_id""",
    "fix_located": """
        SELECT point_id AS fix_id, min(element_id) AS host FROM (
          SELECT p.fix_id AS point_id, t.element_id,
            ((x1-x0)*(p.y-y0)-(y1-y0)*(p.x-x0)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f2,
            ((y2-y0)*(p.x-x2)-(x2-x0)*(p.y-y2)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f1
          FROM fixes p JOIN tri t ON p.x >= least(x0,x1,x2) AND p.x <= greatest(x0,x1,x2)
            AND p.y >= least(y0,y1,y2) AND p.y <= greatest(y0,y1,y2)) q
        WHERE f1 >= 0 AND f2 >= 0 AND 1 - f1 - f2 >= 0 GROUP BY point_id""",
    # one row per fix in a sea element: host nodes, weights, bracketing frames
    "fix_hosts": """
        SELECT p.*, h.host, t.n0, t.n1, t.n2, t.mask_c, 1 - f.f1 - f.f2 AS phi0, f.f1 AS phi1, f.f2 AS phi2,
          TRUNC_DAY(p.time) AS t_last, MKTS((DAYNUM(p.time) + 1) * 86400) AS t_next,
          CAST(SECS(p.time) % 86400 AS DOUBLE) / 86400 AS tf
        FROM fixes p JOIN fix_located h ON p.fix_id = h.fix_id JOIN tri t ON h.host = t.element_id,
          LATERAL (SELECT ((y2-y0)*(p.x-x2)-(x2-x0)*(p.y-y2)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f1,
            ((x1-x0)*(p.y-y0)-(y1-y0)*(p.x-x0)) / ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) AS f2) f
        WHERE t.mask_c <> 2""",
    # long form: value of every variable and level at every located fix
    "fix_levels": """
        SELECT w.fix_id, f.variable, f.level, sum(w.wt * f.value) AS value FROM (
          SELECT fix_id, n0 AS node_id, t_last AS time, phi0 * (1 - tf) AS wt FROM fix_hosts
          UNION ALL SELECT fix_id, n1, t_last, phi1 * (1 - tf) FROM fix_hosts
          UNION ALL SELECT fix_id, n2, t_last, phi2 * (1 - tf) FROM fix_hosts
          UNION ALL SELECT fix_id, n0, t_next, phi0 * tf FROM fix_hosts
          UNION ALL SELECT fix_id, n1, t_next, phi1 * tf FROM fix_hosts
          UNION ALL SELECT fix_id, n2, t_next, phi2 * tf FROM fix_hosts) w
        JOIN fields f ON f.node_id = w.node_id AND f.time = w.time
        GROUP BY 1, 2, 3""",
}


def _expand(sql: str, engine: int) -> str:
    """Replace the macros, innermost call first."""
    while True:
        hits = [m for m in re.finditer(r"\b(" + "|".join(MACROS) + r")\(", sql)]
        if not hits:
            return sql
        m = hits[-1]
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[: m.start()] + MACROS[m.group(1)][engine].format(sql[m.end(): end - 1]) + sql[end:]


def _with(sql: str, defs: dict[str, str]) -> str:
    """Prefix the definitions that the text uses, each after those it uses itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in defs:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                visit(defs[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({defs[n].strip()})" for n in order)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def oracle_text(sql: str) -> str:
    return _expand(_with(sql, {**SHARED, **ORACLE_ONLY}), 1)


_STORED: dict[tuple, tuple[str, str]] = {}


class Tables:
    """Lazy DataFrames over one folder of the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run the shared dialect in Spark."""
        text = _expand(_with(text, SHARED), 0)
        names = "|".join(BASE)
        text = re.sub(rf"\b(FROM|JOIN)\s+({names})\b", lambda m: f"{m[1]} parquet.`{self.sf_dir}/{m[2]}.parquet`", text)
        return self.spark.sql(text)

    def table(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    @cached_property
    def fixes(self) -> DataFrame:
        return self.table("fixes")

    def stream_fixes(self) -> DataFrame:
        """The fixes as a stream over the events file."""
        schema = self.base("events").schema
        events = self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(self.sf_dir)
        text = _expand(re.sub(r"\bFROM events\b", "FROM {events}", SHARED["fixes"]), 0)
        return self.spark.sql(text, events=events)

    @cached_property
    def points(self) -> DataFrame:
        return self.table("points")

    @cached_property
    def frame_times(self) -> DataFrame:
        return self.table("frame_times")

    @cached_property
    def raw_mesh(self) -> Mesh:
        """The plane lattice with masks, depths and element masks, built from the axes."""
        from spark_drift.operators.mesh import element_mask, lattice_mesh

        m = lattice_mesh(self.table("axis_x"), self.table("axis_y"))
        nodes = m.nodes.withColumn("h", F.expr(NODE_H)).withColumn("mask", F.expr(NODE_MASK))
        return Mesh(nodes, element_mask(m.elements, nodes), "cartesian")

    def _stored(self, name: str, build) -> Mesh:
        """The mesh as written tables: built once per application and folder, then read."""
        from spark_drift.operators.mesh import prepare_mesh

        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        for attempt in (0, 1):
            if key not in _STORED or attempt:
                path = scratch_folder(self.spark, "mesh")
                mesh = build()
                write_mesh(mesh.nodes, mesh.elements, path)
                nodes = self.spark.read.parquet(f"{path}/nodes")
                elements = self.spark.read.parquet(f"{path}/elements")
                ready = prepare_mesh(Mesh(nodes, elements, mesh.cs))
                ready.elements.write.parquet(f"{path}/prepared")
                _STORED[key] = (path, mesh.cs)
            path, cs = _STORED[key]
            try:
                return Mesh(self.spark.read.parquet(f"{path}/nodes"), self.spark.read.parquet(f"{path}/prepared"), cs)
            except AnalysisException:  # the folder was cleared: build again
                if attempt:
                    raise
        raise AssertionError

    @cached_property
    def mesh(self) -> Mesh:
        return self._stored("plane", lambda: self.raw_mesh)

    @cached_property
    def geo_mesh(self) -> Mesh:
        """The same lattice stretched over the date line at high latitude."""
        def build() -> Mesh:
            nodes = self.mesh.nodes.withColumns({"x": F.expr(GEO_X), "y": F.expr(GEO_Y)})
            return Mesh(nodes, self.mesh.elements, "geographic")

        return self._stored("sphere", build)

    @cached_property
    def geo_points(self) -> DataFrame:
        return self.points.withColumns({"x": F.expr(GEO_X), "y": F.expr(GEO_Y)})

    @cached_property
    def first_and_last_frame(self):
        return self.sql("SELECT min(TRUNC_DAY(ts)), MKTS((max(DAYNUM(ts)) + 1) * 86400) FROM events").first()

    def fields(self, *variables: str) -> DataFrame:
        """Long field rows: every node at every frame and level."""
        lo, hi = self.first_and_last_frame
        step = F.expr("INTERVAL 1 DAY")
        frames = F.explode(F.sequence(ts_literal(lo), ts_literal(hi), step))
        rows = self.mesh.nodes.select("node_id", "wx", "wy", frames.alias("time"))
        rows = rows.withColumn("day", F.unix_date(F.col("time").cast("date")) - F.lit(19723))
        parts = []
        for v in variables:
            n = 1 if v in SURFACE_ONLY else N_LEVELS
            part = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            value = F.expr(FIELD_VALUES[v]).cast("double").alias("value")
            parts.append(part.select(F.lit(v).alias("variable"), "time", "level", "node_id", value))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


GEO_X = "CASE WHEN x * 4 + 160 > 180 THEN x * 4 + 160 - 360 ELSE x * 4 + 160 END"
GEO_Y = "60 + y * CAST(2.5 AS DOUBLE)"
ORACLE_ONLY["geo_nodes"] = f"SELECT node_id, mask, {GEO_X} AS x, {GEO_Y} AS y FROM nodes"
ORACLE_ONLY["geo_points"] = f"SELECT point_id, {GEO_X} AS x, {GEO_Y} AS y FROM points"
