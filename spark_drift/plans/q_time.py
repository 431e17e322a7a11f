"""Queries: time operators."""

from pyspark.sql import functions as F

from spark_drift.functions import timecols as tc
from spark_drift.operators import time as ops
from spark_drift.plans.registry import query, rd
from spark_drift.util import one_row

C = F.col


@query("decode_time", """
    SELECT o_orderkey, make_timestamp(CAST(round(o_totalprice / 100 * 86400e6) AS BIGINT) + 946684800000000) AS t_days,
      make_timestamp(CAST(o_custkey AS BIGINT) * 977 * 1000000 - 315619200000000) AS t_seconds FROM orders""")
def decode_time(t):
    return t.base("orders").select("o_orderkey", tc.decode_time(C("o_totalprice") / 100, "days since 2000-01-01 00:00:00").alias("t_days"),
                                   tc.decode_time(C("o_custkey") * 977, "seconds since 1960-01-01").alias("t_seconds"))


@query("decode_split_time", """
    SELECT o_orderkey, make_timestamp(o_custkey * 86400000000 + (o_orderkey * 7919 % 86400000) * 1000 - 3506716800000000) AS t FROM orders""")
def decode_split_time(t):
    ms = C("o_orderkey") * 7919 % 86400000
    return t.base("orders").select("o_orderkey", tc.decode_split_time("o_custkey", ms, "days since 1858-11-17 00:00:00").alias("t"))


@query("round_time", """
    SELECT event_id, date_trunc('day', ts) + to_seconds(CAST(floor((s + 1800) / 3600) * 3600 AS BIGINT)) AS hour,
      date_trunc('day', ts) + to_seconds(CAST(floor((s + 3500) / 7000) * 7000 AS BIGINT)) AS odd
    FROM (SELECT event_id, ts, extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS s FROM events) q""")
def round_time(t):
    return t.base("events").select("event_id", tc.round_time("ts").alias("hour"), tc.round_time("ts", 7000).alias("odd"))


@query("find_time", """
    SELECT h.time AS ref, min(e.event_id) AS idx, arg_min(e.ts, e.event_id) AS ts
    FROM hours h JOIN events e ON e.ts > h.time - INTERVAL 60 SECOND AND e.ts < h.time + INTERVAL 60 SECOND GROUP BY 1""")
def find_time(t):
    refs = t.table("hours").withColumnRenamed("time", "ref")
    times = t.base("events").select(C("event_id").alias("idx"), "ts")
    return ops.find_time(times, refs, 60, time="ts", strict=False)


@query("match_dates", """
    WITH r AS (SELECT fix_id, date_trunc('day', time) + to_seconds(CAST(floor(((extract(hour FROM time) * 3600 + extract(minute FROM time) * 60
        + extract(second FROM time)) + 1800) / 3600) * 3600 AS BIGINT)) AS time FROM fixes)
    SELECT min(fix_id) AS fix_id, time FROM r WHERE time IN (SELECT time FROM frame_times) GROUP BY time""")
def match_dates(t):
    fixes = t.fixes.select("fix_id", tc.round_time("time").alias("time"))
    return ops.match_dates(fixes, t.frame_times, order="fix_id", strict=False)


@query("nearest_time", """
    SELECT fix_id, time FROM fixes WHERE time = (SELECT arg_min(time, struct_pack(g := abs(epoch_us(time) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), t := time)) FROM fixes)""")
def nearest_time(t):
    return ops.nearest_time(t.fixes.select("fix_id", "time"), "2024-01-15 12:00:00")


@query("elapsed_dates", """
    SELECT release, d AS delta_s, min(time) + to_seconds(CAST(d AS BIGINT)) AS time
    FROM fixes, (SELECT unnest([0.0::DOUBLE, 3600, 86400]) AS d) x GROUP BY release, d""")
def elapsed_dates(t):
    return ops.elapsed_dates(t.fixes, [0, 3600, 86400])


@query("frame_intervals", """
    SELECT t_last, t_next FROM (SELECT time AS t_last, lead(time) OVER (ORDER BY time) AS t_next FROM (SELECT DISTINCT date_trunc('minute', ts) AS time FROM events) d) q
    WHERE t_next IS NOT NULL""")
def frame_intervals(t):
    minutes = t.base("events").select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("time"))
    return ops.frame_intervals(minutes)


@query("asof_frames", """
    WITH iv AS (SELECT time AS a, lead(time) OVER (ORDER BY time) AS b FROM hours)
    SELECT f.fix_id, f.time, x.a AS t_last, x.b AS t_next, round(epoch(f.time - x.a) / epoch(x.b - x.a), 6) + 0.0 AS t_frac,
      y.a AS back_last, y.b AS back_next
    FROM fixes f LEFT JOIN iv x ON f.time >= x.a AND f.time < x.b LEFT JOIN iv y ON f.time > y.a AND f.time <= y.b""")
def asof_frames(t):
    fixes, hours = t.fixes.select("fix_id", "time"), t.table("hours")
    ahead = ops.asof_frames(fixes, hours, missing="null")
    back = ops.asof_frames(fixes, hours, -1, missing="null").select("fix_id", C("t_last").alias("back_last"), C("t_next").alias("back_next"))
    return ahead.join(back, "fix_id").select("fix_id", "time", "t_last", "t_next", rd("t_frac").alias("t_frac"), "back_last", "back_next")


@query("linear_fraction", "SELECT id, round((ax - bx) / nullif(cx - bx, 0), 6) + 0.0 AS f FROM pairs")
def linear_fraction(t):
    return t.table("pairs").select("id", rd(tc.linear_fraction("ax", "bx", "cx")).alias("f"))


@query("linear_fraction_safe", "SELECT id, round(ax / 10, 6) + 0.0 AS f FROM pairs")
def linear_fraction_safe(t):
    return t.table("pairs").select("id", rd(tc.linear_fraction_safe("ax", F.lit(0.0), F.lit(10.0))).alias("f"))


@query("lerp", "SELECT id, round(CASE WHEN bx = cx THEN bx ELSE (1 - ax / 10) * bx + ax / 10 * cx END, 6) + 0.0 AS v FROM pairs")
def lerp(t):
    return t.table("pairs").select("id", rd(tc.lerp(C("ax") / 10, "bx", "cx")).alias("v"))


@query("thin_output", """
    SELECT fix_id, time FROM fixes WHERE CAST(epoch(time) - (SELECT epoch(min(time)) FROM fixes) AS BIGINT) % 25 = 0""")
def thin_output(t):
    return ops.thin_output(t.fixes.select("fix_id", "time"), 25)


@query("release_schedule", """
    SELECT CAST(i AS INT) AS release, t0 + to_hours(CAST(12 * i AS BIGINT)) AS t_start, t0 + to_hours(CAST(12 * i AS BIGINT)) + INTERVAL 36 HOUR AS t_end
    FROM (SELECT min(time) AS t0 FROM fixes) m, range((SELECT count(DISTINCT particle_id) FROM fixes)) r(i)""")
def release_schedule(t):
    row = one_row(t.fixes.agg(F.min("time").alias("t0"), F.countDistinct("particle_id").alias("n")))
    return ops.release_schedule(t.spark, row["t0"], row["n"], 12, 1.5)


@query("expand_releases", """
    SELECT point_id, CAST(i AS INT) AS release, TIMESTAMP '2024-01-01' + to_hours(CAST(6 * i AS BIGINT)) AS t_start,
      TIMESTAMP '2024-01-01' + to_hours(CAST(6 * i AS BIGINT)) - INTERVAL 48 HOUR AS t_end FROM points, range(5) r(i)""")
def expand_releases(t):
    return ops.expand_releases(t.points.select("point_id"), "2024-01-01", 5, 6, 2, -1)


@query("check_step_alignment", """
    SELECT count(*) AS n_times, count(*) FILTER (WHERE r <> 0) AS n_misaligned, max(r) AS max_remainder_s
    FROM (SELECT CAST(CAST(epoch(time) - (SELECT epoch(min(time)) FROM fixes) AS BIGINT) % 7 AS DOUBLE) AS r FROM fixes) q""")
def check_step_alignment(t):
    return ops.check_step_alignment(t.fixes, 7, periods_s=(14, 70))


EDGES_SQL = """
    c AS (SELECT DISTINCT time FROM profiles),
    h AS (SELECT (epoch_us((SELECT min(time) FROM c WHERE time > (SELECT min(time) FROM c))) - epoch_us((SELECT min(time) FROM c))) / 2 AS half),
    edges AS (SELECT make_timestamp(CAST(epoch_us(time) - half AS BIGINT)) AS edge FROM c, h
      UNION ALL SELECT make_timestamp(CAST(epoch_us(max(time)) + max(half) AS BIGINT)) FROM c, h)"""


@query("cell_bounds", f"WITH {EDGES_SQL.strip()} SELECT edge FROM edges")
def cell_bounds(t):
    return ops.cell_bounds(t.table("profiles"), "time")


@query("level_bounds_at", f"""
    WITH {EDGES_SQL.strip()},
    held AS (SELECT edge, least(greatest(edge, (SELECT min(time) FROM c)), (SELECT max(time) FROM c)) AS t FROM edges),
    br AS (SELECT edge, t, (SELECT max(time) FROM c WHERE time <= t) AS a, (SELECT min(time) FROM c WHERE time >= t) AS b FROM held)
    SELECT edge, p.level, round(CASE WHEN a = b THEN p.z ELSE p.z + (q.z - p.z) * (epoch(t) - epoch(a)) / (epoch(b) - epoch(a)) END, 6) + 0.0 AS z
    FROM br JOIN profiles p ON p.time = a JOIN profiles q ON q.time = b AND q.level = p.level""")
def level_bounds_at(t):
    out = ops.level_bounds_at(t.table("profiles"))
    return out.select("edge", "level", rd("z").alias("z"))
