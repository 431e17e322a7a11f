"""Queries: streams of fixes, drained from the events table."""

from pyspark.sql import functions as F

from spark_drift.plans.registry import query, rd
from spark_drift.streaming import state
from spark_drift.streaming import streams as ops
from spark_drift.util import scratch_folder

C = F.col


@query("stream_sample", """
    SELECT h.fix_id, h.time, h.host, round(v.value, 6) + 0.0 AS value FROM fix_hosts h JOIN fix_levels v ON v.fix_id = h.fix_id AND v.variable = 'zeta'""")
def stream_sample(t):
    out = ops.stream_sample(t.stream_fixes(), t.fields("zeta"), t.frame_times, t.mesh, "zeta")
    return ops.run_to_parquet(out, scratch_folder(t.spark, "stream")).select("fix_id", "time", "host", rd("value").alias("value"))


@query("stream_status", """
    SELECT particle_id, CAST(epoch(max(time)) - epoch(min(time)) AS DOUBLE) AS age_s, sum(land_boundary_encounters)::BIGINT AS land_encounters,
      CAST(arg_max(is_beached, time) AS INT) AS is_beached, CAST(min(in_domain) AS INT) AS in_domain,
      CAST(epoch(max(time)) - epoch(min(time)) < 2500000 AS INT) AS is_alive, CAST(epoch(max(time)) - epoch(min(time)) >= 2400000 AS INT) AS settling
    FROM fixes GROUP BY particle_id""")
def stream_status(t):
    out = state.stream_status(t.stream_fixes(), 2500000, 2400000)
    return ops.run_to_parquet(out, scratch_folder(t.spark, "stream"), "update", ["particle_id"]).drop("t_first_us", "t_last_us")


@query("stream_counts", """
    SELECT date_trunc('hour', time) AS t_start, date_trunc('hour', time) + INTERVAL 1 HOUR AS t_end, count(*) AS n, sum(in_domain)::BIGINT AS n_in_domain,
      sum(is_beached)::BIGINT AS n_beached, sum(error_status)::BIGINT AS n_error FROM fixes GROUP BY 1, 2""")
def stream_counts(t):
    return ops.run_to_parquet(ops.stream_counts(t.stream_fixes()), scratch_folder(t.spark, "stream"), "update", ["t_start", "t_end"])


@query("stream_counts_sliding", """
    SELECT s AS t_start, s + INTERVAL 2 HOUR AS t_end, count(*) AS n, sum(in_domain)::BIGINT AS n_in_domain, sum(is_beached)::BIGINT AS n_beached, sum(error_status)::BIGINT AS n_error
    FROM (SELECT *, date_trunc('hour', time) - to_hours(CAST(k AS BIGINT)) AS s FROM fixes, range(2) r(k)) q GROUP BY 1, 2""")
def stream_counts_sliding(t):
    return ops.run_to_parquet(ops.stream_counts(t.stream_fixes(), "2 hours", slide="1 hour"), scratch_folder(t.spark, "stream"), "update", ["t_start", "t_end"])


@query("stream_counts_session", """
    WITH g AS (SELECT *, CASE WHEN time <= lag(time) OVER (PARTITION BY particle_id ORDER BY time, fix_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM fixes),
    s AS (SELECT *, sum(new) OVER (PARTITION BY particle_id ORDER BY time, fix_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT min(time) AS t_start, max(time) + INTERVAL 6 HOUR AS t_end, particle_id, count(*) AS n, sum(in_domain)::BIGINT AS n_in_domain,
      sum(is_beached)::BIGINT AS n_beached, sum(error_status)::BIGINT AS n_error FROM s GROUP BY particle_id, sid""")
def stream_counts_session(t):
    out = state.stream_sessions(t.stream_fixes(), 6 * 3600)
    rows = ops.run_to_parquet(out, scratch_folder(t.spark, "stream"), "update", batches=True)
    return state.newest_sessions(rows).drop("is_open", "batch")
