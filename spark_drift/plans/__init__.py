"""Named queries over the given tables, one per operator."""

from spark_drift.plans.registry import QUERIES, oracles
from spark_drift.plans import q_analytics, q_geo, q_locate, q_mesh, q_rules, q_sample, q_sources, q_streaming, q_time, q_zones

__all__ = ["QUERIES", "oracles"]
