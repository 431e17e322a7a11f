"""Registry of named queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spark_drift.plans.tables import Tables, oracle_text

# comparison SQL as written; ``oracles`` adds the derived tables it uses
ORACLES: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def oracles() -> dict[str, str]:
    return {name: oracle_text(text) for name, text in ORACLES.items()}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables)``; ``oracle`` is SQL over the given and derived tables."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def rd(c, places: int = 6):
    """Rounded double without a negative zero, for comparison between engines."""
    from pyspark.sql import Column
    from pyspark.sql import functions as F

    return F.round(c if isinstance(c, Column) else F.col(c), places) + F.lit(0.0)
