"""A third of all rows on one key: the join is split, and the result stays whole."""

import pytest
from pyspark.sql import functions as F

from spark_drift.operators import rules
from spark_drift.util import skew_safe_join

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
}


@pytest.fixture
def shuffled(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, n=300_000):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000)
    return spark.range(0, n, 1, 8).select(F.col("id").alias("fix_id"), key.alias("particle_id"), F.xxhash64("id").alias("payload"))


def test_grouped_side_does_not_stop_the_split(shuffled):
    rows = hot(shuffled)
    grouped = rows.groupBy("particle_id").agg(F.count(F.lit(1)).alias("n"))
    out = skew_safe_join(rows, grouped, ["particle_id"]).agg(F.count(F.lit(1)).alias("rows"), F.max("payload"), F.max("n").alias("n"))
    r = out.collect()[0]
    assert r["rows"] == 300_000 and r["n"] > 100_000
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_ages_of_a_hot_particle(shuffled):
    rows = hot(shuffled).withColumn("time", F.timestamp_seconds("fix_id").cast("timestamp_ntz"))
    out = rules.particle_age(rows).agg(F.count(F.lit(1)).alias("rows"), F.max("age_s").alias("age"), F.max("payload"))
    r = out.collect()[0]
    assert r["rows"] == 300_000 and r["age"] == 299_997.0
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
