"""Labelled rows for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One of so many ids is held out of training.
FOLDS = 5


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by FOLDS; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """``key`` and y (0 or 1) of the rows to learn from. Null ids and labels play no part; an id with
    several labels counts once, as 1 if any of them is 1."""
    rows = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col(key).isNotNull() & F.col("y").isin(0, 1) & ~held_out(key))
    return rows.groupBy(key).agg(F.max("y").alias("y"))
