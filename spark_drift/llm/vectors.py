"""Vectors as packed columns, and sorted streams of groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """True for vectors that are not null, empty or zero and hold no null or non-finite component."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def dimension_of(rows: DataFrame, embedding: str = "embedding") -> int | None:
    """The most frequent length of the vectors (the larger of equals); None without rows."""
    top = rows.groupBy(F.size(embedding).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else None


def packed(batch: pa.RecordBatch, name: str, dtype: np.dtype, width: int) -> np.ndarray:
    """A binary column of equal-length rows as an array of ``width`` columns."""
    column = batch.column(name) if isinstance(batch, pa.Table) else batch.column(batch.schema.get_field_index(name))
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def by_group(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of sorted batches that lie in one group each, with whether the slice opens its group."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        values = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        for low, high in zip(starts, [*starts[1:], b.num_rows]):
            key = tuple(v[low] for v in values)
            yield key != last, b.slice(low, high - low)
            last = key


def map_vectors(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema) -> DataFrame:
    """mapInArrow with a function from a batch to columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = fn(b)
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()], list(made))

    return df.mapInArrow(run, schema)
