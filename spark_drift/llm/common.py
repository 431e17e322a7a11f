"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spark_drift.util import ensure_checkpoint_dir

#: Rows handled at a time, so that a batch of very long texts stays small: as Python objects, and as Arrow arrays.
ROWS_AT_ONCE, ARROW_ROWS = 256, 1024
#: Most rows of an Arrow batch between Spark and a Python worker; whole texts are long.
BATCH_ROWS = 2000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of ``spark.checkpoint.dir`` (a session without one gets its own)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps neither repeat its work
    nor depend on the executors that did it."""
    folder = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def append_columns(df: DataFrame, text: str, keep: Sequence[str], fields: Sequence[T.StructField], make: Callable, arrow: bool = False) -> DataFrame:
    """The columns ``keep`` of ``df`` and new ``fields`` made from the column ``text``, in the order of the rows.

    ``make()`` runs once per task and returns a function from a list of texts (nulls included; with
    ``arrow`` an Arrow array) to one list or array of values per field. A kept column that has a new
    field's name gives way to it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    new = {f.name for f in fields}
    kept = [c for c in dict.fromkeys(keep) if c not in new]
    schema = T.StructType([*[df.schema[c] for c in kept], *fields])
    types = [f.type for f in to_arrow_schema(T.StructType(list(fields)))]
    source = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])
    step = ARROW_ROWS if arrow else ROWS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for low in range(0, whole.num_rows, step):
                part = whole.slice(low, step)
                made = work(part.column(at) if arrow else part.column(at).to_pylist())
                made = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], *made], [*kept, *[f.name for f in fields]])

    return source.mapInArrow(run, schema)


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at each space (a null as an empty text): the distinct words, each word's number
    among them, and where the words of each text start (with the end of the last)."""
    cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
    words = cut.flatten().dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()


def gathered(values: Sequence[bytes], number: np.ndarray, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The packed arrays ``values[number[0]]``, ``values[number[1]]``, … one after another, and where
    each ends."""
    size = np.fromiter(map(len, values), np.int64, len(values)) // width.itemsize
    flat, first = np.frombuffer(b"".join(values), width), np.cumsum(size) - size
    length = size[number]
    ends = np.cumsum(length)
    source = np.repeat(first[number] - ends + length, length)
    source += np.arange(len(source))
    return flat[source], ends


class WordCache(dict):
    """Results by word, kept until ``most`` words are held; later words are worked out anew.

    Frequent words come early, so they are the ones that stay."""

    def __init__(self, work: Callable[[str], object], most: int = 200_000):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, word: str):
        value = self.work(word)
        if len(self) < self.most and len(word) <= 64:
            self[word] = value
        return value
