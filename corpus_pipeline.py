"""From raw documents to token ids: five stages, each one operator over all that the one before kept.

A stage gets (spark, docs, sf_dir) and returns documents (the last: digests of their ids); its result
is written as Parquet and read again as the next stage's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spark_drift.llm import mixing, piece_codec, quality, simhash, toxicity
from spark_drift.llm.common import scratch
from spark_drift.llm.queries import MERGE_MODEL
from spark_drift.llm.registry import table, tokenizer_file

#: Names of a classifier's columns while a stage filters by them.
_OUT = ("_held_out", "_score", "_predicted")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic. The model learns from the labels of the documents at hand."""
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), docs.columns, out=_OUT)
    return scored.where(F.col("_predicted") == 0).select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of quality."""
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), docs.columns, out=_OUT)
    return scored.where(F.col("_predicted") == 1).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the row of least id (rows without an id last), then
    of least hash. Rows are told apart by all their columns, so rows with one id and different texts are
    compared like any others; rows equal in every column are one document."""
    sign = F.lit(-(1 << 63))
    rank = F.when(F.col("doc_id").isNull(), "none").otherwise(F.lpad(F.hex(F.col("doc_id").bitwiseXOR(sign)), 16, "0"))
    rows = docs.withColumn("_row", F.concat(rank, F.lit("-"), F.hex(F.xxhash64(*docs.columns))))
    groups = simhash.near_duplicates(rows, key="_row")
    first = groups.where(F.col("_row") == F.col("component_id")).select("_row").distinct()
    same = Window.partitionBy("_row").orderBy("_row")
    stay = rows.join(first, "_row", "left_semi").withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") == 1)
    return stay.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    sized = docs.withColumn("_words", mixing.word_count(F.col("text")))
    mixed = mixing.mix(sized, size="_words", keep=docs.columns, sizes=sized.select("doc_id", "source", "_words"))
    return mixed.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round trip of each document, as digests."""
    return piece_codec.piece_digests(docs, tokenizer_file(MERGE_MODEL), ["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: The stages train models, iterate and tokenise: SQL expresses none of them whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
