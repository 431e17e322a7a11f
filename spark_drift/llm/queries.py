"""One query per operator, over the whole of its table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_drift.llm import id_store, mixing, near_vectors, nearest, piece_codec, q_words, quality, simhash, token_counts, toxicity, url_filter  # noqa: F401
from spark_drift.llm.common import scratch, stored
from spark_drift.llm.registry import ORACLES, QUERIES, query, table, tokenizer_file

__all__ = ["ORACLES", "QUERIES"]

MERGE_MODEL, BYTE_MODEL, END_ID = "piece_bpe_32k.model", "byte_bpe_50k.json", 2


#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

URL_SQL = """
WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM parts)),
rules(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path,
       (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h) + length(p) DESC LIMIT 1) AS rule,
       coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h) + length(p) DESC LIMIT 1), 'allow') AS verdict
FROM cut
"""


@query("op1_url_filter", URL_SQL)
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES), keep=["page_id"])


@query("op2_mixing")
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = stored(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    return mixing.mix(sizes, keep=["doc_id", "source"])


@query("op3_pieces")
def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_codec.piece_digests(docs, tokenizer_file(MERGE_MODEL), ["doc_id"])


@query("op4_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])


@query("op5_token_counts")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, token_counts.unigram_model(tokenizer_file(MERGE_MODEL)), ["doc_id"])


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])


@query("op7_near_vectors")
def near_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_nearest")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


@query("op10_id_store")
def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "id_store")
    id_store.store_corpus(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_MODEL), folder, END_ID)
    return id_store.read_ids(spark, folder, id_store.CRC, id_store.crc_of)
