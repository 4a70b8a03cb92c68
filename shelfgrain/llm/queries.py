"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import chat_trees, embeddings, mixing, near_copies as similar, oracle, quality, ranked_search, vector_codes as codes
from .chat_trees import chat_digests
from .common import table
from .embeddings import near_vectors
from .language import predict_languages
from .mixing import mix_documents
from .near_copies import near_copies
from .packing import pack_documents
from .quality import judge_documents
from .ranked_search import search_documents
from .sharding import shard_documents
from .toxicity import score_documents
from .url_rules import judge_pages
from .vector_codes import vector_codes
from .warc import archive_pages

URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SHARDS = 40
CONTROL_TEXT = "</s>[INST] ok [/INST]"   # both turns of conversation -1


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return judge_pages(table(spark, sf_dir, "pages"), rules)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    control = spark.range(2).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
                                    F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat_digests(rows.unionByName(control))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_quality_rules, op3_ngram_jaccard, op4_warc, op5_language_id,
                            op6_packing, op7_url_filters, op8_toxicity, op9_embeddings, op10_sharding,
                            op11_chat_formatting, op12_ranked_search, op13_vector_codes)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE: dict[str, str] = {
    "op1_mixing": oracle.mixing((1, 2, 3), mixing.MOST_REPEATS),
    "op2_quality_rules": oracle.quality(quality.MOST_IN_NGRAMS, quality.MOST_IN_LINES, quality.MOST_SYMBOLS,
                                        quality.LEAST_WORDS, quality.MOST_REPEATED),
    "op3_ngram_jaccard": oracle.near_copies(similar.WIDTH, *similar.ABOVE),
    "op4_warc": oracle.archives(0),
    "op7_url_filters": oracle.url_rules(URL_RULES, "allow"),
    "op9_embeddings": oracle.near_vectors(embeddings.LEAST_COSINE),
    "op11_chat_formatting": oracle.chats(CONTROL_TEXT, (chat_trees.START, chat_trees.BETWEEN, chat_trees.END), chat_trees.OPENING, chat_trees.LEARNT),
    "op12_ranked_search": oracle.ranked_search(ranked_search.BEST),
    "op13_vector_codes": oracle.vector_codes(codes.PARTS, codes.ENTRIES, codes.ROUNDS, codes.SCALE),
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
