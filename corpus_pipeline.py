"""A corpus from raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfgrain.llm.common import table
from shelfgrain.llm.mixing import mixed_documents
from shelfgrain.llm.near_copies import one_of_each
from shelfgrain.llm.packing import pack_documents
from shelfgrain.llm.quality import good_documents
from shelfgrain.llm.toxicity import clean_documents
from shelfgrain.session import stage

ORACLE_SQL = None  # training, tokenizer and hashes are beyond SQL; tests/llm holds the brute-force version


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return good_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not count as toxic; learnt from those at hand and their labels."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights: documents are left out or repeated."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences."""
    return pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity), ("near duplicates", near_duplicates),
          ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; every result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = stage(apply(spark, docs, sf_dir), f"stage-{k}-{name.replace(' ', '-')}")
    return docs
