"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and is written as Parquet before the next reads it.
All but the last return the columns of documents. sf_dir is only for stages that need further tables; none does.

Defined results: a null text, and one without letters, has no language and goes in the first stage; repeated rows are documents of their own until
exact dedup keeps one of each text, whatever their ids; ids that differing texts share are told apart by their texts; a null id loses to any other;
an empty table gives an empty result at each stage; further columns, whatever their names, are kept until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowgram.llm import exact_dedup, language_id, ngram_join, packing
from sparrowgram.llm.common import cut, table
from sparrowgram.llm.queries import vocabulary

#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that the classifier rejects go."""
    return language_id.keep_known(docs, language_id.learn(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the largest doc_id."""
    return exact_dedup.keep_largest(docs)


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least doc_id."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 1024, 2)


STAGES = [("language_id", identify), ("exact_dedup", deduplicate), ("ngram_join", join_similar), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
