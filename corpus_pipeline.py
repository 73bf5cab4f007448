"""A training-data pipeline over ``documents``, as stages that each call one operator.

Every stage takes all documents that the one before kept, and its output is written as
Parquet and read again, so each starts from files in the shared folder; the tables that it took on
the way are deleted.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import digests, jaccard, langid, mix, pieces
from loomspark.llm._shared import stored
from loomspark.llm.queries import piece_model


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language: null texts, texts without letters, and texts of which
    no language has half."""
    return langid.drop_unidentified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal but for white space."""
    return digests.one_of_each_text(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at 0.8 or more."""
    return jaccard.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents so often that its words come to its target."""
    return mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256`` of every document of the mix."""
    return pieces.encode_documents(docs, piece_model()).select("doc_id", "n_tokens", "ids", "ids_sha256")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: Stages learn models, hash and sample: the query is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(partial(stage, spark, docs, sf_dir), spark, name)
    return docs
