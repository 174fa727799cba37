"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each by one operator.

Defined cases are those of the operators; corpus_pipeline.py sums them up. All take nulls in any column, empty and very long
texts, ties, repeated rows, empty tables and further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import mixing, packing, secrets, simhash
from rankloom.llm import toxicity as tox
from rankloom.llm.common import table
from rankloom.llm.tokens import vocabulary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon (learned from labels of documents in docs) rejects go; the others stay as they are."""
    return tox.without_toxic(docs, tox.learned(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id: SimHash fingerprints that BK-trees link within 2 bits."""
    return simhash.without_linked(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark, and n_chars follows; no document goes."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mixture's shares of all their tokens; one that two epochs take is there twice."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, in sequences of 2,048."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=True, added="ids")
