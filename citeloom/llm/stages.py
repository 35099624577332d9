"""Stages of the corpus pipeline; each calls one operator and, but for the last, returns the columns of documents.

Nulls, empty texts, repeated rows, empty tables and further columns are treated as corpus_pipeline states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm.mixing import with_copies
from citeloom.llm.packing import pack_documents
from citeloom.llm.quality import keep_quality
from citeloom.llm.registry import table, tokenizer_path
from citeloom.llm.simhash import keep_one
from citeloom.llm.toxicity import keep_ordinary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go."""
    return keep_ordinary(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it: not at all, once or twice."""
    return with_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what the stages before have kept; a document that the mix repeats is packed as often."""
    return pack_documents(docs, tokenizer_path())
