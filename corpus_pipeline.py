"""Corpus pipeline: quality filter, toxicity filter, near-duplicate removal, source mixing, packing.

Each stage takes the documents that the one before has kept and returns them with the columns of documents; packing returns pieces.
Null and empty texts are documents like others: they are scored, and all of them but one go as near-duplicates. Null ids are kept, as rows of
their own. Repeated rows go but one, and come back as often as the mix takes the one that stays. An empty table gives an empty table at every
stage. Columns of any other name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import stages
from citeloom.session import Scratch

STAGES = [
    ("quality", stages.quality),
    ("toxicity", stages.toxicity),
    ("near_dedup", stages.near_dedup),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: Model training, fingerprints and iterations are beyond SQL; tests hold each stage against a plain version of what it decides.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is written and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        kept = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
