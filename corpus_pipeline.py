"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last keep
the columns of ``documents``:

1. ``language``: documents go in which the learned languages together explain
   less than half of the words, and texts that are null or have no letter; where
   no language can be learned (no labelled row to learn from) every document
   stays,
2. ``quality``: documents that fail the base rule or the learned decision list
   go,
3. ``near_duplicates``: of every group of documents that link (five-word
   shingles, similarity 0.8) the one with the smallest id stays,
4. ``secrets``: secrets in the texts are replaced by their kind,
5. ``packing``: the texts are packed into sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, langmix, packing, quality, secrets
from tessera.operators.iterate import cut_to_table
from tessera.sources.tables import load


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langmix.filter_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_kept(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("quality", quality_rules), ("near_duplicates", near_duplicates),
          ("secrets", secret_scans), ("packing", pack)]

# Mixture inference, learned rules and BPE have no SQL form; the stages are
# tested against brute force and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_to_table(docs)
    return docs
