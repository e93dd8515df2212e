"""A training corpus from raw documents: each stage works on all rows that the one before it kept.

Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import mixing, packing, pii, quality, simhash
from scriptorium.llm.common import checkpoint


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep_good(docs, quality.CORPUS_RULES)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become token pieces with a place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("sequences", sequences),
]

#: SimHash, the transducers and the tokenizer have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


#: Stages whose successor reads their rows more than once: they are written to the shared folder, not computed again.
KEPT = ("quality_rules", "near_dedup", "personal_data")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, one after the other: a row for each piece of a document, with its place in a sequence.

    Null and blank texts go in the first stage, rows without doc_id stay where a stage needs ids; no documents, no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = checkpoint(docs) if name in KEPT else docs
    return docs
