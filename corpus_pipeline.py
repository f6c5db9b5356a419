"""Documents to packed batches of training data.

Each stage works on all rows its predecessor kept. Rows that the quality rules reject go, one
row of each class of near duplicates stays, personal data is replaced by its kind, sources
are mixed to their target weights (a row can appear up to three times), and what is left is
packed. All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveplan.llm import mixing, neardup, packing, pii, quality
from waveplan.llm.store import Run, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.learn(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifiers and the sampling have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each to what the one before wrote."""
    folder = Run(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = folder.keep(stage(spark, docs, sf_dir), f"stage{number}")
        if number:
            folder.drop(f"stage{number - 1}")
    return docs
