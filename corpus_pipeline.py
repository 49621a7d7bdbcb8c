"""A training corpus from ``documents``: clean, unique, without secrets, packed.

``STAGES`` are applied in order; each result is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlint.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from fleetlint.llm.tables import table
from fleetlint.plans.storage import materialise


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), that with the smallest id."""
    return near_dedup.deduplicate(docs)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked in the texts; ``n_chars`` follows the text."""
    masked = secrets.redact(docs)
    if "n_chars" in masked.columns:
        masked = masked.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(masked.schema["n_chars"].dataType))
    return masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in training sequences."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("secrets", secret), ("packing", packed)]

#: A trained classifier has no SQL; ``tests/llm`` compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
