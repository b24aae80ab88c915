"""The corpus pipeline: toxicity, quality rules, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of ``documents``; the last returns the packed pieces.
Null texts count as empty: they aren't toxic, and fail the quality rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairwright.llm import near_dedup, packing, pii, quality, toxicity
from pairwright.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity stays below the threshold, learned from the labels."""
    return toxicity.harmless_documents(docs, toxicity.learned(spark, sf_dir, docs))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every quality rule."""
    return quality.kept_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.deduplicated(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data written as its kind."""
    return pii.redacted(docs, pii.fit_spans(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their sequences."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_copies),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

#: Compression, similarity and packing have no SQL; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
