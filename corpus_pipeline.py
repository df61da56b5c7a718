"""A training corpus from documents: five stages, each a table that the next one reads.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents. SQL cannot express the classifier, so there is no ORACLE_SQL; tests
hold what each stage keeps of its own input against plain Python (the classifier's model against one of its own).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.llm import dedup, near_dups, packing, quality, substrings
from alertmill.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return dedup.without_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dups.without_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier too; n_chars follows. A text may end up empty: its row stays."""
    kept = substrings.without_repeated_passages(docs)
    kept = kept.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", *[F.col("rest")[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")])
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, mixed by source."""
    return packing.packed_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("substring", substring_stage),
    ("packing", packing_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
