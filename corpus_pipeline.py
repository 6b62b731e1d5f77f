"""From raw documents to packed training sequences, one operator after the other.

Toxic documents go; passages that earlier documents have are cut; one document of each near-duplicate group stays;
live-looking secrets are masked; what is left is packed into sequences.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from typeflow.llm import jaccard, line_dedup, packing, secrets, toxicity
from typeflow.llm.catalog import vocabulary
from typeflow.llm.common import Intermediates, importable, saved, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Tables that the stage before made on its way: each stage's rows are stored before the next one begins.
_earlier = Intermediates()


def stage(function: Stage) -> Stage:
    """A stage that first removes what the one before left. Texts go to Python in small batches."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        small_batches(spark)
        _earlier.remove(spark)
        with _earlier:
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


@stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages, and drops documents of which nothing is left."""
    return line_dedup.deduplicated(docs)


@stage
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return jaccard.representatives(docs)


@stage
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets that look live."""
    return secrets.redacted(docs)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences: one row per piece, with its ids."""
    return packing.pack(docs, vocabulary(), ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: A trained classifier and tokenizers can't be put in SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = saved(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
