"""A training corpus from documents: filtered, deduplicated twice, mixed and packed.

Each stage takes (spark, docs, sf_dir). Its result is written to the shared
folder and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opinionspark.llm.common import stored, table, tokenizer_path
from opinionspark.llm.minhash import one_of_each_class
from opinionspark.llm.mixing import mixed_documents
from opinionspark.llm.packing import pack_documents
from opinionspark.llm.quality import accepted
from opinionspark.llm.suffixes import kept_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each_class(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that earlier ones have."""
    return kept_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of their sources' weights, some repeated, some left out."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("minhash_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("source_mixing", source_mix),
    ("best_fit_packing", packed),
]

#: The classifier is trained, so SQL cannot tell the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
