"""From raw documents to packed bins: language, exact copies, near copies, repeated passages, packing.

Every stage reads what its predecessor wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from argosift.llm import exact_dedup, language_id, near_copies, packing, substring_dedup
from argosift.session import cut

#: Classification, fingerprints and bin choices are not SQL.
ORACLE_SQL = None


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the classifier learns from the labelled ones among ``docs``."""
    return language_id.keep_known(docs, language_id.fit(language_id.training_rows(docs)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles with a likeness of at least 0.8.

    Groups of near SimHashes are checked exactly; a set-similarity join adds the links that fingerprints miss.
    """
    return near_copies.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that an earlier one has."""
    return substring_dedup.remove_repeats(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in bins of 2048 words."""
    return packing.pack(packing.measured(docs))


STAGES = [
    ("language_id", recognise_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
