"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Each stage works on all that the one before kept, and its decisions take effect; all but the last return the columns
of documents. The stages cut no lineage but by written tables in the shared folder, so a lost executor costs its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import dedup, jaccard, langid, mixing, packing
from tideline.session import durable, tune

#: A text stays if some learned language contains this share of its n-grams.
LEAST_KNOWN = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null, without a letter, or in no language learned from ``docs`` go."""
    tune(spark)
    return langid.recognised(docs, langid.fit(docs), LEAST_KNOWN)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z the row with the largest doc_id stays."""
    tune(spark)
    return dedup.drop_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, the one with the smallest doc_id."""
    tune(spark)
    return jaccard.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once, or repeated."""
    tune(spark)
    return mixing.mixed_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where each document's tokens lie in which sequence."""
    tune(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
#: SQL has neither n-gram filters nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
