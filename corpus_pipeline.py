"""Corpus pipeline: language ID, quality rules, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common, jaccard, langid, linedup, packing, quality


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose cross-entropy is beyond the calibrated limit, go."""
    common.text_batches(spark)
    return langid.keep_documents(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie outside their group's robust distance go."""
    common.text_batches(spark)
    return quality.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines near to an earlier one go, and with them documents that lose every line; n_chars follows the text."""
    common.text_batches(spark)
    return linedup.dedup_lines(docs, drop_empty=True).withColumn("n_chars", F.length("text").cast("bigint"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, of rows that repeat it one.

    Rows that share an id are told apart by their sets: a row stays if its id and set are its group's representative's.
    """
    common.text_batches(spark)
    return jaccard.keep_representatives(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    common.text_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: Kneser-Ney models, determinant estimates and packing have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written and read again."""
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        mark = common.written()
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.saved(docs)
            common.clear_saved(spark, since=mark - (k > 0), keep=1)  # what the stage read and wrote on its way
            common.release(spark)
    return docs
