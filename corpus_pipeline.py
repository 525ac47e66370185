"""Corpus pipeline: good documents, without boilerplate, copies and benchmark text, packed into bins.

Every stage takes (spark, docs, sf_dir) and works on all documents its
predecessor kept; the result is stored as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from terrafold.session import materialize, use_local_folder

#: Near duplicates: shared runs of five words, similarity of 80 percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Lines of so many words go from the second document on, other templates from the third.
LONG_LINE_WORDS = 50


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates, which stay in the first document that has them.

    Long lines of two documents go in the next stage, which needs them to find whole copies.
    """
    return line_dedup.clean_lines(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates, without long lines of an earlier one of them."""
    kept = materialize(jaccard_join.one_per_component(docs, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT), "one-per-component")
    return line_dedup.clean_lines(kept, long_words=LONG_LINE_WORDS, only_long=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document."""
    return packing.pack(docs)


def _with_folder(stage):
    """The stage, for sessions that may lack a folder for intermediate tables."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        use_local_folder(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _with_folder(good_documents)),
    ("line dedup", _with_folder(without_boilerplate)),
    ("n-gram Jaccard join", _with_folder(without_copies)),
    ("benchmark decontamination", _with_folder(without_benchmark)),
    ("best-fit packing", _with_folder(packed)),
]

#: The classifier is a fitted model and packing an iterative search, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    use_local_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
