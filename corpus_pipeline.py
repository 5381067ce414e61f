"""Corpus pipeline: language, toxicity, near duplicates, benchmark leaks, mixing of sources.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept;
each result is written as Parquet and read again as the next stage's documents. All stages but
the last return the columns of ``documents``. The last returns the documents that the mix takes,
with their texts and how often each is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontamination, language_crf, ngram_join, source_mix, toxicity
from tidewatch.llm.common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def main_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents without letters or without one main language go."""
    return language_crf.accepted(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents judged toxic go."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of every class of near duplicates one document stays."""
    return ngram_join.one_of_each(docs, n=5, threshold=0.8)


def no_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the documents that the mix takes, sources weighing 5, 2, 1 in turn, with how often it takes them (``copies``)."""
    return source_mix.take(docs, weights=(5, 2, 1), most=3)


STAGES = [
    ("language", main_language), ("toxicity", not_toxic), ("near_duplicates", no_near_duplicates),
    ("decontamination", no_benchmark_leaks), ("mix", mixed),
]

#: SQL cannot express the model-based and near-duplicate stages; tests check each stage by plain means.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: the stages in order on ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
