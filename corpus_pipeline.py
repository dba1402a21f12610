"""A corpus of documents made ready for training, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir) and decides over all rows that the stage before it kept; all but the last return the
columns of ``docs``. Missing values, empty and very long texts, repeated rows and empty tables are handled by the operators
as their docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docledger.llm import bpe, decontaminate, langid, quality, simhash
from docledger.llm.shared import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a language that the corpus itself teaches: those without letters or of unknown words go."""
    return langid.known_languages(docs, langid.train(langid.training_rows(docs)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, learned from the labels of these documents, scores at one half or more."""
    return quality.good_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than one word in twenty stands in a window of the benchmark."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document encoded, and decoded again: its number of tokens and both digests."""
    return bpe.round_trip(docs, bpe.vocabulary_path())


STAGES = [
    ("language", language),
    ("quality", good),
    ("near_copies", different),
    ("benchmark", uncontaminated),
    ("bpe", tokens),
]

# SQL has neither the models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows go through the folder that all executors share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
