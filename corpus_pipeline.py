"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, tokens. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm import bpe
from codelake.llm.line_dedup import without_repeated_lines
from codelake.llm.minhash import drop_near_duplicates
from codelake.llm.mixing import mix_sources
from codelake.llm.queries import vocabulary
from codelake.llm.shared import cut, table
from codelake.llm.toxicity import fit, training_rows, without_toxic

ORACLE_SQL = None
"""Scores, sketches and token ids have no SQL form: the stages are tested against brute force."""


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below a score of 0.7 stay. The model learns from the labelled documents of the table."""
    model = fit(training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(False)))
    return without_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; so do documents of which nothing is left."""
    return without_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: documents are left out, kept, or repeated up to three times."""
    return mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the text decoded from them."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"), keep_ids=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
