"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language
from .embed_dedup import near_vectors
from .line_dedup import dedup_lines
from .media import payload_features, store_payloads
from .minhash import near_duplicates
from .mixing import mixing_plan
from .shared import scratch, table
from .sql import SQL
from .sharding import shard_by_bytes
from .toxicity import fit, fold, score_toxicity, training_rows

from .warc import read_warc, write_warc


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_features(store_payloads(table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(manifest, out, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents, fold("doc_id") == 1)
    found = language.identify(documents, model)
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(training_rows(documents, table(spark, sf_dir, "labels"), fold("l_id") == 1))
    scored = score_toxicity(documents, model)
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), "text")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_media, op3_warc, op4_embedding_dedup, op5_mixing, op6_bpe, op7_language_id, op8_toxicity, op9_line_dedup, op10_minhash)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
