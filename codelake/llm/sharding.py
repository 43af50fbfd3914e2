"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_sums
from .shared import cut

FIXED = ("id", "size", "text_crc32", "row_before", "sum_before", "shard", "slot")


def shard_by_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard`` and ``slot`` (place in the shard, from 0).

    Order: CRC-32 of the text, then its id, so equal texts are neighbours. ``size`` is the text's UTF-8 bytes plus 1
    (null text: 1). A shard is the stretch whose middles of rows fall in its equal part of the sum of sizes, so shards
    differ by less than one row's size at each cut. Null ids sort first. Repeated rows each get a slot. With fewer rows
    than shards some shards stay empty. No rows, no shards.
    """
    blob = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = df.select(F.col(id_col).alias("id"), (F.octet_length(blob) + 1).cast("long").alias("size"), F.crc32(blob).alias("text_crc32"))
    run = prefix_sums(base, [F.col("text_crc32"), F.col("id")], "size")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    placed = cut(
        run.crossJoin(F.broadcast(total))  # one row
        .withColumn("shard", F.expr(f"(({shards} * (2 * sum_before + size)) div (2 * total))").cast("int")),
        "shards",
    )
    first = placed.groupBy("shard").agg(F.min("row_before").alias("first_row"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row_before") - F.col("first_row")).alias("slot")
    )
