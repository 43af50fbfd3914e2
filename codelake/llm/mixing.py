"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import prefix_sums
from .shared import cut, own

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) -> plus ``rank``, ``target``: water-filling of the sum of sizes under caps of ``most`` times each size.

    Sources take ``weights`` in turn, by code point with null last. One row per source throughout; the windows below
    run over that aggregate. The water level is that of the first source, by cap over weight, which stays under its cap.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumns({"weight": w.cast("long"), "cap": F.col("source_size") * most})
    by_fill = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    before, every = by_fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    filled = ranked.withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    open_ = F.col("left") * F.col("weight") <= F.col("cap") * F.col("left_weight")
    level = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("rank"), (F.col("left") / F.col("left_weight")).alias("level")))).over(every)["level"]
    return filled.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "source_size", "rank", "target")


def mixing_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """One row per input row: id, ``source``, ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken``.

    Each document, in the order of a seeded MD5 of its id, gets a virtual finish time in each pass over its source:
    cumulative source words over the source's target. Passes beyond the target are not made, so at most ``most`` copies
    exist. Copies are sorted over all sources by that time, less half the copy's own share of it so that a long document
    at the end of a source errs to either side alike, and cut where their words would exceed the sum of all sizes.
    Null texts and empty texts have size 0 and take 0 words; a null source is a source. Repeated rows count one by one.
    """
    rows = cut(
        df.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)).cast("binary")).alias("key"),
        ),
        "mix-sizes",
    )
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    known = rows.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    queued = cut(prefix_sums(known, [F.col("key"), F.col("id")], "size", "rank").withColumnRenamed("row_before", "row"), "mix-queue")
    passes = F.coalesce(F.ceil(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(1))
    finish = (F.col("pass") * F.col("source_size") + F.col("sum_before") + F.col("size") / 2) / F.nullif(F.col("target"), F.lit(0.0))
    copies = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(passes.cast("int"), F.lit(1)) - 1))).select(
        "size", "rank", "row", "pass", F.coalesce(finish, F.lit(0.0)).alias("finish")
    )
    merged = prefix_sums(copies, [F.col(c) for c in ("finish", "rank", "pass", "row")], "size").drop("row_before")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    took = (
        merged.crossJoin(F.broadcast(total))  # one row
        .filter(F.col("sum_before") + F.col("size") <= F.col("total"))
        .groupBy("rank", "row").agg(F.count(F.lit(1)).alias("copies"))
    )
    copies_of = F.coalesce(F.col("copies"), F.lit(0))
    return queued.join(took, ["rank", "row"], "left").select(
        F.col("id").alias(id_col), F.col("source").alias("source"), "size", "source_size", "target", copies_of.alias("copies"), (copies_of * F.col("size")).alias("taken")
    )


def mix_sources(df: DataFrame, id_col: str = "doc_id", **plan) -> DataFrame:
    """The mixed corpus: each row of ``df`` as often as the plan takes it, same columns. Rows that share an id are taken alike.

    Documents without words have no cost and stay once.
    """
    n, mix_id = own(df, "mix_copies", "mix_id")
    plan_rows = mixing_plan(df, id_col, **plan).filter("size > 0").groupBy(F.col(id_col).alias(mix_id)).agg(F.max("copies").alias(n)).filter(F.col(n) > 0)
    words = F.coalesce(F.regexp_count(F.col(plan.get("text_col", "text")), F.lit(WORD)), F.lit(0))
    joined = df.join(plan_rows, F.col(id_col).eqNullSafe(F.col(mix_id)), "left").withColumn(n, F.when(words == 0, 1).otherwise(F.coalesce(n, F.lit(0))).cast("int")).filter(F.col(n) > 0)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(F.col(f"`{c}`") for c in df.columns))
