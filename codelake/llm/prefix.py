"""Global prefix sums without a global window: range partitions, per-partition totals, sums of totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, own, partitions


def prefix_sums(df: DataFrame, order: list[Column], value: str, group: str | None = None) -> DataFrame:
    """``df`` plus ``row_before`` (rows before this one) and ``sum_before`` (their sum of ``value``), in ``order`` within ``group``.

    Rows are dealt by range over (group, order), so a group that holds a third of all rows spreads over many tasks.
    The dealt rows are written once: partition ids are then data, equal for every later reader and after lost executors.
    Totals are one row for each partition and group in it. ``order`` should be unique for repeatable results; rows that
    tie in all of it are interchangeable. Nulls sort first in ``order`` unless it says otherwise; an empty input gives none.
    """
    keys = [F.col(group).asc_nulls_last()] if group else []
    part, = own(df, "part_id")
    by = [part, group] if group else [part]
    dealt = cut(df.repartitionByRange(partitions(df.sparkSession), *keys, *order).withColumn(part, F.spark_partition_id()), "prefix")
    totals = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_in"), F.sum(value).alias("sum_in"))
    upto = (W.partitionBy(group) if group else W.partitionBy(F.lit(0))).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*(F.col(c).alias(f"{c}_t") for c in by), F.coalesce(F.sum("rows_in").over(upto), F.lit(0)).alias("rows_base"), F.coalesce(F.sum("sum_in").over(upto), F.lit(0)).alias("sum_base"))
    inside = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = dealt.withColumns({"rows_local": F.count(F.lit(1)).over(inside), "sum_local": F.coalesce(F.sum(value).over(inside), F.lit(0))})
    return (
        local.join(totals, [F.col(c).eqNullSafe(F.col(f"{c}_t")) for c in by])
        .withColumn("row_before", F.col("rows_base") + F.col("rows_local"))
        .withColumn("sum_before", F.col("sum_base") + F.col("sum_local"))
        .drop(part, "rows_local", "sum_local", "rows_base", "sum_base", *(f"{c}_t" for c in by))
    )
