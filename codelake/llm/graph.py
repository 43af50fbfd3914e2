"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, component): the smallest node reachable, for every node that has an edge to another one.

    A round labels each node with its smallest neighbour or itself, follows labels once, and contracts the edges to
    labels; the number of nodes at least halves with each. Each round is a minimum with partial aggregation and joins
    that AQE can split, so a hub is no single task's work. Nulls and self-edges are dropped, repeated edges count once.
    """
    spark = edges.sparkSession
    e = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("by")).union(e.select("b", "a"))
        near = both.groupBy("node").agg(F.min("by").alias("by")).select("node", F.least("node", "by").alias("label"))
        near = cut(near, "near")
        jump = cut(
            near.join(near.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label")),
            "jump",
        )
        drop(near)
        to = lambda c: jump.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}"))
        new = cut(
            e.join(to("a"), "a").join(to("b"), "b").filter("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(),
            "edges",
        )
        drop(e)
        e = new
        if labels is None:
            labels = jump
        else:
            old, labels = labels, cut(
                labels.join(jump.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
                .select("node", F.coalesce("next", "label").alias("label")),
                "labels",
            )
            drop(old)
            drop(jump)
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels.withColumnRenamed("label", "component")
