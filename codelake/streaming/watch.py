"""A stream of changed trees: each micro-batch analyses the roots that arrived and appends their findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.codegraph import scan
from ..report import union


def watch(roots: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """``roots(root string)`` -> Parquet of findings below ``out``, by root and batch. A batch that runs again overwrites its own part."""

    def each(batch: DataFrame, number: int) -> None:
        seen = [r.root for r in batch.select("root").distinct().toLocalIterator()]
        found = [scan(batch.sparkSession, r).findings.withColumn("root", F.lit(r)) for r in seen]
        if found:
            union(found).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return roots.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
