"""Lineage cuts: tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only one machine can do without: a local master gets a temporary folder, any other an error."""
    at = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{KEY} must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="codelake-")
        spark.conf.set(KEY, at)
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store; missing ones are fine."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    """Remove this process's folders; the session may be gone by then."""
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed at interpreter exit."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written and read back, so that rounds of a loop do not grow one plan."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
