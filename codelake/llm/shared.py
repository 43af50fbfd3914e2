"""Lineage cuts of the corpus operators in the cluster's shared folder, and reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..lineage import delete, scratch, shared_dir
from ..sources.tables import read_table as table

__all__ = ["Spare", "cut", "delete", "drop", "own", "partitions", "scratch", "shared_dir", "table", "table_fs"]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads survive lost executors and redo no work."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codelake_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    delete(df.sparkSession, df._codelake_path)


class Spare:
    """Cuts of one operator, so that it can drop at its end what its result no longer reads."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(cut(df, name))
        return self.made[-1]

    def drop_but(self, *kept: DataFrame) -> None:
        """Drop the other cuts, and have the driver's JVM collect the plans behind them, so that their shuffle files go too."""
        spare = [df for df in self.made if all(df is not k for k in kept)]
        for df in spare:
            drop(df)
        if spare:
            spare[0].sparkSession.sparkContext._jvm.System.gc()
        self.made = [df for df in self.made if any(df is k for k in kept)]


def table_fs(path: str):
    """Arrow's view of a folder of the shared store, for Python on any machine: (file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own(df: DataFrame, *names: str) -> list[str]:
    """Free column names close to ``names``: an input column of the same name is left alone."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
