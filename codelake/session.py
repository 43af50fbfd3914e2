"""Session defaults shared by the CLI, the servers, the tests and the bench."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def get_spark(app: str = "codelake", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE on; ``cpus`` only matters where no master is configured."""
    n = cpus or int(os.environ.get("CODELAKE_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .master(os.environ.get("CODELAKE_MASTER", f"local[{n}]"))
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CODELAKE_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH")]))  # for Python workers, wherever this was started
    return spark
