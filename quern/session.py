"""Session defaults for local runs; a cluster brings its own session and these are never forced on it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "quern", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with as many shuffle partitions as cores. Keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(cpus if cpus != "*" else os.cpu_count()),
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, besides their own path."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
