"""Sinks: JSON lines, one folder for each split, reports, metric logs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put what was staged in the place of ``path``.

    What was there is moved aside first and deleted last, so a failure in between loses nothing: it leaves the old folder
    under ``path`` or beside it. Readers may find none for the moment between the two renames.
    """
    fs, target = _fs(spark, path)
    source, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, f"{path}.old-{uuid.uuid4().hex}"))
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(source, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"can't move {staged} to {path}")
    if had:
        fs.delete(aside, True)


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write JSON lines with sorted keys to a staging folder, then move it into place; returns the row count."""
    spark, staged = df.sparkSession, f"{path}.staging-{uuid.uuid4().hex}"
    seen = Observation()
    df.select(*sorted(df.columns)).observe(seen, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", "false").json(staged)
    _swap(spark, staged, path)
    return seen.get["n"]


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each value of ``split``, so that a later read of one split lists only its files."""
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.partitionBy("split").option("ignoreNullFields", "false").json(staged)
    _swap(df.sparkSession, staged, path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small driver-side report as JSON, staged under a name of its own and put in place as write_jsonl() does."""
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    fs, source = _fs(spark, staged)
    out = fs.create(source, True)
    out.write(bytearray(json.dumps(report, ensure_ascii=False, sort_keys=True, indent=2, default=str).encode()))
    out.close()
    _swap(spark, staged, path)


def append_metrics(spark: SparkSession, step: int, phase: str, metrics: dict[str, float], path: str) -> None:
    row = spark.createDataFrame([(step, phase, {k: float(v) for k, v in metrics.items()})], "step long, phase string, metrics map<string,double>")
    row.coalesce(1).write.mode("append").json(path)


def write_evaluation(df: DataFrame, step: int, path: str) -> None:
    """The evaluation rows of one step, replacing those of an earlier run."""
    df.write.mode("overwrite").json(f"{path}/step={step}")


def as_json(df: DataFrame) -> DataFrame:
    """Whole rows as JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
