"""Intermediate tables on storage that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that this process has written and not deleted yet.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own; on any other master it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        own = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/quern-{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stash_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame and read it back: its rows and their partitions are fixed from here on, and lineage ends."""
    return stash_at(df, fresh_path(df.sparkSession, tag))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)


def release(spark: SparkSession) -> int:
    """Delete all intermediate tables that this process has written; for when the results that read them have been stored."""
    paths = list(_written)
    for path in paths:
        delete(spark, path)
    return len(paths)
