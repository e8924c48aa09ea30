"""What the training-data operators share: table reading, shared-storage stashes and word splitting."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.sieve import sieve
from quern.storage import delete, fresh_path, stash, stash_at

__all__ = ["delete", "fresh_path", "sieve", "stash", "stash_at"]
#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Most bytes of an Arrow batch.
BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """The rows as one struct ``d`` beside further columns, so that no name of the table can clash with ours."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("d"), *[c.alias(k) for k, c in more.items()])


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("d").getField(c).alias(c) for c in docs.columns])


def row_key(id_col: str, text_col: str) -> dict[str, Column]:
    """``k`` and ``k2``, 128 bits of a row's id and whole text: rows share them if they have both in common."""
    both = text_of(text_col), F.col(quoted(id_col))
    return {"k": F.xxhash64(*both), "k2": F.xxhash64(F.lit("k2"), *both)}


def without(docs: DataFrame, id_col: str, text_col: str, lost: DataFrame) -> DataFrame:
    """The rows but for those that ``lost`` (k, k2, stays) names by row_key(): where ``stays``, one of them stays.

    Only rows that pass the sieve are shuffled, to be compared with the list in full.
    """
    rows = sieve(packed(docs, **row_key(id_col, text_col)), "k", lost.select("k"))
    told = rows.where("maybe").join(lost, ["k", "k2"], "left")
    out = rows.where("not maybe").select("d").unionByName(told.where("stays is null").select("d"))
    if not lost.where("stays").isEmpty():
        out = out.unionByName(told.where("stays").dropDuplicates(["k", "k2"]).select("d"))
    return unpacked(out, docs)


def many(rows: DataFrame) -> DataFrame:
    """Rows that follow the corpus, for a join that must not broadcast them.

    Spark infers the size of rows made in tasks from the files that the tasks read: 33 grid points for each fingerprint
    count as one, and repeated values as the little that they take in a file. Below its limit of 10 MB for a broadcast it would send some
    hundred MB through the driver. Both sides are shuffled instead, and adaptive execution may still split hot keys.
    """
    return rows.hint("merge")


def _tidy(batches: Iterator[pa.RecordBatch], function: Callable) -> Iterator[pa.RecordBatch]:
    """Run a function over a task's batches and give its memory back afterwards: workers live on, idle, beside the JVM."""
    pool = pa.default_memory_pool()
    for made in function(batches):
        yield made
        pool.release_unused()
    gc.collect()
    pool.release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow by a function of this package, which workers find where the driver has it or on their own path.

    Where the session has Spark's default of 64 MB for an Arrow batch, it is lowered to BATCH: the JVM's buffers lie outside
    the heap, a few times the batch for every core. Both that setting and the workers' PYTHONPATH are changed in the caller's session and
    stay so.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == f"{64 << 20}b":
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    env, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return df.mapInArrow(partial(_tidy, function=function), schema)


def words(text: str | None) -> list[bytes]:
    """Maximal runs outside SPACES as UTF-8. bytes.split() cuts at exactly those six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()
