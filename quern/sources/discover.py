"""Discovery of Parquet files through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ensure_importable
from quern.sources.row_groups import failure, open_store


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in found] if found else []


def discover(spark: SparkSession, root: str, globs: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(source_split, file), each once, in order. A file that two splits match is an error."""
    found = {(split, path) for split, patterns in globs.items() for p in patterns for path in _glob(spark, f"{root.rstrip('/')}/{p}")}
    paths = sorted(p for _, p in found)
    twice = sorted({a for a, b in zip(paths, paths[1:]) if a == b})
    if twice:
        raise ValueError(f"files in more than one split: {twice[:3]}")
    return sorted(found)


def text_files(spark: SparkSession, roots: list[str]) -> list[str]:
    """Every .parquet file under the roots, or the roots themselves; an error if there is none."""
    found: set[str] = set()
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise FileNotFoundError(root)
        files = fs.listFiles(path, True)
        while files.hasNext():
            name = files.next().getPath().toString()
            if name.endswith(".parquet"):
                found.add(name)
    if not found:
        raise FileNotFoundError(f"no .parquet files under {roots}")
    return sorted(found)


def with_position(df: DataFrame) -> DataFrame:
    """File and row of every record, the order that input-order rules refer to."""
    return df.withColumns({"file_path": F.col("_metadata.file_path"), "row_index": F.col("_metadata.row_index")})


def canonical(path: Column) -> Column:
    """A path with its escapes read and one way of writing local ones: listings and readers spell them differently."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.regexp_replace(plain, "^file:/+", "/")


def _digests(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch["path"].to_pylist():
            size, digest, error = 0, hashlib.sha256(), None
            try:
                store, inner = open_store(path)
                with store.open_input_stream(inner, compression=None) as stream:
                    while data := stream.read(chunk):
                        digest.update(data)
                        size += len(data)
            except FileNotFoundError as e:  # any other failure is the task's, which is tried again
                error = failure(e)
            row = [path, None if error else size, None if error else digest.hexdigest(), error]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["path", "length", "sha256", "error"])


def file_digests(spark: SparkSession, paths: list[str], chunk: int = 1 << 20) -> DataFrame:
    """(path, length, sha256, error) of whole files of any size, read ``chunk`` bytes at a time, a file to a task. A missing file is a row with ``error``."""
    ensure_importable(spark)
    listed = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i long, path string")
    dealt = listed.repartitionByRange(max(1, len(paths)), "i").select("path")
    return dealt.mapInArrow(partial(_digests, chunk=chunk), "path string, length long, sha256 string, error string")
