"""Row groups of Parquet files, read from footers by tasks, and addresses of rows in them."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ensure_importable

GROUPS = "path string, schema string, row_group int, first_row long, rows long, bytes long, error string"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path in it. Local paths may be plain or ``file:``."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def failure(error: Exception) -> str:
    """What rejected rows are counted by: the kind of error and the first part of its message."""
    return type(error).__name__ + ":" + str(error).split(":", 1)[0]


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch["path"].to_pylist():
            try:
                store, inner = open_store(path)
                with store.open_input_file(inner) as stream:
                    file = pq.ParquetFile(stream)
                    schema, first = file.schema_arrow.remove_metadata().to_string(), 0
                    for g in range(file.metadata.num_row_groups):
                        group = file.metadata.row_group(g)
                        rows.append((path, schema, g, first, group.num_rows, group.total_byte_size, None))
                        first += group.num_rows
                    if not file.metadata.num_row_groups:
                        rows.append((path, schema, None, 0, 0, 0, None))
            except (FileNotFoundError, pa.ArrowInvalid) as error:  # any other error fails the task, which is tried again
                rows.append((path, None, None, None, None, None, failure(error)))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in GROUPS.split(", ")])


def row_groups(spark: SparkSession, paths: list[str] | DataFrame, files_a_task: int = 64) -> DataFrame:
    """(path, schema, row_group, first_row, rows, bytes, error): a row for each row group, or one with null ``row_group`` for a file without any.

    Footers are read by tasks, ``files_a_task`` each. ``paths`` is a list or a table with column ``path``. A file that is missing or isn't Parquet
    is a row with ``error``; other failures of the store fail the task, which Spark repeats.
    """
    ensure_importable(spark)
    listed = spark.createDataFrame([(p,) for p in paths], "path string") if isinstance(paths, list) else paths.select("path")
    n = len(paths) if isinstance(paths, list) else listed.count()
    return listed.repartition(max(1, -(-n // files_a_task))).mapInArrow(_footers, GROUPS)


def locate(rows: DataFrame, groups: DataFrame, path: str = "parquet_path", row: str = "row_index") -> DataFrame:
    """Add ``row_group`` and ``row_in_group`` to rows addressed by file and row in it.

    The starts of a file's groups are one array, bounded by its groups; the join by file is left to Spark, which broadcasts that table while it is
    small. Rows of a file that ``groups`` lacks, or beyond its end, have nulls.
    """
    starts = groups.where("row_group is not null").groupBy(F.col("path").alias("__path")).agg(
        F.array_sort(F.collect_list("first_row")).alias("__starts"), F.sum("rows").alias("__rows")
    )
    found = rows.join(starts, F.col(path) == F.col("__path"), "left").drop("__path")
    group = F.size(F.filter("__starts", lambda s: s <= F.col(row))) - 1
    inside = F.col(row).between(0, F.col("__rows") - 1)
    found = found.withColumn("row_group", F.when(inside, group))
    start = F.get("__starts", F.col("row_group"))
    return found.withColumn("row_in_group", (F.col(row) - start).cast("int")).drop("__starts", "__rows")
