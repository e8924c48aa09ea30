"""Manifests as JSON lines, id lists, YAML configuration."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import WS
from quern.operators.contracts import check, manifest_violations
from quern.schema import MANIFEST, bind_manifest
from quern.session import ensure_importable
from quern.sources.row_groups import open_store


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 1, for files of any size.

    A reader's split starts at some byte of its file and its lines come in order, so a line's number is its place in the split and the lines of
    the splits of the file before it: a count for each split is all that is summed up.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), "value", F.monotonically_increasing_id().alias("__id"),
    )
    splits = lines.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    found = lines.join(F.broadcast(splits), ["file", "__block"])  # a row for each split that a task reads
    return found.select("file", (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Typed rows of JSON-lines files. Blank lines are skipped. Strict: a bad line is an error that names its file and number; else such a row has
    the line in ``_corrupt_record``, and null in all else that can't be read."""
    kept = spark.read.schema(T.StructType([*schema, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)
    if not strict:
        return kept
    bad = _bad_lines(spark, path, schema).limit(3).collect()
    if bad:
        raise ValueError("Invalid JSON in " + ", ".join(f"{r['file']}:{r['line']}" for r in bad))
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line) of lines that don't hold an object of the schema, in order. Lines are numbered only if there is one."""
    whole = T.StructType([*schema, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE"})
    bad = lambda rows: rows.where(F.trim(F.regexp_replace("value", WS, " ")) != "").where(parsed["_corrupt_record"].isNotNull())
    if bad(spark.read.text(path)).isEmpty():
        return spark.createDataFrame([], "file string, line long")
    return bad(numbered_lines(spark, path)).select("file", "line").orderBy("file", "line")


def missing_sources(rows: DataFrame) -> DataFrame:
    """(rule, key) of source files that rows name and that don't exist; paths are looked up by tasks, each once."""
    paths = rows.select(F.col("parquet_path").alias("path")).where("path <> ''").distinct()
    found = paths.mapInArrow(_lookup, "path string, there boolean")
    return found.where("not there").select(F.lit("source missing").alias("rule"), F.col("path").alias("key"))


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        there = []
        for path in batch["path"].to_pylist():
            store, inner = open_store(path)
            there.append(store.get_file_info(inner).type != fs.FileType.NotFound)
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array(there, pa.bool_())], ["path", "there"])


def load_manifest(spark: SparkSession, path: str, split: str, audited: bool = False, base_wer: bool = False, sources: bool = True) -> DataFrame:
    """A split's manifest, refused if any row breaks its contract or there is none, or if ``sources`` and a file that a row points into is missing."""
    rows = bind_manifest(read_jsonl(spark, path, MANIFEST))
    check(manifest_violations(rows, split, audited, base_wer), f"manifest {path}")
    if rows.isEmpty():
        raise ValueError(f"manifest {path} is empty")
    if sources:
        ensure_importable(spark)
        check(missing_sources(rows), f"manifest {path}")
    return rows


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, id) of a file with one JSON string or object with ``id`` a line. Order is kept; bad, blank and repeated ids are errors that name the line."""
    lines = numbered_lines(spark, path).where("trim(value) <> ''").withColumnsRenamed({"line": "ordinal", "value": "line"})
    value = F.when(F.trim("line").startswith("{"), F.get_json_object("line", "$.id")).when(F.trim("line").rlike('^".*"$'), F.get_json_object(F.concat(F.lit('{"id":'), "line", F.lit("}")), "$.id"))
    ids = lines.select("ordinal", value.alias("id"))
    check(ids.where("id is null or trim(id) = ''").select(F.lit("id").alias("rule"), F.col("ordinal").cast("string").alias("key")), f"id list {path}")
    check(ids.groupBy("id").count().where("count > 1").select(F.lit("repeated").alias("rule"), F.col("id").alias("key")), f"id list {path}")
    return ids


def pick_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows named by an id list, in its order; an id that no row has is an error."""
    check(ids.join(rows.select(key), key, "left_anti").select(F.lit("unknown id").alias("rule"), F.col(key).cast("string").alias("key")), "id list")
    return ids.join(rows, key).orderBy("ordinal")


def load_yaml(path: str) -> dict[str, Any]:
    import yaml  # only here: the rest works without it

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold a mapping")
    return found
