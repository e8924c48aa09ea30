"""Greedy batches of bounded seconds and count inside buckets of consecutive rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.contracts import check, sampler_violations
from quern.operators.ranges import numbered
from quern.storage import stash


def greedy_batches(
    df: DataFrame, order: list[str], max_seconds: float, max_count: int, bucket_size: int = 256, key: str = "id", duration: str = "duration",
    seed: int | None = None,
) -> DataFrame:
    """(bucket, batch, place, key, duration): buckets of consecutive rows, each sorted by duration and cut greedily.

    A batch ends when the next row would pass a cap. With a seed the order is that of a keyed hash and half of the buckets run
    from long to short; CPython's shuffles can't be reproduced elsewhere. Rows of no or negative length, or longer than a
    batch, are errors. A bucket is at most ``bucket_size`` rows, folded in one expression.
    """
    if max_seconds <= 0 or max_count <= 0 or bucket_size <= 0:
        raise ValueError("caps and bucket size must be positive")
    # written out, so that durations are worked out once for the check and the batches
    rows = stash(df.select(key, duration, *[c for c in order if c not in (key, duration)]), "durations")
    check(sampler_violations(rows, key, duration, max_seconds), "batches")
    if seed is not None:
        rows, order = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))), ["__h", key]
    rows = numbered(rows, order, "ord").withColumn("bucket", F.expr(f"ord div {bucket_size}"))
    item = F.struct(F.col(duration).cast("double").alias("d"), F.col("ord"), F.col(key).alias("key"))
    sorted_ = F.array_sort(F.collect_list(item))
    if seed is not None:
        sorted_ = F.when(F.pmod(F.xxhash64(F.lit(seed), F.col("bucket")), F.lit(2)) == 0, F.reverse(sorted_)).otherwise(sorted_)
    buckets = rows.groupBy("bucket").agg(sorted_.alias("items"))
    kind = dict(rows.dtypes)[key]
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.array().cast(f"array<struct<batch:int,place:int,d:double,key:{kind}>>").alias("out"))

    def add(acc, x):
        full = (acc["n"] > 0) & ((acc["s"] + x["d"] > max_seconds) | (acc["n"] >= max_count))
        batch, n = F.when(full, acc["batch"] + 1).otherwise(acc["batch"]), F.when(full, 0).otherwise(acc["n"])
        one = F.struct(batch.alias("batch"), n.alias("place"), x["d"].alias("d"), x["key"].alias("key"))
        return F.struct(batch.alias("batch"), (n + 1).alias("n"), (F.when(full, 0.0).otherwise(acc["s"]) + x["d"]).alias("s"), F.concat(acc["out"], F.array(one)).alias("out"))

    placed = buckets.select("bucket", F.explode(F.aggregate("items", start, add, lambda a: a["out"])).alias("o"))
    return placed.select("bucket", F.col("o.batch").alias("batch"), F.col("o.place").alias("place"), F.col("o.key").alias(key), F.col("o.d").alias(duration))
