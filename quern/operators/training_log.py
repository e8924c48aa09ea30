"""Aggregates of metric logs: weighted losses, windows between log points, running bests, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranges import prefix_scan


def weighted_mean_loss(df: DataFrame, loss: str, tokens: str, order: list[str], batches: int) -> DataFrame:
    """Token-weighted mean over the first batches."""
    return df.orderBy(*order).limit(batches).agg(
        (F.sum(F.col(loss) * F.col(tokens)) / F.greatest(F.sum(tokens), F.lit(1))).alias("loss"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens")
    )


def log_windows(df: DataFrame, step: str, every: int, loss: str, tokens: str, keys: tuple[str, ...] = (), seconds: str | None = None, waits: tuple[str, ...] = ()) -> DataFrame:
    """Sums that are reset at each log point: windows of ``every`` steps from step 1 on, apart for each of ``keys``.

    With ``seconds`` (wall time of a row) also ``tokens_per_second``, and for each column of ``waits``, seconds spent on
    something, its share of the wall time as ``<column>_fraction``.
    """
    wall = F.greatest(F.sum(seconds), F.lit(1e-9)) if seconds else None
    timed = [(F.sum(tokens) / wall).alias("tokens_per_second"), *[(F.sum(w) / wall).alias(f"{w}_fraction") for w in waits]] if seconds else []
    return df.groupBy(*keys, F.expr(f"({step} - 1) div {every}").alias("window")).agg(
        F.max(step).alias("last_step"), (F.sum(F.col(loss) * F.col(tokens)) / F.greatest(F.sum(tokens), F.lit(1))).alias("token_loss"),
        F.avg(loss).alias("microbatch_loss"), F.sum(tokens).cast("long").alias("tokens"), F.count(F.lit(1)).alias("microbatches"), *timed,
    )


def best_so_far(df: DataFrame, step: str, metric: str, run: str, mode: str = "min") -> DataFrame:
    """Best value before each step of a run, and whether the step strictly improves on it. A run may fill any number of tasks."""
    found = prefix_scan(df, metric, [step], "best_before", mode, [run])
    better = F.col(metric) < F.col("best_before") if mode == "min" else F.col(metric) > F.col("best_before")
    return found.withColumn("improved", F.col("best_before").isNull() | better)


def generation_rates(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("generated_tokens").alias("mean_generated_tokens"), F.avg(F.col("hit_max_new_tokens").cast("int")).alias("limit_rate"))


def latest_checkpoint(listing: DataFrame) -> str | None:
    """Path of the complete checkpoint with the highest step, else of the one named best. listing: path, name, complete."""
    step = F.regexp_extract("name", r"(\d+)$", 1).try_cast("long")
    row = listing.where("complete").agg(F.max_by("path", step).alias("newest"), F.max(F.when(F.col("name") == "best", F.col("path"))).alias("best")).first()
    return row["newest"] or row["best"]


def superseded_checkpoints(listing: DataFrame, keep: int) -> DataFrame:
    """Numbered checkpoints beyond the newest ``keep``; a listing of one run is small."""
    step = F.regexp_extract("name", r"(\d+)$", 1).try_cast("long")
    return listing.withColumn("step", step).where("step is not null").withColumn("n", F.row_number().over(Window.orderBy(F.desc("step")))).where(F.col("n") > keep).select("path")
