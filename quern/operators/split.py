"""Split assignment and removal of leakage between splits, with counts by reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X


def assign(
    df: DataFrame, validation_fraction: float = 0.01, test_fraction: float = 0.01, seed: int = 42,
    official_only: dict[str, bool] | None = None, bucket: Callable[[Column], Column] = X.stable_bucket,
) -> DataFrame:
    """Set ``split``: official labels first, then the bucket of seed, dataset and group (speaker, else fingerprint).

    ``official_only`` names datasets whose other rows all train. ``bucket`` maps text to 0..9999; X.sha_bucket stays in the JVM.
    """
    if min(validation_fraction, test_fraction) < 0 or validation_fraction + test_fraction >= 1:
        raise ValueError("fractions must not be negative and sum to less than one")
    low = int(validation_fraction * 10_000)
    high = low + int(test_fraction * 10_000)
    label = F.lower("source_split")
    group = F.when(F.col("speaker_id") != "", F.concat(F.lit("speaker:"), "speaker_id")).otherwise(F.concat(F.lit("text:"), "text_fingerprint"))
    only = F.col("dataset").isin(*[d for d, yes in (official_only or {}).items() if yes])
    hashed = df.withColumn("__bucket", bucket(F.concat(F.lit(f"{seed}:"), "dataset", F.lit(":"), group)))
    split = (
        F.when(label.isin("validation", "valid", "dev"), "validation").when(label == "test", "test").when(only, "train")
        .when(F.col("__bucket") < low, "validation").when(F.col("__bucket") < high, "test").otherwise("train")
    )
    return hashed.withColumn("split", split).drop("__bucket")


def leakage_reasons(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """All rows with ``drop_reason``, null for those that stay. Reasons are fixed values.

    Validation rows go for text found in test, in any dataset, then for a speaker of the same dataset found in test. Of rows
    that repeat an id the first stays. Train rows then go for text or speakers of what evaluation keeps. Keys are flagged by
    left joins of distinct keys, so every row is counted under its first reason; hot keys of the row side may be split.
    """
    order = order or ["parquet_path", "row_in_group"]
    text, speaker = ["text_fingerprint"], ["dataset", "speaker_id"]
    keys = lambda rows, cols, flag: rows.where(" and ".join(f"{c} <> ''" for c in cols if c == "speaker_id") or "true").select(*cols).distinct().withColumn(flag, F.lit(True))
    test = df.where("split = 'test'")
    first = df.join(keys(test, text, "__a"), text, "left").join(keys(test, speaker, "__b"), speaker, "left").withColumn(
        "drop_reason",
        F.when((F.col("split") == "validation") & F.col("__a"), "validation_removed_test_text_overlap").when((F.col("split") == "validation") & F.col("__b"), "validation_removed_test_speaker_overlap"),
    ).drop("__a", "__b")
    held = first.where("drop_reason is null and split in ('validation', 'test')")
    again = Window.partitionBy("id").orderBy(F.col("drop_reason").isNotNull(), *order)
    return first.join(keys(held, text, "__a"), text, "left").join(keys(held, speaker, "__b"), speaker, "left").withColumn("__n", F.row_number().over(again)).withColumn(
        "drop_reason",
        F.coalesce("drop_reason", F.when(F.col("__n") > 1, "duplicate_record_id").when((F.col("split") == "train") & F.col("__a"), "train_removed_eval_text_overlap").when((F.col("split") == "train") & F.col("__b"), "train_removed_eval_speaker_overlap")),
    ).drop("__a", "__b", "__n")


def prune(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    return leakage_reasons(df, order).where("drop_reason is null").drop("drop_reason").select(*df.columns)


def prune_statistics(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    return leakage_reasons(df, order).where("drop_reason is not null").groupBy("drop_reason").agg(F.count(F.lit(1)).alias("rows"))


def curriculum(df: DataFrame, thresholds: list[float], column: str = "base_wer") -> DataFrame:
    """Every row once for each segment whose threshold it is under. Segments nest."""
    segments = F.array(*[F.when(F.col(column) < t, F.struct(F.lit(i).alias("segment"), F.lit(t).alias("threshold"))) for i, t in enumerate(thresholds)])
    return df.withColumn("__s", F.explode(F.filter(segments, lambda s: s.isNotNull()))).select(*df.columns, "__s.*")


def step_plan(thresholds: list[float], fractions: list[float], total_steps: int) -> list[tuple[float, int]]:
    """(threshold, steps) of each segment: at least one step each, the rest to the last."""
    steps = [max(1, int(total_steps * f)) for f in fractions[:-1]]
    last = total_steps - sum(steps)
    if last < 1:
        raise ValueError("too few steps for the segments")
    return list(zip(thresholds, [*steps, last]))
