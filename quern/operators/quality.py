"""Reason cascade: the first rule that a row breaks is its reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X


@dataclass(frozen=True)
class Thresholds:
    """Bounds are inclusive. ``min_alignment`` None: alignment isn't looked at; else a missing score fails."""

    min_text_chars: int = 20
    min_duration: float = 0.5
    max_duration: float = 400.0
    min_chars_per_second: float = 8.0
    max_chars_per_second: float = 28.0
    min_script_fraction: float = 0.9
    min_alignment: float | None = None
    script: tuple[int, int] = X.TAMIL


def reject_reason(t: Thresholds, fraction: Column | None = None) -> Column:
    """Name of the first rule broken by ``text``, ``duration``, ``alignment_score``; null if none is. Reasons are fixed values.

    Regular expressions come after the cheap tests: CASE stops at the first match.
    """
    text, seconds, alignment = F.col("text"), F.col("duration"), F.col("alignment_score")
    fraction = X.script_fraction(text, *t.script) if fraction is None else fraction
    pace = X.chars_per_second(text, seconds)
    reason = (
        F.when(F.char_length(text) < t.min_text_chars, "empty_or_short_text").when(seconds.isNull(), "invalid_duration")
        .when(~seconds.between(t.min_duration, t.max_duration), "duration_out_of_range")
        .when(~F.coalesce(pace.between(t.min_chars_per_second, t.max_chars_per_second), F.lit(False)), "implausible_text_audio_ratio")
        .when(fraction < t.min_script_fraction, "low_tamil_fraction")
    )
    return reason if t.min_alignment is None else reason.when(alignment.isNull() | (alignment < t.min_alignment), "low_or_missing_alignment")


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def reject_counts(df: DataFrame) -> DataFrame:
    """(dataset, reason, rows) of rejected rows."""
    return df.where(F.col("reject_reason").isNotNull()).groupBy("dataset", F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def under_base_error(df: DataFrame, limit: float) -> DataFrame:
    """Rows with ``base_wer`` under the limit. One null or out-of-range value, or no row left, is an error."""
    bad = df.where("base_wer is null or base_wer < 0 or base_wer > 1 or isnan(base_wer)").limit(1)
    if not bad.isEmpty():
        raise ValueError("every row needs a base_wer in [0, 1]")
    kept = df.where(F.col("base_wer") < limit)
    if kept.isEmpty():
        raise ValueError(f"no row has base_wer < {limit}")
    return kept


def without_survivors(before: DataFrame, after: DataFrame) -> DataFrame:
    """Datasets of ``before`` that have no row in ``after``."""
    return before.select("dataset").distinct().join(after.select("dataset").distinct(), "dataset", "left_anti")
