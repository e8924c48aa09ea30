"""Word and character error rates, micro-averaged over overlapping slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import edits
from quern.functions.slices import evaluation_slices
from quern.functions.text import normalize
from quern.operators.contracts import check, evaluation_violations


def error_counts(df: DataFrame, compose: bool = True, enforce: bool = False) -> DataFrame:
    """Add error counts of each pair, on normalised text. Slices come from the raw row. Empty references raise if enforced."""
    r, h = F.col("__r"), F.col("__h")
    both = df.withColumn("__s", evaluation_slices()).withColumns({"__r": normalize(F.col("reference"), compose), "__h": normalize(F.col("hypothesis"), compose)})
    if enforce:
        check(evaluation_violations(both.select("id", F.col("__r").alias("reference"))), "evaluation")
    hit = F.coalesce("hit_max_new_tokens", F.lit(False)) if "hit_max_new_tokens" in df.columns else F.lit(False)
    return both.withColumns({
        "word_errors": edits.word_errors(r, h), "reference_words": edits.reference_words(r), "char_errors": edits.char_errors(r, h),
        "reference_characters": F.char_length(r).cast("long"), "empty_hypothesis": (h == "").cast("long"), "hit_limit": hit.cast("long"),
        "excessive_length": edits.excessive_length(r, h).cast("long"), "slices": F.col("__s"),
    }).drop("__r", "__h", "__s")


def sliced_metrics(scored: DataFrame) -> DataFrame:
    """(dimension, value) with rates of summed errors over summed lengths. Only counts are exploded, not texts."""
    sums = ["word_errors", "reference_words", "char_errors", "reference_characters", "empty_hypothesis", "hit_limit", "excessive_length"]
    overall = F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("overall").alias("value")))
    rows = scored.select(F.explode(F.concat(overall, "slices")).alias("s"), *sums).groupBy("s.dimension", "s.value").agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("examples")
    )
    return rows.select(
        "dimension", "value", (F.col("word_errors") / F.greatest("reference_words", F.lit(1))).alias("wer"), (F.col("char_errors") / F.greatest("reference_characters", F.lit(1))).alias("cer"),
        "word_errors", "reference_words", "char_errors", "reference_characters", "examples", F.col("empty_hypothesis").alias("empty_hypotheses"),
        F.col("hit_limit").alias("hit_max_new_tokens"), F.col("excessive_length").alias("excessive_length_hypotheses"),
    )
