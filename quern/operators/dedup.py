"""Keep-first and identity deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given. Partial minima leave each task, so a hot key stays small."""
    rest = [c for c in df.columns if c not in order and c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("__o"), F.min_by(F.struct(*(rest or order)), F.struct(*order)).alias("__r"))
    picked = {c: F.col(f"__o.{c}") for c in order} | {c: F.col(f"__r.{c}") for c in rest} | {c: F.col(c) for c in keys}
    return best.select(*[picked[c].alias(c) for c in df.columns])


def resolve_identity(df: DataFrame, identity: str = "identity") -> DataFrame:
    """All rows with ``drop_reason``: groups of one identity with different texts go whole, else the best row stays.

    Best is test before validation before train, then the smallest id. Reasons are fixed values. Two aggregates with partial
    results and a join, no gathered groups.
    """
    rank = F.when(F.col("split") == "test", 0).when(F.col("split") == "validation", 1).otherwise(2)
    groups = df.groupBy(identity).agg(
        (F.min("text_fingerprint") != F.max("text_fingerprint")).alias("__conflict"), F.min(F.struct(rank.alias("r"), F.col("id"))).alias("__best")
    )
    return df.join(groups, identity).withColumn(
        "drop_reason", F.when(F.col("__conflict"), "conflicting_transcripts_same_audio_removed").when(F.col("id") != F.col("__best.id"), "duplicate_audio_removed")
    ).drop("__conflict", "__best")


def audio_identity(df: DataFrame) -> DataFrame:
    """Add ``identity``: the hash of decoded samples, else of the payload."""
    return df.withColumn("identity", F.coalesce(F.nullif("audio_pcm_sha1", F.lit("")), F.nullif("audio_sha1", F.lit(""))))


def first_per_group(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; the window's group limit prunes in each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
