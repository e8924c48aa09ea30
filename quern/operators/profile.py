"""Aggregates over manifests and corpora: leakage audit, cross-tabs, profiles, tokenizer reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.audio import format_label
from quern.functions.tokens import token_statistics
from quern.operators.contracts import check, leakage_violations
from quern.operators.dedup import first_per_group
from quern.operators.ranges import quantiles
from quern.storage import stash


def hours(duration: str = "duration", digits: int | None = 4) -> Column:
    total = F.coalesce(F.sum(duration), F.lit(0.0)) / 3600.0
    return total if digits is None else F.bround(total, digits)


def leakage_audit(df: DataFrame, enforce: bool = True) -> DataFrame:
    """One row for each split: examples, hours, fingerprints and scoped speakers of the whole table. Leaks raise if enforced."""
    if enforce:
        check(leakage_violations(df), "leakage")
    speaker = F.when(F.col("speaker_id") != "", F.struct("dataset", "speaker_id"))
    unique = df.agg(F.count_distinct("text_fingerprint").alias("unique_text_fingerprints"), F.count_distinct(speaker).alias("unique_scoped_speakers"))
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("examples"), hours().alias("hours")).crossJoin(F.broadcast(unique))  # one row


def by_dataset_and_split(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("examples"), hours().alias("hours"))


def manifest_summary(df: DataFrame, dimensions: tuple[str, ...] = ("dataset", "source_split", "domain")) -> DataFrame:
    """(dimension, value, examples, hours): the whole table and a histogram by each dimension, in one pass of grouping sets."""
    sets = [[], *[[d] for d in dimensions]]
    grouped = df.groupingSets(sets, *dimensions).agg(F.count(F.lit(1)).alias("examples"), hours(digits=None).alias("hours"), F.grouping_id().alias("g"))
    full = (1 << len(dimensions)) - 1
    name, value = F.when(F.col("g") == full, "all"), F.when(F.col("g") == full, "all")
    for i, d in enumerate(dimensions):
        own = F.col("g") == (full & ~(1 << (len(dimensions) - 1 - i)))
        name, value = name.when(own, d), value.when(own, F.col(d).cast("string"))
    return grouped.select(name.alias("dimension"), value.alias("value"), "examples", "hours")


def text_profile(df: DataFrame, low: int = X.TAMIL[0], high: int = X.TAMIL[1], fraction: Column | None = None, latin: str = X.LATIN_TOKEN) -> DataFrame:
    """Counts by dataset: rows, characters, rows with Latin tokens and annotations, three bands of script fraction."""
    banded = df.withColumn("__f", X.script_fraction(F.col("text"), low, high) if fraction is None else fraction)
    return banded.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("examples"), F.sum(F.char_length("text")).cast("long").alias("characters"), F.count_if(F.col("text").rlike(latin)).alias("latin_token_examples"),
        F.count_if(X.has_annotation(F.col("text"))).alias("annotation_examples"), F.count_if(F.col("__f") >= 0.95).alias("fraction_ge_95"),
        F.count_if((F.col("__f") >= 0.5) & (F.col("__f") < 0.95)).alias("fraction_50_95"), F.count_if(F.col("__f") < 0.5).alias("fraction_below_50"),
    )


def text_examples(df: DataFrame, order: list[str] | None = None, n: int = 8) -> DataFrame:
    """The first ``n`` rows of each dataset in order, with their Latin tokens. Each task keeps ``n`` rows a dataset, so nothing else is shuffled."""
    first = first_per_group(df, ["dataset"], order or ["parquet_path", "row_group", "row_in_group"], n)
    return first.select("dataset", "rank", "id", "text_column", "duration", "text", X.latin_tokens(F.col("text")).alias("latin_tokens"))


def audio_histograms(df: DataFrame, minimum_rms: float = 1e-5) -> DataFrame:
    """(dimension, value, rows) of accepted audits (column ``audit`` of AUDIT, null where decoding failed) and of rejections."""
    ok = F.col("error").isNull() & F.col("audit").isNotNull() & (F.col("audit.nonfinite_count") == 0) & (F.col("audit.rms") >= minimum_rms)
    reason = F.coalesce("error", F.when(F.col("audit.nonfinite_count") > 0, "ValueError:non-finite decoded samples").when(F.col("audit.rms") < minimum_rms, "ValueError:near-silent audio"))
    label = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value"))
    a = lambda f: F.col(f"audit.{f}")
    flags = {
        "clipped_fraction_ge_0.001": a("clipped_fraction") >= 0.001, "clipped_fraction_ge_0.01": a("clipped_fraction") >= 0.01,
        "abs_dc_offset_ge_0.02": F.abs(a("dc_offset")) >= 0.02, "rms_below_0.001": a("rms") < 0.001, "rms_above_0.25": a("rms") > 0.25,
    }
    good = [label("format", format_label(a("format"), a("subtype"))), label("sample_rate", a("original_sample_rate")), label("channels", a("channels")), *[F.when(c, label("signal", F.lit(n))) for n, c in flags.items()]]
    labels = F.when(ok, F.array(*good)).otherwise(F.array(label("rejected", F.concat(F.lit("audio_decode_or_validation:"), reason))))
    return df.select(F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("rows"))


def percentile(column: str, q: float) -> Column:
    """Nearest-rank percentile of a group as an aggregate, 0.0 of nothing. It holds the distinct values of a group; ranges.quantiles() is for whole tables."""
    return F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})"), F.lit(0.0))


def token_table(df: DataFrame, n_tokens: Column) -> DataFrame:
    stats = token_statistics(F.col("text"), n_tokens)
    return df.select("id", "dataset", *[c.alias(k) for k, c in stats.items()])


def tokenizer_report(rows: DataFrame) -> DataFrame:
    """One row over a token table: totals, corpus ratios, exact nearest-rank percentiles of the row ratios (0.0 of nothing).

    The ratios are written out once; percentiles come from counts by value range, so no task holds all values.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    slim = stash(rows.select("tokens", "words", "codepoints", "script_codepoints", "tokens_per_word", "tokens_per_codepoint"), "tokens")
    found = quantiles(slim, {
        "tokens_per_word_p50": ("tokens_per_word", 0.5), "tokens_per_word_p95": ("tokens_per_word", 0.95), "tokens_per_codepoint_p95": ("tokens_per_codepoint", 0.95),
    })
    return slim.agg(
        F.count(F.lit(1)).alias("examples"), total("tokens").alias("tokens"), total("words").alias("words"), total("codepoints").alias("codepoints"),
        total("script_codepoints").alias("script_codepoints"), (total("tokens") / F.greatest(total("words"), F.lit(1))).alias("corpus_tokens_per_word"),
        (total("tokens") / F.greatest(total("codepoints"), F.lit(1))).alias("corpus_tokens_per_codepoint"), *[F.lit(v or 0.0).alias(k) for k, v in found.items()],
    )


def worst_fragmented(rows: DataFrame, k: int = 20) -> DataFrame:
    return rows.orderBy(F.desc("tokens_per_word"), F.desc("tokens"), F.desc("id")).limit(k)
