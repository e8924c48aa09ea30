"""The tables as a speech manifest: the same formulas as DataFrame expressions and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.quality import Thresholds, reject_reason
from quern.operators.ranges import numbered
from quern.session import ensure_importable

THRESHOLDS = Thresholds(min_alignment=0.05, min_script_fraction=0.9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest rows. Text is normalised once; everything after it stays in the JVM."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", X.normalize(F.col("text")).alias("text"))
    return docs.select(
        F.concat(F.lit("docs:"), d).alias("id"), d, F.col("lang").alias("dataset"), F.lit("").alias("split"),
        F.when(d % 20 == 0, "validation").when(d % 20 == 1, "test").otherwise("train").alias("source_split"),
        F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("spk"), d % 53)).alias("speaker_id"), F.col("source").alias("domain"), "text",
        F.when(d % 29 != 0, F.char_length("text") / (F.lit(6.0) + d % 25)).alias("duration"), F.when(d % 11 != 0, (d * 37 % 101) / F.lit(100.0)).alias("alignment_score"),
        ((d * 53 % 101) / F.lit(100.0)).alias("base_wer"), F.when(d % 4 == 0, "").otherwise("noise").alias("scenario"),
        F.when(d % 4 != 0, (d % 7) / F.lit(6.0)).alias("severity"), X.fingerprint_lower(F.col("text")).alias("text_fingerprint"),
    )


def judged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_view(spark, sf_dir).withColumn("reject_reason", reject_reason(THRESHOLDS, X.latin_fraction(F.col("text"))))


def evaluation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as references, each with the turn after it as hypothesis, whole, with white space squeezed."""
    from pyspark.sql import Window

    cut = X.squeeze
    turns = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    c, t = F.col("conv_id"), F.col("turn")
    return turns.where("next is not null").select(
        F.concat_ws(":", c, t).alias("id"), F.col("role").alias("dataset"), F.when(c % 2 == 0, "test").otherwise("").alias("source_split"), F.concat(F.lit("dom"), c % 3).alias("domain"),
        F.when(c % 4 == 0, "").otherwise(F.concat(F.lit("spk"), c % 5)).alias("speaker_id"), ((c * 7 + t) % 40).cast("double").alias("duration"),
        F.when(t % 2 == 0, "").otherwise("noise").alias("scenario"), F.when(t % 3 != 0, (c % 7) / F.lit(6.0)).alias("severity"),
        cut(F.col("text")).alias("reference"), cut(F.col("next")).alias("hypothesis"), (t % 5 == 0).alias("hit_max_new_tokens"),
    ).where("reference <> ''")


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a metric log: a run for each type of event, steps by time."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), "ts", "event_id", F.col("value").alias("loss"), (F.col("user_id") + 1).alias("tokens"))
    return numbered(rows, ["ts", "event_id"], "ord", ["run"]).select("run", (F.col("ord") + 1).alias("step"), "loss", "tokens")


_WS = X.WS
NORMAL = rf"trim(regexp_replace(regexp_replace(translate(nfc_normalize(coalesce(%s, '')), chr(8203) || chr(65279), ''), '<\|[^<>\n]{{1,128}}\|>', ' ', 'g'), '{_WS}+', ' ', 'g'), ' ')"
DOCS = f"(SELECT doc_id, lang, source, {NORMAL % 'text'} AS text FROM documents)"
FINGERPRINT = r"sha1(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]', '', 'g'))"
LATIN_SHARE = r"coalesce(len(regexp_extract_all(text, '[A-Za-z]')) / nullif(len(regexp_extract_all(text, '[\p{L}\p{Nd}]')), 0)::double, 0.0)"
BUCKET = "(('0x' || substr(sha256(%s), 1, 16))::ubigint %% 10000)::bigint"
VIEW = f"""
v AS (
  SELECT 'docs:' || doc_id AS id, doc_id, lang AS dataset,
    CASE WHEN doc_id % 20 = 0 THEN 'validation' WHEN doc_id % 20 = 1 THEN 'test' ELSE 'train' END AS source_split,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'spk' || (doc_id % 53) END AS speaker_id, source AS domain, text,
    CASE WHEN doc_id % 29 <> 0 THEN length(text) / (6.0::double + doc_id % 25) END AS duration,
    CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 37 % 101) / 100.0::double END AS alignment_score,
    (doc_id * 53 % 101) / 100.0::double AS base_wer, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'noise' END AS scenario,
    CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 7) / 6.0::double END AS severity, {FINGERPRINT} AS text_fingerprint
  FROM {DOCS})"""
JUDGED = f"""{VIEW},
j AS (
  SELECT *, CASE WHEN length(text) < 20 THEN 'empty_or_short_text' WHEN duration IS NULL THEN 'invalid_duration'
    WHEN NOT duration BETWEEN 0.5 AND 400 THEN 'duration_out_of_range'
    WHEN NOT length(text) / duration BETWEEN 8 AND 28 THEN 'implausible_text_audio_ratio'
    WHEN {LATIN_SHARE} < 0.9 THEN 'low_tamil_fraction'
    WHEN alignment_score IS NULL OR alignment_score < 0.05 THEN 'low_or_missing_alignment' END AS reject_reason
  FROM v)"""
_CUT = f"trim(regexp_replace(%s, '{_WS}+', ' ', 'g'), ' ')"
PAIRS = f"""
p AS (
  SELECT conv_id || ':' || turn AS id, role AS dataset, CASE WHEN conv_id % 2 = 0 THEN 'test' ELSE '' END AS source_split, 'dom' || (conv_id % 3) AS domain,
    CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'spk' || (conv_id % 5) END AS speaker_id, ((conv_id * 7 + turn) % 40)::double AS duration,
    CASE WHEN turn % 2 = 0 THEN '' ELSE 'noise' END AS scenario, CASE WHEN turn % 3 <> 0 THEN (conv_id % 7) / 6.0::double END AS severity,
    {_CUT % 'text'} AS reference, {_CUT % 'nxt'} AS hypothesis, turn % 5 = 0 AS hit
  FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL AND {_CUT % 'text'} <> '')"""
LOG = "l AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, value AS loss, user_id + 1 AS tokens FROM events)"
