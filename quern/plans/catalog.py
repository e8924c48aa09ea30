"""Named queries over the tables, each with its SQL for DuckDB where SQL has the means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import edits, slices
from quern.functions import text as X
from quern.functions.tokens import learning_rate, supervised, tokenize, trim_completion
from quern.operators import batch, dedup, pack, profile, quality, sample, score, split, training_log
from quern.operators.contamination import shared_runs
from quern.operators.contracts import leakage_violations, manifest_violations, sampler_violations
from quern.plans.manifest_view import (
    BUCKET, DOCS, FINGERPRINT, JUDGED, LATIN_SHARE, LOG, NORMAL, PAIRS, VIEW, evaluation_view, judged_view, manifest_view, metric_log, table,
)
from quern.sources.discover import canonical, with_position
from quern.sources.fetch import POINTER, fetch_cells
from quern.sources.manifest import pick_ids
from quern.sources.row_groups import locate, row_groups
from quern.sources.scan import profile as schema_profile
from quern.sources.scan import text_rows
from quern.storage import stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The first half of official labels and 5 % each by hash, so that every path is taken.
FRACTIONS = {"validation_fraction": 0.05, "test_fraction": 0.05}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def assigned(s: SparkSession, d: str) -> DataFrame:
    """Accepted rows with their splits, without texts. Written out, so that texts are read once and not by every branch that follows."""
    rows = split.assign(judged_view(s, d).where("reject_reason is null"), **FRACTIONS, official_only={"de": True}, bucket=X.sha_bucket)
    return stash(rows.drop("text"), "assigned")


def official(s: SparkSession, d: str) -> DataFrame:
    return stash(manifest_view(s, d).withColumn("split", F.col("source_split")).drop("text"), "official")


def pruned(s: SparkSession, d: str) -> DataFrame:
    return split.prune(assigned(s, d), ["doc_id"])


_GROUP = "'42:' || dataset || ':' || CASE WHEN speaker_id <> '' THEN 'speaker:' || speaker_id ELSE 'text:' || text_fingerprint END"
ASSIGNED = f"""{JUDGED},
b AS (SELECT *, {BUCKET % _GROUP} AS bucket FROM j WHERE reject_reason IS NULL),
a AS (SELECT *, CASE WHEN source_split IN ('validation', 'test') THEN source_split WHEN dataset = 'de' THEN 'train'
   WHEN bucket < 500 THEN 'validation' WHEN bucket < 1000 THEN 'test' ELSE 'train' END AS split FROM b)"""


def _pruned(rows: str) -> str:
    return f"""
x1 AS (SELECT *, CASE WHEN split = 'validation' AND text_fingerprint IN (SELECT text_fingerprint FROM {rows} WHERE split = 'test') THEN 'validation_removed_test_text_overlap'
   WHEN split = 'validation' AND speaker_id <> '' AND (dataset, speaker_id) IN (SELECT (dataset, speaker_id) FROM {rows} WHERE split = 'test') THEN 'validation_removed_test_speaker_overlap' END AS r1 FROM {rows}),
x2 AS (SELECT *, coalesce(r1, CASE WHEN split = 'train' AND text_fingerprint IN (SELECT text_fingerprint FROM x1 WHERE r1 IS NULL AND split <> 'train') THEN 'train_removed_eval_text_overlap'
   WHEN split = 'train' AND speaker_id <> '' AND (dataset, speaker_id) IN (SELECT (dataset, speaker_id) FROM x1 WHERE r1 IS NULL AND split <> 'train') THEN 'train_removed_eval_speaker_overlap' END) AS drop_reason FROM x1)"""


# -- text ------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, text FROM {DOCS}")
def normalize_text(s, d):
    return table(s, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {FINGERPRINT} AS fingerprint FROM {DOCS}")
def fingerprint_lower(s, d):
    return manifest_view(s, d).select("doc_id", F.col("text_fingerprint").alias("fingerprint"))


@query()
def fingerprint_exact(s, d):
    rows = table(s, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("text"))
    return rows.select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@query(f"SELECT doc_id, round_even({LATIN_SHARE}, 9) AS fraction FROM {DOCS}")
def script_fraction(s, d):
    return manifest_view(s, d).select("doc_id", F.bround(X.latin_fraction(F.col("text")), 9).alias("fraction"))


@query(rf"""WITH {VIEW} SELECT id, CASE WHEN regexp_matches(text, '[\x{{0B80}}-\x{{0BFF}}]') AND regexp_matches(text, '[A-Za-z]') THEN 'tamil_latin_code_switch'
  WHEN regexp_matches(text, '[\x{{0B80}}-\x{{0BFF}}]') THEN 'tamil_script' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin_script' ELSE 'other_script' END AS script,
  CASE WHEN duration < 5 THEN 'under_5s' WHEN duration < 15 THEN '5_to_15s' WHEN duration < 30 THEN '15_to_30s' ELSE '30s_and_over' END AS duration_slice,
  CASE WHEN scenario = '' AND severity IS NULL THEN 'not_targeted' WHEN severity IS NULL THEN 'targeted_unspecified' WHEN severity <= 1.0::double / 3 THEN 'mild'
  WHEN severity <= 2.0::double / 3 THEN 'moderate' ELSE 'severe' END AS severity_slice FROM v""")
def slice_labels(s, d):
    v = manifest_view(s, d)
    return v.select(
        "id", slices.script_slice(F.col("text")).alias("script"), slices.duration_slice(F.col("duration")).alias("duration_slice"), slices.severity_slice(F.col("scenario"), F.col("severity")).alias("severity_slice")
    )


@query(rf"""SELECT doc_id, array_to_string(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9_.+-]*\b'), ' ') AS tokens FROM (SELECT doc_id, regexp_replace({NORMAL % 'text'}, '[^ -~]', ' ', 'g') AS text FROM documents)""")
def latin_tokens_ascii(s, d):
    """With a space for all that isn't ASCII: the engines' word boundaries differ beyond it."""
    ascii_only = F.regexp_replace(F.col("text"), "[^ -~]", " ")
    return manifest_view(s, d).select("doc_id", F.array_join(X.latin_tokens(ascii_only), " ").alias("tokens"))


@query()
def latin_tokens(s, d):
    return manifest_view(s, d).select("doc_id", F.array_join(X.latin_tokens(F.col("text")), " ").alias("tokens"))


@query("""SELECT event_id, CASE WHEN isfinite(x) THEN x END AS value, coalesce(nullif(trim(kind), ''), event_type) AS label FROM (
  SELECT event_id, event_type, try_cast(CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN 'inf' WHEN 2 THEN NULL ELSE value::varchar END AS double) AS x,
  CASE WHEN event_id % 3 = 0 THEN '  ' ELSE 'k' || (event_id % 3) END AS kind FROM events)""")
def first_value_and_finite_double(s, d):
    e, i = table(s, d, "events"), F.col("event_id")
    raw = F.when(i % 5 == 0, "n/a").when(i % 5 == 1, "inf").when(i % 5 == 2, F.lit(None)).otherwise(F.col("value").cast("string"))
    kind = F.when(i % 3 == 0, "  ").otherwise(F.concat(F.lit("k"), i % 3))
    return e.select("event_id", X.finite_double(raw).alias("value"), X.first_value(kind, F.col("event_type")).alias("label"))


@query("""SELECT doc_id, CASE WHEN lang = 'en' AND n <> '' THEN 'lang,text' WHEN n <> '' THEN 'text' ELSE '' END AS names FROM (SELECT doc_id, lang, """ + NORMAL % "text" + " AS n FROM documents)")
def variants_map(s, d):
    lang = F.when(F.col("lang") == "en", F.col("lang"))
    maps = table(s, d, "documents").select("doc_id", X.variants(lang=lang, text=F.col("text")).alias("m"))
    return maps.select("doc_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"))


# -- quality and splits ----------------------------------------------------------------------------------------------


@query(f"WITH {JUDGED} SELECT id, reject_reason FROM j")
def reject_cascade(s, d):
    return judged_view(s, d).select("id", "reject_reason")


@query(f"WITH {JUDGED} SELECT dataset, reject_reason AS reason, count(*) AS rows FROM j WHERE reject_reason IS NOT NULL GROUP BY ALL")
def reject_counts(s, d):
    return quality.reject_counts(judged_view(s, d))


@query(f"SELECT doc_id, CASE WHEN {BUCKET % 'doc_id::varchar'} < 100 THEN 'validation' ELSE 'train' END AS split FROM documents")
def text_split_sha256(s, d):
    inside = X.sha_bucket(F.col("doc_id").cast("string")) < 100
    return table(s, d, "documents").select("doc_id", F.when(inside, "validation").otherwise("train").alias("split"))


@query("SELECT doc_id::varchar AS doc_id, trim(text) AS text FROM documents WHERE trim(text) <> '' AND " + BUCKET % "doc_id::varchar" + " < 100")
def text_stream_validation(s, d):
    return text_rows(table(s, d, "documents").select("doc_id", "text", "_metadata"), "validation")


@query()
def split_assign_blake2(s, d):
    return split.assign(manifest_view(s, d), **FRACTIONS, bucket=X.stable_bucket).select("id", "split")


@query(f"WITH {ASSIGNED} SELECT id, split FROM a")
def split_assign(s, d):
    return assigned(s, d).select("id", "split")


@query(f"WITH {VIEW}, o AS (SELECT *, source_split AS split FROM v), {_pruned('o')} SELECT id, split, drop_reason FROM x2")
def leakage_prune(s, d):
    return split.leakage_reasons(official(s, d), ["doc_id"]).select("id", "split", "drop_reason")


@query(f"WITH {VIEW}, o AS (SELECT *, source_split AS split FROM v), {_pruned('o')} SELECT drop_reason, count(*) AS rows FROM x2 WHERE drop_reason IS NOT NULL GROUP BY ALL")
def leakage_stats(s, d):
    return split.prune_statistics(official(s, d), ["doc_id"])


@query(f"""WITH {VIEW}, o AS (SELECT *, source_split AS split FROM v)
SELECT 'text in several splits' AS rule, text_fingerprint AS key FROM o GROUP BY text_fingerprint HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'speaker in several splits', dataset || '/' || speaker_id FROM o WHERE speaker_id <> '' GROUP BY dataset, speaker_id HAVING count(DISTINCT split) > 1""")
def leakage_violation_rows(s, d):
    return leakage_violations(official(s, d))


_KEPT = f"{ASSIGNED}, {_pruned('a')}, k AS (SELECT * FROM x2 WHERE drop_reason IS NULL)"


@query(f"""WITH {_KEPT}, u AS (SELECT count(DISTINCT text_fingerprint) AS unique_text_fingerprints, count(DISTINCT CASE WHEN speaker_id <> '' THEN dataset || '/' || speaker_id END) AS unique_scoped_speakers FROM k)
SELECT split, count(*) AS examples, round_even(sum(duration) / 3600, 4) AS hours, any_value(unique_text_fingerprints) AS unique_text_fingerprints, any_value(unique_scoped_speakers) AS unique_scoped_speakers FROM k, u GROUP BY split""")
def leakage_audit(s, d):
    return profile.leakage_audit(stash(pruned(s, d), "pruned"))


@query(f"WITH {_KEPT} SELECT dataset, split, count(*) AS examples, round_even(sum(duration) / 3600, 4) AS hours FROM k GROUP BY ALL")
def dataset_split_summary(s, d):
    return profile.by_dataset_and_split(pruned(s, d))


@query(rf"""WITH b AS (SELECT item_id, lower(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark), w AS (SELECT DISTINCT array_to_string(x[i:i+7], ' ') AS gram FROM (SELECT string_split(t, ' ') AS x FROM b), range(1, 100000) r(i) WHERE i <= len(x) - 7),
g AS (SELECT DISTINCT doc_id, array_to_string(x[i:i+7], ' ') AS gram FROM (SELECT doc_id, string_split(lower(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS x FROM documents), range(1, 100000) r(i) WHERE i <= len(x) - 7)
SELECT doc_id, count(*) AS shared FROM g JOIN w USING (gram) GROUP BY doc_id""")
def eval_contamination(s, d):
    """Documents that share eight-word runs with the benchmark: the shape of the train anti-join, on word runs."""
    return shared_runs(table(s, d, "documents"), table(s, d, "benchmark"), 8)


# -- profiles --------------------------------------------------------------------------------------------------------


@query(f"""WITH {VIEW} SELECT 'all' AS dimension, 'all' AS value, count(*) AS examples, round_even(sum(duration) / 3600, 4) AS hours FROM v
UNION ALL SELECT 'dataset', dataset, count(*), round_even(sum(duration) / 3600, 4) FROM v GROUP BY dataset UNION ALL SELECT 'source_split', source_split, count(*), round_even(sum(duration) / 3600, 4) FROM v GROUP BY source_split
UNION ALL SELECT 'domain', domain, count(*), round_even(sum(duration) / 3600, 4) FROM v GROUP BY domain""")
def manifest_summary_grouping_sets(s, d):
    return profile.manifest_summary(manifest_view(s, d)).withColumn("hours", F.bround("hours", 4))


@query(rf"""WITH {VIEW}, f AS (SELECT *, {LATIN_SHARE} AS f FROM v) SELECT dataset, count(*) AS examples, sum(length(text))::bigint AS characters, count_if(regexp_matches(text, '[A-Za-z]'))::bigint AS latin_examples,
 count_if(regexp_matches(text, '\[[^\]\n]{{1,80}}\]|<[^<>\n]{{1,80}}>'))::bigint AS annotation_examples, count_if(f >= 0.95)::bigint AS fraction_ge_95, count_if(f >= 0.5 AND f < 0.95)::bigint AS fraction_50_95, count_if(f < 0.5)::bigint AS fraction_below_50 FROM f GROUP BY dataset""")
def text_profile_latin(s, d):
    return profile.text_profile(manifest_view(s, d), fraction=X.latin_fraction(F.col("text")), latin=X.LATIN).withColumnRenamed("latin_token_examples", "latin_examples")


_VOWELS, _TAMIL_VOWELS = "aeiou", "அஎஇஒஉ"
_MIXED = f"CASE WHEN doc_id % 2 = 0 THEN translate(text, '{_VOWELS}', '{_TAMIL_VOWELS}') ELSE text END"
_WORD = r"\p{L}\p{M}\p{Nd}_"


@query(rf"""WITH {VIEW}, m AS (SELECT dataset, {_MIXED} AS text FROM v), f AS (SELECT *, coalesce(len(regexp_extract_all(text, '[{_TAMIL_VOWELS}]')) / nullif(len(regexp_extract_all(text, '[\p{{L}}\p{{Nd}}]')), 0)::double, 0.0) AS f FROM m)
SELECT dataset, count(*) AS examples, sum(length(text))::bigint AS characters, count_if(regexp_matches(text, '(^|[^{_WORD}])[A-Za-z]([A-Za-z0-9_.+-]*[A-Za-z0-9_])?($|[^{_WORD}])'))::bigint AS latin_token_examples,
 count_if(regexp_matches(text, '\[[^\]\n]{{1,80}}\]|<[^<>\n]{{1,80}}>'))::bigint AS annotation_examples, count_if(f >= 0.95)::bigint AS fraction_ge_95, count_if(f >= 0.5 AND f < 0.95)::bigint AS fraction_50_95, count_if(f < 0.5)::bigint AS fraction_below_50 FROM f GROUP BY dataset""")
def text_profile(s, d):
    """With Tamil vowels in every other text."""
    mixed = F.when(F.col("doc_id") % 2 == 0, F.translate("text", _VOWELS, _TAMIL_VOWELS)).otherwise(F.col("text"))
    return profile.text_profile(manifest_view(s, d).withColumn("text", mixed))


@query(rf"""WITH {VIEW}, p AS (SELECT dataset, id, doc_id, duration, regexp_replace(text, '[^ -~]', ' ', 'g') AS text, row_number() OVER (PARTITION BY dataset ORDER BY doc_id)::int AS rank FROM v)
SELECT dataset, rank, id, duration, md5(text) AS text, array_to_string(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9_.+-]*\b'), ' ') AS latin_tokens FROM p WHERE rank <= 8""")
def text_examples(s, d):
    rows = manifest_view(s, d).withColumns({"text": F.regexp_replace("text", "[^ -~]", " "), "text_column": F.lit("text")})
    found = profile.text_examples(rows, ["doc_id"])
    return found.select("dataset", "rank", "id", "duration", F.md5("text").alias("text"), F.array_join("latin_tokens", " ").alias("latin_tokens"))


@query(f"""WITH n AS (SELECT text, lang, {NORMAL % 'text'} AS t, {NORMAL % 'lang'} AS l FROM documents) SELECT count(*) AS sample_rows, count_if(text IS NULL)::bigint AS nulls_text, count_if(lang IS NULL)::bigint AS nulls_lang,
 count_if(lang IS NOT NULL AND l = t)::bigint AS equal_lang, count_if(lang IS NOT NULL AND l <> t)::bigint AS unequal_lang, 0::bigint AS fraction_ge_95, 0::bigint AS fraction_50_95, 0::bigint AS fraction_0_50, count(*) AS no_script_characters,
 count_if(regexp_matches(t, '[A-Za-z]'))::bigint AS contains_latin, count_if(regexp_matches(t, '\\[[^\\]\\n]{{1,80}}\\]|<[^<>\\n]{{1,80}}>'))::bigint AS contains_annotation, sum(length(t))::bigint AS characters FROM n""")
def schema_profile_counts(s, d):
    return schema_profile(table(s, d, "documents"), "text", ["lang"])


@query(f"WITH {VIEW} SELECT dataset, id, rank FROM (SELECT dataset, id, row_number() OVER (PARTITION BY dataset ORDER BY doc_id)::int AS rank FROM v) WHERE rank <= 8")
def examples_first8(s, d):
    return dedup.first_per_group(manifest_view(s, d), ["dataset"], ["doc_id"], 8).select("dataset", "id", "rank")


_TOKENS = rf"""{VIEW}, t AS (SELECT id, doc_id, dataset, text, length(text)::bigint AS tokens, greatest(len(list_filter(string_split(text, ' '), lambda w: w <> '')), 1)::bigint AS words, greatest(length(text), 1)::bigint AS codepoints FROM v),
r AS (SELECT *, tokens / words::double AS tokens_per_word, tokens / codepoints::double AS tokens_per_codepoint FROM t)"""


@query(f"WITH {_TOKENS} SELECT id, tokens, words, round_even(tokens_per_word, 9) AS tokens_per_word FROM r ORDER BY r.tokens_per_word DESC, tokens DESC, id DESC LIMIT 20")
def worst_fragmented_topk(s, d):
    v = manifest_view(s, d)
    return profile.worst_fragmented(profile.token_table(v, F.char_length("text"))).select("id", "tokens", "words", F.bround("tokens_per_word", 9).alias("tokens_per_word"))


@query(f"""WITH {_TOKENS} SELECT count(*) AS examples, sum(tokens)::bigint AS tokens, sum(words)::bigint AS words, sum(codepoints)::bigint AS codepoints, 0::bigint AS script_codepoints, round_even(sum(tokens) / sum(words)::double, 9) AS corpus_tokens_per_word,
 round_even(sum(tokens) / sum(codepoints)::double, 9) AS corpus_tokens_per_codepoint, round_even(quantile_disc(tokens_per_word, 0.5), 9) AS tokens_per_word_p50, round_even(quantile_disc(tokens_per_word, 0.95), 9) AS tokens_per_word_p95,
 round_even(quantile_disc(tokens_per_codepoint, 0.95), 9) AS tokens_per_codepoint_p95 FROM r""")
def token_percentiles(s, d):
    report = profile.tokenizer_report(profile.token_table(manifest_view(s, d), F.char_length("text")))
    return report.select(*[F.bround(c, 9).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes])


# -- deduplication, samples, batches, blocks -------------------------------------------------------------------------


@query(f"WITH {VIEW} SELECT text_fingerprint, arg_min(id, doc_id) AS id FROM v GROUP BY text_fingerprint")
def dedup_keep_first(s, d):
    rows = manifest_view(s, d).select("text_fingerprint", "doc_id", "id")
    return dedup.keep_first(rows, ["text_fingerprint"], ["doc_id"]).select("text_fingerprint", "id")


@query(f"""WITH {VIEW}, i AS (SELECT id, source_split, md5(substr(text, 1, 40)) AS identity, text_fingerprint, CASE source_split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS r FROM v),
g AS (SELECT identity, min(text_fingerprint) <> max(text_fingerprint) AS conflict, arg_min(id, (r, id)) AS best FROM i GROUP BY identity)
SELECT id, CASE WHEN conflict THEN 'conflicting_transcripts_same_audio_removed' WHEN id <> best THEN 'duplicate_audio_removed' END AS drop_reason FROM i JOIN g USING (identity)""")
def dedup_conflict(s, d):
    rows = manifest_view(s, d).withColumns({"split": F.col("source_split"), "identity": F.md5(F.substring("text", 1, 40))}).drop("text")
    return dedup.resolve_identity(rows).select("id", "drop_reason")


@query(f"WITH {VIEW}, s(segment, threshold) AS (VALUES (0, 0.2::double), (1, 0.5::double), (2, 1.0::double)) SELECT id, segment, threshold FROM v JOIN s ON base_wer < threshold")
def curriculum_filter(s, d):
    return split.curriculum(manifest_view(s, d), [0.2, 0.5, 1.0]).select("id", "segment", "threshold")


@query(f"""WITH {VIEW}, n AS (SELECT count(*) AS total FROM v), f(segment, threshold, fraction) AS (VALUES (0, 0.2::double, 0.1::double), (1, 0.5::double, 0.3::double), (2, 1.0::double, 0.6::double)),
c AS (SELECT segment, threshold, greatest(1, floor(total * fraction))::bigint AS steps, total FROM f, n)
SELECT segment, threshold, CASE WHEN segment < 2 THEN steps ELSE total - sum(CASE WHEN segment < 2 THEN steps ELSE 0 END) OVER () END::bigint AS steps, (SELECT count(*) FROM v WHERE base_wer < threshold) AS rows FROM c""")
def curriculum_plan(s, d):
    """A step for each row of the table, dealt to segments, with the rows that each segment draws from."""
    rows = manifest_view(s, d).select("base_wer")
    plan = split.step_plan([0.2, 0.5, 1.0], [0.1, 0.3, 0.6], rows.count())
    sizes = split.curriculum(rows, [0.2, 0.5, 1.0]).groupBy("segment").agg(F.count(F.lit(1)).alias("rows"))
    return s.createDataFrame([(i, t, n) for i, (t, n) in enumerate(plan)], "segment int, threshold double, steps long").join(sizes, "segment", "left").fillna(0, ["rows"])


_TURN_BUCKET = "(('0x' || substr(sha256('smoke:42:' || id), 1, 16))::ubigint % 2147483647)::bigint"


@query(f"""WITH RECURSIVE {VIEW}, o AS (SELECT id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY {_TURN_BUCKET}, id) AS rank FROM v WHERE source_split = 'train'),
g AS (SELECT list(dataset ORDER BY dataset) AS names, list(n ORDER BY dataset) AS sizes, list(0::bigint ORDER BY dataset) AS taken FROM (SELECT dataset, count(*) AS n FROM o GROUP BY dataset)),
t AS (SELECT names, sizes, taken, 0::bigint AS cursor, NULL::varchar AS name, NULL::bigint AS rank FROM g UNION ALL
 SELECT CASE WHEN gone THEN list_concat(names[1:i - 1], names[i + 1:]) ELSE names END, CASE WHEN gone THEN list_concat(sizes[1:i - 1], sizes[i + 1:]) ELSE sizes END,
  CASE WHEN gone THEN list_concat(taken[1:i - 1], taken[i + 1:]) ELSE list_transform(taken, lambda x, j: CASE WHEN j = i THEN x + 1 ELSE x END) END, CASE WHEN gone THEN cursor ELSE cursor + 1 END,
  CASE WHEN gone THEN NULL ELSE names[i] END, CASE WHEN gone THEN NULL ELSE taken[i] + 1 END
 FROM (SELECT *, taken[i] >= sizes[i] AS gone FROM (SELECT *, cursor % len(names) + 1 AS i FROM t WHERE len(names) > 0 AND cursor < 200)))
SELECT t.cursor - 1 AS position, o.dataset, o.id FROM t JOIN o ON t.name = o.dataset AND t.rank = o.rank""")
def round_robin_subset(s, d):
    return sample.round_robin(official(s, d), "train", max_examples=200, bucket=lambda c: X.sha_bucket(c, 2**31 - 1)).select("position", "dataset", "id")


@query(f"""WITH RECURSIVE {VIEW}, r AS (SELECT id, dataset, duration, row_number() OVER (PARTITION BY dataset ORDER BY {_TURN_BUCKET}, id) AS rank FROM v WHERE source_split = 'test' AND duration IS NOT NULL),
g AS (SELECT dataset, count(*) AS n, row_number() OVER (ORDER BY dataset) - 1 AS ord FROM r GROUP BY dataset), k AS (SELECT count(*) AS k FROM g),
t AS (SELECT list(dataset ORDER BY dataset) AS names, list(n ORDER BY dataset) AS sizes, list(0::bigint ORDER BY dataset) AS taken, 0::bigint AS cursor, NULL::varchar AS name, NULL::bigint AS rank FROM g UNION ALL
 SELECT CASE WHEN gone THEN list_concat(names[1:i - 1], names[i + 1:]) ELSE names END, CASE WHEN gone THEN list_concat(sizes[1:i - 1], sizes[i + 1:]) ELSE sizes END,
  CASE WHEN gone THEN list_concat(taken[1:i - 1], taken[i + 1:]) ELSE list_transform(taken, lambda x, j: CASE WHEN j = i THEN x + 1 ELSE x END) END, CASE WHEN gone THEN cursor ELSE cursor + 1 END,
  CASE WHEN gone THEN NULL ELSE names[i] END, CASE WHEN gone THEN NULL ELSE taken[i] + 1 END
 FROM (SELECT *, taken[i] >= sizes[i] AS gone FROM (SELECT *, cursor % len(names) + 1 AS i FROM t WHERE len(names) > 0))),
p AS (SELECT t.cursor - 1 AS position, r.id, r.dataset, coalesce(sum(r.duration) OVER (ORDER BY t.cursor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t JOIN r ON t.name = r.dataset AND t.rank = r.rank)
SELECT position, dataset, id FROM p WHERE before < 3600""")
def round_robin_hours(s, d):
    """Test rows up to an hour, without a count."""
    rows = official(s, d).where("duration is not null")
    return sample.round_robin(rows, "test", target_hours=1.0, bucket=lambda c: X.sha_bucket(c, 2**31 - 1)).select("position", "dataset", "id")


@query(f"""WITH RECURSIVE {VIEW}, s AS (SELECT lower(source_split) AS k, count(*) AS n, min(doc_id) AS first FROM v GROUP BY 1),
i AS (SELECT list(k ORDER BY first) AS ks, list(n ORDER BY first) AS ns, list(c ORDER BY first) AS cs, any_value(total) AS total FROM
 (SELECT *, greatest(1, least(n, round_even(total * n / rows::double, 0)))::bigint AS c FROM (SELECT *, sum(n) OVER () AS rows, least(60, sum(n) OVER ())::bigint AS total FROM s))),
a AS (SELECT ks, ns, cs, total FROM i UNION ALL
 SELECT ks, ns, CASE WHEN list_sum(cs) > total THEN list_transform(cs, lambda c, j: CASE WHEN j = list_position(cs, list_max(cs)) THEN c - 1 ELSE c END)
  ELSE list_transform(cs, lambda c, j: CASE WHEN j = list_position(left_, list_max(left_)) THEN c + 1 ELSE c END) END, total
 FROM (SELECT *, list_transform(ns, lambda n, j: n - cs[j]) AS left_ FROM a) WHERE list_sum(cs) <> total),
f AS (SELECT unnest(ks) AS k, unnest(ns) AS n, unnest(cs) AS c FROM a WHERE list_sum(cs) = total),
p AS (SELECT k, i AS pick, CASE WHEN c = 1 THEN 0 ELSE round_even(i * (n - 1) / (c - 1)::double, 0) END::bigint AS at FROM f, range(0, 100) x(i) WHERE i < c),
o AS (SELECT source_split, id, row_number() OVER (PARTITION BY lower(source_split) ORDER BY doc_id) - 1 AS at FROM v)
SELECT source_split, pick, id FROM p JOIN o ON p.k = lower(o.source_split) AND p.at = o.at""")
def stratified_pick(s, d):
    return sample.stratified(manifest_view(s, d), 60, order=["doc_id"]).select("source_split", "pick", "id")


@query(f"""WITH {VIEW}, r AS (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY doc_id)::int AS rank FROM v) SELECT domain, id, rank FROM r WHERE rank <= (SELECT ceil(100.0 / count(DISTINCT domain)) FROM v) ORDER BY domain, rank LIMIT 100""")
def per_source_quota(s, d):
    return sample.per_source_quota(manifest_view(s, d), "domain", ["doc_id"], 100).select("domain", "id", "rank")


@query(f"""WITH RECURSIVE {VIEW}, o AS (SELECT id, duration AS d, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM v WHERE duration BETWEEN 0.5 AND 400),
i AS (SELECT *, ord // 64 AS bucket, row_number() OVER (PARTITION BY ord // 64 ORDER BY d, ord) AS k FROM o),
w AS (SELECT bucket, k, id, d, 0 AS batch, 0 AS place, d AS s FROM i WHERE k = 1 UNION ALL
 SELECT i.bucket, i.k, i.id, i.d, CASE WHEN w.s + i.d > 400 OR w.place + 1 >= 8 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.s + i.d > 400 OR w.place + 1 >= 8 THEN 0 ELSE w.place + 1 END,
  CASE WHEN w.s + i.d > 400 OR w.place + 1 >= 8 THEN i.d ELSE w.s + i.d END FROM w JOIN i ON i.bucket = w.bucket AND i.k = w.k + 1)
SELECT bucket, batch, place, id FROM w""")
def greedy_batches(s, d):
    rows = manifest_view(s, d).where("duration between 0.5 and 400").select("id", "doc_id", "duration")
    return batch.greedy_batches(rows, ["doc_id"], max_seconds=400.0, max_count=8, bucket_size=64).select("bucket", "batch", "place", "id")


@query(rf"""WITH {VIEW}, n AS (SELECT doc_id, text, length(text) + 1 AS n, sum(length(text) + 1) OVER (ORDER BY doc_id) - length(text) - 1 AS at FROM v WHERE text <> ''),
a AS (SELECT string_agg(text || chr(1), '' ORDER BY doc_id) AS t FROM n)
SELECT i AS block_id, md5(array_to_string(list_transform(string_split(substr(t, (i * 512 + 1)::bigint, 512), ''), lambda c: unicode(c)), ',')) AS block FROM a, range(0, 10000000) r(i) WHERE (i + 1) * 512 <= length(t)""")
def pack_blocks(s, d):
    """Code points as tokens, so that SQL can cut the same stream."""
    rows = stash(manifest_view(s, d).select("doc_id", "text"), "texts")  # normalised once
    blocks = pack.pack_blocks(rows, tokenize("char", F.col("text")), eos=1, block=512, order=["doc_id"], length=F.char_length("text"))
    return blocks.select("block_id", F.md5(F.array_join("tokens", ",")).alias("block"))


@query()
def token_blocks_word(s, d):
    rows = stash(manifest_view(s, d).select("doc_id", "text"), "texts")
    blocks = pack.pack_blocks(rows, tokenize("word", F.col("text")), eos=0, block=2048, order=["doc_id"], length=X.word_count(F.col("text")))
    return blocks.select("block_id", F.xxhash64("tokens").alias("digest"))


# -- scores ----------------------------------------------------------------------------------------------------------

_ASCII = r"regexp_replace(%s, '[^\x01-\x7f]', '~', 'g')"


@query(f"WITH {PAIRS} SELECT id, levenshtein({_ASCII % 'reference'}, {_ASCII % 'hypothesis'})::bigint AS char_errors, length(reference)::bigint AS reference_characters FROM p")
def cer_scores(s, d):
    plain = lambda c: F.regexp_replace(c, r"[^\x01-\x7f]", "~")
    e = evaluation_view(s, d)
    return e.select("id", edits.char_errors(plain("reference"), plain("hypothesis")).alias("char_errors"), F.char_length("reference").cast("long").alias("reference_characters"))


# Word errors row by row of the distance matrix: what a row takes from its left is a running minimum, all pairs at once.
def _word_errors(reference: str, hypothesis: str) -> str:
    return f"""{PAIRS}, w AS (SELECT id, list_filter(string_split({reference}, ' '), lambda x: x <> '') AS r, list_filter(string_split({hypothesis}, ' '), lambda x: x <> '') AS h FROM p),
m AS (SELECT id, 0::bigint AS i, j::bigint AS j, j::bigint AS e FROM w, range(0, 100000) x(j) WHERE j <= len(h) UNION ALL
 SELECT id, i + 1, j, (j + min(least(e + 1, coalesce(diagonal, i + 1) + CASE WHEN j = 0 THEN 1 ELSE (r[i + 1] <> h[j])::int END) - j) OVER (PARTITION BY id ORDER BY j))::bigint
 FROM (SELECT m.id, i, j, e, lag(e) OVER (PARTITION BY m.id ORDER BY j) AS diagonal, r, h FROM m JOIN w ON m.id = w.id WHERE i < len(r))),
k AS (SELECT m.id, any_value(m.e) AS word_errors, any_value(len(r))::bigint AS reference_words FROM m JOIN w ON m.id = w.id WHERE i = len(r) AND j = len(h) GROUP BY m.id)"""


_SCORED = f"""{_word_errors(_ASCII % 'reference', _ASCII % 'hypothesis')}, e AS (SELECT p.*, k.word_errors AS we, k.reference_words AS rn, levenshtein({_ASCII % 'reference'}, {_ASCII % 'hypothesis'})::bigint AS ce, length(reference)::bigint AS cn FROM p JOIN k USING (id))"""


@query(f"WITH RECURSIVE {_word_errors('reference', 'hypothesis')} SELECT id, word_errors, reference_words FROM k")
def wer_scores(s, d):
    e = evaluation_view(s, d)
    return e.select("id", edits.word_errors(F.col("reference"), F.col("hypothesis")).alias("word_errors"), edits.reference_words(F.col("reference")).alias("reference_words"))


_SEVERITY = "CASE WHEN scenario = '' AND severity IS NULL THEN 'not_targeted' WHEN severity IS NULL THEN 'targeted_unspecified' WHEN severity <= 1.0::double / 3 THEN 'mild' WHEN severity <= 2.0::double / 3 THEN 'moderate' ELSE 'severe' END"
_DIMENSIONS = {
    "overall": "'overall'", "dataset": "dataset", "domain": "domain", "source_split": "coalesce(nullif(source_split, ''), 'unknown')", "script": "CASE WHEN regexp_matches(reference, '[A-Za-z]') THEN 'latin_script' ELSE 'other_script' END",
    "duration": "CASE WHEN duration < 5 THEN 'under_5s' WHEN duration < 15 THEN '5_to_15s' WHEN duration < 30 THEN '15_to_30s' ELSE '30s_and_over' END", "scenario": "coalesce(nullif(scenario, ''), 'not_targeted')", "severity": _SEVERITY, "speaker": "nullif(speaker_id, '')",
}


@query(f"WITH RECURSIVE {_SCORED}, x AS (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS value, we, rn, ce, cn, hypothesis, reference, hit FROM e" for k, v in _DIMENSIONS.items()) + """)
SELECT dimension, value, round_even(sum(we) / greatest(sum(rn), 1)::double, 9) AS wer, sum(we)::bigint AS word_errors, round_even(sum(ce) / greatest(sum(cn), 1)::double, 9) AS cer, sum(ce)::bigint AS char_errors, sum(rn)::bigint AS reference_words, sum(cn)::bigint AS reference_characters, count(*) AS examples, count_if(hypothesis = '')::bigint AS empty_hypotheses,
 count_if(hit)::bigint AS hit_max_new_tokens, count_if(length(hypothesis) > greatest(2 * length(reference), length(reference) + 40))::bigint AS excessive_length_hypotheses FROM x WHERE value IS NOT NULL GROUP BY ALL""")
def sliced_metrics(s, d):
    """On turns with one sign for all that isn't ASCII, since DuckDB's distance compares bytes; sliced_metrics_full takes them as they are."""
    plain = evaluation_view(s, d).withColumns({c: F.regexp_replace(c, r"[^\x01-\x7f]", "~") for c in ("reference", "hypothesis")})
    return score.sliced_metrics(score.error_counts(plain)).withColumns({c: F.bround(c, 9) for c in ("wer", "cer")})


@query()
def sliced_metrics_full(s, d):
    return score.sliced_metrics(score.error_counts(evaluation_view(s, d)))


# -- lookups, logs, schedules ----------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY l.doc_id) - 1 AS ordinal, l.doc_id, source FROM labels l JOIN documents d USING (doc_id)")
def fixed_id_lookup(s, d):
    ids = batch.numbered(table(s, d, "labels").select("doc_id"), ["doc_id"], "ordinal")
    return pick_ids(table(s, d, "documents").select("doc_id", "source"), ids, "doc_id").select("ordinal", "doc_id", "source")


@query("SELECT doc_id, octet_length(encode(text))::bigint AS bytes, md5(text) AS digest, NULL::varchar AS error FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def pointer_lookup(s, d):
    """Texts of the labelled documents, each read from its row group by a pointer."""
    docs = table(s, d, "documents")
    rows = with_position(docs.select("doc_id", "_metadata")).join(table(s, d, "labels").select("doc_id").distinct(), "doc_id")
    groups = row_groups(s, docs.inputFiles()).withColumn("path", canonical(F.col("path")))
    placed = locate(rows.withColumn("parquet_path", canonical(F.col("file_path"))), groups).withColumn("audio_column", F.lit("text"))
    found = fetch_cells(placed.select("doc_id", *POINTER), ["doc_id"], texts=True)
    return found.select("doc_id", F.octet_length("payload").cast("long").alias("bytes"), F.md5("payload").alias("digest"), "error")


@query("SELECT lang, quality, count(*) AS rows, avg(n_chars) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_join_quality(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "n_chars").join(table(s, d, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("rows"), F.avg("n_chars").alias("mean_chars"))


@query(f"WITH {LOG} SELECT round_even(sum(loss * tokens) / sum(tokens), 6) AS loss, sum(tokens)::bigint AS tokens FROM (SELECT * FROM l ORDER BY step, run LIMIT 500)")
def weighted_mean_loss(s, d):
    return training_log.weighted_mean_loss(metric_log(s, d), "loss", "tokens", ["step", "run"], 500).withColumn("loss", F.bround("loss", 6))


@query(f"WITH {LOG} SELECT run, (step - 1) // 50 AS \"window\", max(step) AS last_step, round_even(sum(loss * tokens) / sum(tokens), 6) AS token_loss, round_even(avg(loss), 6) AS microbatch_loss, sum(tokens)::bigint AS tokens, count(*) AS microbatches FROM l GROUP BY ALL")
def log_windows(s, d):
    windows = training_log.log_windows(metric_log(s, d), "step", 50, "loss", "tokens", keys=("run",))
    return windows.withColumns({c: F.bround(c, 6) for c in ("token_loss", "microbatch_loss")})


@query(f"WITH {LOG}, b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM l) SELECT run, step, loss, best_before, best_before IS NULL OR loss < best_before AS improved FROM b")
def best_so_far(s, d):
    return training_log.best_so_far(metric_log(s, d), "step", "loss", "run").select("run", "step", "loss", "best_before", "improved")


@query(f"WITH {LOG}, t AS (SELECT run, step, max(step) OVER (PARTITION BY run) AS total FROM l) SELECT run, step, round_even(CASE WHEN step < 100 THEN step / 100.0::double ELSE 0.5::double * (1 + cos(pi() * least(1.0::double, (step - 100) / greatest(1, total - 100)::double))) END, 9) AS factor FROM t")
def lr_schedule(s, d):
    """The rate of every step of the log, over as many steps as its run has."""
    log = metric_log(s, d).select("run", "step")
    totals = log.groupBy("run").agg(F.max("step").alias("total"))
    return log.join(totals, "run").select("run", "step", F.bround(learning_rate(F.col("step"), 100, F.col("total")), 9).alias("factor"))


@query("""SELECT event_id, array_to_string(CASE WHEN e > 0 THEN ids[1:e] WHEN p > 0 THEN ids[1:p - 1] ELSE ids END, ',') AS ids, coalesce(e, 0) = 0 AND len(CASE WHEN coalesce(p, 0) > 0 THEN ids[1:p - 1] ELSE ids END) >= 4 AS hit_limit FROM (
 SELECT event_id, [user_id % 5, user_id % 3, value::bigint % 4, event_id % 6] AS ids, list_position([user_id % 5, user_id % 3, value::bigint % 4, event_id % 6], 2) AS e, list_position([user_id % 5, user_id % 3, value::bigint % 4, event_id % 6], 0) AS p
 FROM (SELECT event_id, user_id, floor(abs(value)) AS value FROM events))""")
def completion_trim(s, d):
    e = table(s, d, "events")
    ids = F.array(F.col("user_id") % 5, F.col("user_id") % 3, F.floor(F.abs("value")) % 4, F.col("event_id") % 6)
    cut = e.select("event_id", trim_completion(ids, 2, 0, 4).alias("c"))
    return cut.select("event_id", F.array_join("c.ids", ",").alias("ids"), "c.hit_limit")


@query(f"WITH {PAIRS} SELECT round_even(avg(length(hypothesis)), 6) AS mean_generated_tokens, round_even(avg(hit::int), 9) AS limit_rate FROM p")
def generation_rates(s, d):
    rows = evaluation_view(s, d).withColumn("generated_tokens", F.char_length("hypothesis"))
    return training_log.generation_rates(rows).select(F.bround("mean_generated_tokens", 6).alias("mean_generated_tokens"), F.bround("limit_rate", 9).alias("limit_rate"))


@query(f"""WITH {VIEW} SELECT 'duration must be positive' AS rule, id AS key FROM v WHERE coalesce(duration <= 0, true) UNION ALL SELECT 'longer than a batch', id FROM v WHERE coalesce(duration > 400, true)
UNION ALL SELECT 'base_wer out of range', id FROM v WHERE NOT base_wer BETWEEN 0 AND 1 UNION ALL SELECT 'wrong split', id FROM v WHERE source_split <> 'train' UNION ALL SELECT 'empty text', id FROM v WHERE trim(text) = ''""")
def contract_violations(s, d):
    v = manifest_view(s, d)
    held = v.withColumns({"split": F.col("source_split"), "parquet_path": F.lit("p"), "audio_column": F.lit("a"), "text_column": F.lit("t")})
    return sampler_violations(v, "id", "duration", 400.0).unionByName(manifest_violations(held, "train", base_wer=True))


@query("""SELECT event_id, array_to_string([user_id % 5, user_id % 3, event_id % 6, 9, 9], ',') AS input_ids, array_to_string([-100, -100, event_id % 6, -100, -100], ',') AS labels, '1,1,1,0,0' AS attention, 3 AS length FROM events""")
def supervised_arrays(s, d):
    e = table(s, d, "events")
    row = supervised(F.array(F.col("user_id") % 5, F.col("user_id") % 3), F.array(F.col("event_id") % 6), 5, pad=9)
    text = lambda f: F.array_join(F.col(f"r.{f}"), ",").alias(f)
    return e.select("event_id", row.alias("r")).select("event_id", text("input_ids"), text("labels"), text("attention"), "r.length")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Scan, normalise, judge, split by hash, prune leaks, and cross-tabulate."""
    return dataset_split_summary(s, d)
