"""Data contracts: violations as rows of (rule, key), and the check that raises on the first few."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import has_control_fragment
from quern.schema import SPLITS


class ContractError(ValueError):
    """A table breaks its contract."""


def check(violations: DataFrame, what: str, shown: int = 5) -> None:
    found = [tuple(r) for r in violations.limit(shown).collect()]
    if found:
        raise ContractError(f"{what}: " + "; ".join(f"{rule} ({key})" for rule, key in found))


def broken(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that holds for a row, in one pass. Rules say what is wrong; null counts as wrong."""
    tests = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()])
    return df.select(F.explode(F.filter(tests, lambda r: r.isNotNull())).alias("rule"), F.col(key).cast("string").alias("key"))


def manifest_violations(df: DataFrame, split: str, audited: bool = False, base_wer: bool = False) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {"wrong split": F.col("split") != split, "empty text": blank("text"), "no id": blank("id"), "no provenance": blank("parquet_path") | blank("audio_column") | blank("text_column")}
    if audited:
        rules["audio not audited"] = (blank("audio_sha1") & blank("audio_pcm_sha1")) | (F.col("decoded_duration") <= 0)
    if base_wer:
        rules["base_wer out of range"] = ~F.col("base_wer").between(0, 1)
    return broken(df, "id", rules)


def leakage_violations(df: DataFrame) -> DataFrame:
    """Repeated ids, illegal splits, fingerprints and scoped speakers that span splits."""
    ids = df.groupBy("id").count().where("count > 1").select(F.lit("repeated id").alias("rule"), F.col("id").alias("key"))
    legal = broken(df, "id", {"illegal split": ~F.col("split").isin(*SPLITS)})
    spans = lambda rows, rule, *keys: rows.groupBy(*keys).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select(
        F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("key")
    )
    texts = spans(df, "text in several splits", "text_fingerprint")
    speakers = spans(df.where("speaker_id <> ''"), "speaker in several splits", "dataset", "speaker_id")
    return reduce(lambda a, b: a.unionByName(b), [ids, legal, texts, speakers])


def dedup_violations(df: DataFrame) -> DataFrame:
    return broken(df, "id", {"no audio hash": (F.coalesce("audio_pcm_sha1", F.lit("")) == "") & (F.coalesce("audio_sha1", F.lit("")) == "")})


def overlap(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Ids and fingerprints that both tables have."""
    common = lambda c: train.select(c).intersect(validation.select(c)).select(F.lit(f"shared {c}").alias("rule"), F.col(c).alias("key"))
    return common("id").unionByName(common("text_fingerprint"))


def sampler_violations(df: DataFrame, key: str, duration: str, cap: float) -> DataFrame:
    return broken(df, key, {"duration must be positive": F.col(duration) <= 0, "longer than a batch": F.col(duration) > cap})


def target_violations(df: DataFrame, key: str = "id") -> DataFrame:
    """Training targets: not empty, no fragment of a control token."""
    return broken(df, key, {"empty target": F.col("text") == "", "control fragment": has_control_fragment(F.col("text"))})


def waveform_violations(df: DataFrame, rate: int, key: str = "id") -> DataFrame:
    """Decoded rows before they are batched: ``audio`` an array of finite samples, not empty, at ``rate``; a target as target_violations() wants it."""
    x = F.col("audio")
    return broken(df, key, {
        "empty waveform": F.size(x) <= 0, "non-finite samples": F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "unexpected rate": F.col("rate") != rate,
        "empty target": F.trim("text") == "", "control fragment": has_control_fragment(F.col("text")),
    })


def batch_violations(
    df: DataFrame, key: str, pad: int, eos: int, ignore: int = -100, prompt: str | None = None, placeholder: int | None = None, vectors: str | None = None,
) -> DataFrame:
    """Padded arrays ``input_ids``, ``labels``, ``attention``, ``length``: equal shapes, a supervised token, the end id
    supervised, padding unsupervised, attention 1 just over the length.

    ``prompt`` names a column with the prompt's length: none of it may be supervised. ``placeholder`` is the id that stands for audio: there must be
    one, none supervised, and as many as the column ``vectors`` says, if it is named. A table without a required column is an error.
    """
    needed = ["input_ids", "labels", "attention", "length", *[c for c in (prompt, vectors) if c]]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ContractError(f"batch lacks {missing}")
    ids, labels, seen, n = F.col("input_ids"), F.col("labels"), F.col("attention"), F.col("length")
    tail = F.slice(labels, n + 1, F.greatest(F.size(labels) - n, F.lit(0)))
    rules = {
        "unequal shapes": (F.size(ids) != F.size(labels)) | (F.size(ids) != F.size(seen)), "nothing supervised": ~F.exists(labels, lambda x: x != ignore),
        "end id unsupervised": F.element_at(labels, n) != eos, "padding supervised": F.exists(tail, lambda x: x != ignore),
        "attention off": F.aggregate(seen, F.lit(0), lambda a, x: a + x) != n,
    }
    if prompt:
        rules["prompt supervised"] = F.exists(F.slice(labels, F.lit(1), F.col(prompt)), lambda x: x != ignore)
    if placeholder is not None:
        held = F.filter(F.arrays_zip(ids.alias("i"), labels.alias("l")), lambda z: z["i"] == placeholder)
        rules["no placeholder"] = F.size(held) == 0
        rules["placeholder supervised"] = F.exists(held, lambda z: z["l"] != ignore)
        if vectors:
            rules["placeholders and vectors differ"] = F.size(held) != F.col(vectors)
    return broken(df, key, rules)


def check_text_stream(split: str, block_size: int, validation_fraction: float, eos: int | None) -> None:
    """Parameters of a text stream that is packed into blocks."""
    if split not in ("train", "validation"):
        raise ContractError("split must be train or validation")
    if block_size <= 0:
        raise ContractError("block_size must be positive")
    if not 0 < validation_fraction < 1:
        raise ContractError("validation_fraction must be in (0, 1)")
    if eos is None:
        raise ContractError("the tokenizer must define an end id")


#: Limits of a run by the least value allowed: over 0, and from 0 on.
_POSITIVE = ("gradient_accumulation", "sample_rate", "max_batch_size", "max_batch_audio_seconds", "log_every", "evaluate_every", "evaluation_examples", "max_new_tokens")


def check_run(limits: dict, needs_previous: bool, previous: str | None = None, resume: str | None = None) -> None:
    """Limits of a training run and where it starts: from a previous stage or a resume, not both, and the previous stage only where one is needed."""
    if previous is not None and resume is not None:
        raise ContractError("choose either a previous stage or a resume")
    if needs_previous and previous is None and resume is None:
        raise ContractError("this stage needs the one before it, or a resume")
    if not needs_previous and previous is not None:
        raise ContractError("this stage starts from the base model")
    for name in _POSITIVE:
        if name not in limits or not limits[name] > 0:
            raise ContractError(f"{name} must be positive")
    if limits.get("save_every", 0) < 0:
        raise ContractError("save_every must not be negative")
    if limits.get("max_steps") is not None and limits["max_steps"] <= 0:
        raise ContractError("max_steps must be positive")


def evaluation_violations(df: DataFrame) -> DataFrame:
    return broken(df, "id", {"empty reference": F.col("reference") == ""})


def payload_violations(df: DataFrame) -> DataFrame:
    """Payloads beside their manifest: ``payload``, ``audio_sha1``, ``duration``, ``decoded_duration``."""
    from quern.functions.audio import within_tolerance

    return broken(df, "id", {
        "no payload": F.col("payload").isNull(), "payload changed": F.sha1("payload") != F.col("audio_sha1"),
        "duration mismatch": ~within_tolerance(F.col("duration"), F.col("decoded_duration")),
    })


def check_recipe(thresholds: list[float], fractions: list[float]) -> None:
    """Curriculum recipe: thresholds rise strictly in (0, 1], fractions are positive and sum to 1."""
    if not thresholds or len(thresholds) != len(fractions):
        raise ContractError("thresholds and fractions must pair up")
    if any(not 0 < t <= 1 for t in thresholds) or any(a >= b for a, b in zip(thresholds, thresholds[1:])):
        raise ContractError("thresholds must rise strictly in (0, 1]")
    if any(f <= 0 for f in fractions) or abs(sum(fractions) - 1) > 1e-9:
        raise ContractError("fractions must be positive and sum to 1")


def check_ranges(config: dict, ranges: dict[str, tuple[float, float]]) -> None:
    """Required keys of a configuration, with inclusive ranges."""
    for key, (low, high) in ranges.items():
        if key not in config:
            raise ContractError(f"configuration lacks {key}")
        if not low <= float(config[key]) <= high:
            raise ContractError(f"{key} must be in [{low}, {high}], found {config[key]}")


def check_resume(saved: dict, now: dict, keys: list[str]) -> None:
    """A run resumes only on what it was started with."""
    changed = [k for k in keys if saved.get(k) != now.get(k)]
    if changed:
        raise ContractError(f"resume differs in {changed}")


def check_lineage(stages: list[str], done: list[str], target: str) -> None:
    """A stage may start when all stages before it are done, in order."""
    needed = stages[:stages.index(target)]
    if done != needed:
        raise ContractError(f"{target} needs {needed}, found {done}")
