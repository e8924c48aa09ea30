"""Token arrays: statistics, trimming, labels, schedules. Tokenizers are pluggable Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import WS, word_count

REGISTRY: dict[str, Callable[[Column], Column]] = {}


def register(name: str, encode: Callable[[str], list[int]]) -> None:
    """Register a Python callable from text to ids; columns are encoded batch-wise over Arrow."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(encode(t or "")))

    REGISTRY[name] = ids


def tokenize(name: str, text: Column) -> Column:
    """Ids by a registered tokenizer; ``char`` (code points) and ``word`` (hash of each word) stay in the JVM."""
    if name == "char":
        return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    if name == "word":
        return F.transform(F.filter(F.split(text, WS), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(1 << 30)).cast("int"))
    return REGISTRY[name](text)


def token_statistics(text: Column, n_tokens: Column, low: int = 0x0B80, high: int = 0x0BFF) -> dict[str, Column]:
    words, points = F.greatest(word_count(text), F.lit(1)).cast("long"), F.greatest(F.char_length(text), F.lit(1)).cast("long")
    return {
        "tokens": n_tokens.cast("long"), "words": words, "codepoints": points,
        "script_codepoints": F.regexp_count(text, F.lit(rf"[\x{{{low:x}}}-\x{{{high:x}}}]")).cast("long"),
        "tokens_per_word": n_tokens / words, "tokens_per_codepoint": n_tokens / points,
    }


def trim_completion(ids: Column, eos: int, pad: int, limit: int) -> Column:
    """(ids, hit_limit): up to and with the first end id, else before the first padding id; whether the limit stopped it."""
    end, blank = F.array_position(ids, eos).cast("int"), F.array_position(ids, pad).cast("int")
    cut = F.when(end > 0, F.slice(ids, 1, end)).when(blank > 1, F.slice(ids, 1, blank - 1)).when(blank == 1, F.slice(ids, 1, 0)).otherwise(ids)
    return F.struct(cut.alias("ids"), ((end == 0) & (F.size(cut) >= limit)).alias("hit_limit"))


def supervised(prompt: Column, target: Column, width: Column | int, pad: int, ignore: int = -100) -> Column:
    """(input_ids, labels, attention, length): prompt and target joined, prompt and padding unsupervised, padded on the right."""
    ids = F.concat(prompt, target)
    gap = F.greatest((F.lit(width) if isinstance(width, int) else width) - F.size(ids), F.lit(0)).cast("int")
    labels = F.concat(F.array_repeat(F.lit(ignore), F.size(prompt)), target, F.array_repeat(F.lit(ignore), gap))
    return F.struct(
        F.concat(ids, F.array_repeat(F.lit(pad), gap)).alias("input_ids"), labels.alias("labels"),
        F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap)).alias("attention"), F.size(ids).alias("length"),
    )


def evenly_spaced(i: Column, length: Column, count: Column) -> Column:
    """Position of the i-th of ``count`` evenly spaced picks out of ``length``, halves to even."""
    return F.when(count == 1, F.lit(0)).otherwise(F.rint(i * (length - 1) / F.nullif(count - 1, F.lit(0)))).cast("long")


def learning_rate(step: Column, warmup: int, total: int | Column) -> Column:
    """Linear warm-up, then half a cosine."""
    span = F.greatest(F.lit(1), (F.lit(total) if isinstance(total, int) else total) - warmup)
    progress = F.least(F.lit(1.0), (step - warmup) / span)
    return F.when(step < warmup, step / F.lit(max(1, warmup))).otherwise(0.5 * (1.0 + F.cos(F.pi() * progress)))
