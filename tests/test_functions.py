import hashlib
import io
import math
import random
import re
import unicodedata
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import audio, edits, slices
from quern.functions import text as X
from quern.functions import tokens as T


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").repartition(2)


def apply(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_normalize(spark):
    texts = [None, "é", "a​b﻿c", "x<|tok|>y", "\t a   b　c\x1cd \n", ""]
    assert apply(spark, texts, X.normalize) == ["", "é", "abc", "x y", "a b c d", ""]


def python_normalize(text):
    """The rule in plain Python."""
    value = unicodedata.normalize("NFC", text or "").translate({0x200B: None, 0xFEFF: None})
    return re.sub(r"\s+", " ", re.sub(X.CONTROL_TOKEN, " ", value)).strip(" ")


def test_normalize_matches_python_on_hard_texts(spark):
    """Every character alone and before a mark, every pair of marks of a sample, and random mixtures."""
    pick = random.Random(5)
    assigned = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    marks = [c for c in assigned if unicodedata.combining(c) or unicodedata.category(c)[0] == "M"]
    decomposing = [c for c in assigned if unicodedata.normalize("NFD", c) != c and not 0xAC00 <= ord(c) <= 0xD7A3]
    texts = ["".join(f"{c}x" for c in assigned[k:k + 40]) for k in range(0, len(assigned), 40)]
    texts += [c + m for c in pick.sample(assigned, 3000) for m in pick.sample(marks, 1)]
    texts += [unicodedata.normalize("NFD", c) for c in decomposing] + [c + pick.choice(marks) for c in decomposing]
    texts += ["".join(pick.choice([pick.choice(marks), pick.choice(decomposing), pick.choice("abக ே\u0bc6\u0bbe\u0bd7\u1100\u1161\u11a8한가")]) for _ in range(6)) for _ in range(6000)]
    got = apply(spark, texts, X.normalize)
    assert [(t, g) for t, g in zip(texts, got) if g != python_normalize(t)] == []
    asked = apply(spark, texts, X.may_compose)
    assert all(a or unicodedata.normalize("NFC", t) == t for t, a in zip(texts, asked))


def test_composed_texts_stay_in_the_jvm(spark):
    texts = ["plain", "Straße, é ñ", "தமிழ் மொழி ஔவை கொடு", "русский", "日本語 한국어", "हिन्दी"]
    assert apply(spark, texts, X.may_compose) == [False] * len(texts)


def test_fingerprint(spark):
    texts = ["Straße", "STRASSE", "!?", "…", "தமிழ் நூல்"]
    got = apply(spark, texts, lambda c: X.fingerprint(c))
    assert got[0] == got[1] and got[2] == got[3] == hashlib.sha1(b"").hexdigest()
    kept = "".join(c for c in texts[4].casefold() if unicodedata.category(c)[0] in "LNM")
    assert got[4] == hashlib.sha1(kept.encode()).hexdigest()
    lower = apply(spark, texts, X.fingerprint_lower)
    assert lower[0] != lower[1] and lower[4] == got[4]


def test_script_fraction(spark):
    got = apply(spark, ["தமிழ்", "தமிழ் abc", "123", "", "்ி"], X.script_fraction)
    assert got[0] == 1.0 and got[1] == pytest.approx(3 / 6) and got[2:] == [0.0, 0.0, 0.0]


def test_buckets(spark):
    values = ["a", "42:ta:speaker:x", "தமிழ்", ""]
    want = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big") % 10_000 for v in values]
    assert apply(spark, values, X.stable_bucket) == want
    assert apply(spark, values, X.sha_bucket) == [int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "big") % 10_000 for v in values]


def test_values(spark):
    assert apply(spark, ["1.5", "inf", "nan", "x", None, " 2 "], X.finite_double) == [1.5, None, None, None, None, 2.0]
    df = spark.createDataFrame([(" ", "b"), (None, "c"), ("bad", "1")], "x string, y string")
    assert [r[0] for r in df.select(X.first_value(F.col("x"), F.col("y"))).collect()] == ["b", "c", "bad"]
    assert [r[0] for r in df.limit(1).select(X.variants(x=F.col("x"), y=F.col("y"))).collect()] == [{"y": "b"}]


def test_slices(spark):
    assert apply(spark, ["அ a", "அ", "a", "1"], slices.script_slice) == ["tamil_latin_code_switch", "tamil_script", "latin_script", "other_script"]
    assert apply(spark, [4.9, 5.0, 15.0, 30.0], slices.duration_slice, "double") == ["under_5s", "5_to_15s", "15_to_30s", "30s_and_over"]
    severity = lambda s: apply(spark, [0.0, 1 / 3, 2 / 3, 1.0, None], lambda c: slices.severity_slice(F.lit(s), c), "double")
    assert severity("noise") == ["mild", "mild", "moderate", "severe", "targeted_unspecified"] and severity("")[-1] == "not_targeted"
    with pytest.raises(Exception, match="severity must be in"):
        apply(spark, [1.5], lambda c: slices.severity_slice(F.lit("n"), c), "double")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits(spark):
    pairs = [("a b c", "a b c"), ("a b c", ""), ("a b", "a x b y"), ("a a b", "a b b a"), ("நான் வீடு", "நான் வீ"), ("one two three", "two three four")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, h string")
    got = df.select("i", edits.word_errors(F.col("r"), F.col("h")), edits.char_errors(F.col("r"), F.col("h")), edits.excessive_length(F.col("r"), F.col("h"))).orderBy("i").collect()
    for (_, w, c, long_), (r, h) in zip(got, pairs):
        assert (w, c, long_) == (distance(r.split(), h.split()), distance(r, h), len(h) > max(2 * len(r), len(r) + 40))


def test_tokens(spark):
    df = spark.createDataFrame([([5, 6, 2, 0],), ([5, 0, 0, 0],), ([5, 6, 7, 8],), ([0, 1, 1, 1],)], "ids array<int>")
    got = [(r.c.ids, r.c.hit_limit) for r in df.select(T.trim_completion(F.col("ids"), 2, 0, 4).alias("c")).collect()]
    assert got == [([5, 6, 2], False), ([5], False), ([5, 6, 7, 8], True), ([], False)]
    s = spark.range(1).select(T.supervised(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)), 5, 0).alias("s")).first().s
    assert (s.input_ids, s.labels, s.attention, s.length) == ([1, 2, 3, 0, 0], [-100, -100, 3, -100, -100], [1, 1, 1, 0, 0], 3)
    spaced = [r[0] for r in spark.range(4).orderBy("id").select(T.evenly_spaced(F.col("id"), F.lit(8), F.lit(4))).collect()]
    assert spaced == [round(i * 7 / 3) for i in range(4)]
    T.register("upper", lambda t: [ord(c) for c in t.upper()])
    assert apply(spark, ["ab"], lambda c: T.tokenize("upper", c)) == [[65, 66]]


def wav(samples, channels=1, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def test_audio(spark):
    tone = (np.sin(np.arange(8000)) * 16000).astype("<i2")
    df = spark.createDataFrame([(0, bytearray(wav(tone))), (1, bytearray(b"junk")), (2, None), (3, bytearray(wav(np.zeros(10))))], "i int, b binary")
    rows = df.select("i", audio.audit_column(F.col("b")).alias("o")).orderBy("i").collect()
    a = rows[0].o.audit
    assert rows[0].o.error is None and a.channels == 1 and a.duration == 1.0 and a.format == "WAV" and a.rms == pytest.approx(math.sqrt(np.mean((tone / 32768.0) ** 2)), rel=1e-6)
    assert a.sha1 == hashlib.sha1(wav(tone)).hexdigest()
    assert rows[1].o.error == "ValueError:no codec" and rows[2].o.error == "ValueError:no payload" and rows[3].o.audit.rms == 0.0
    assert len(audio.mono(audio.decode(wav(tone)), 4000)) == 4000
