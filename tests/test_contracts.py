"""Contracts, small functions, sinks and sources, by hand."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_functions import apply, distance

from quern import sinks
from quern.functions import audio, edits
from quern.functions import text as X
from quern.operators import contracts, profile
from quern.sources import discover, manifest


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_overlap(spark):
    rows = lambda data: spark.createDataFrame(data, "id string, text_fingerprint string")
    got = contracts.overlap(rows([("a", "x"), ("b", "y"), ("b", "y")]), rows([("b", "z"), ("c", "x"), ("d", "w")]))
    assert found(got) == [("shared id", "b"), ("shared text_fingerprint", "x")]
    assert found(contracts.overlap(rows([("a", "x")]), rows([("b", "y")]))) == []


def test_audio_hashes_and_payloads(spark):
    rows = spark.createDataFrame([("a", "", None), ("b", "p", ""), ("c", None, "s")], "id string, audio_pcm_sha1 string, audio_sha1 string")
    assert found(contracts.dedup_violations(rows)) == [("no audio hash", "a")]
    import hashlib

    sha = hashlib.sha1(b"x").hexdigest()
    data = [("ok", b"x", sha, 10.0, 10.2), ("none", None, sha, 1.0, 1.0), ("changed", b"y", sha, 1.0, 1.0), ("long", b"x", sha, 10.0, 10.3), ("edge", b"x", sha, 100.0, 102.0)]
    rows = spark.createDataFrame([(i, p and bytearray(p), s, d, e) for i, p, s, d, e in data], "id string, payload binary, audio_sha1 string, duration double, decoded_duration double")
    assert found(contracts.payload_violations(rows)) == [("duration mismatch", "long"), ("no payload", "none"), ("payload changed", "changed"), ("payload changed", "none")]


def test_waveforms_and_batches(spark):
    wave = spark.createDataFrame(
        [("ok", [0.5, -0.5], 16000, "text"), ("empty", [], 16000, "text"), ("nan", [math.nan], 16000, "text"), ("inf", [1.0, -math.inf], 16000, "text"), ("rate", [0.1], 8000, "text"), ("blank", [0.1], 16000, "  "), ("token", [0.1], 16000, "a|>b")],
        "id string, audio array<float>, rate int, text string",
    )
    assert found(contracts.waveform_violations(wave, 16000)) == [("control fragment", "token"), ("empty target", "blank"), ("empty waveform", "empty"), ("non-finite samples", "inf"), ("non-finite samples", "nan"), ("unexpected rate", "rate")]
    rows = [
        ("ok", [7, 7, 3, 4, 2, 0], [-100, -100, 3, 4, 2, -100], [1, 1, 1, 1, 1, 0], 5, 2, 2), ("prompt", [7, 5, 2], [-100, 5, 2], [1, 1, 1], 3, 2, 1), ("audio", [7, 7, 2], [7, -100, 2], [1, 1, 1], 3, 0, 2),
        ("none", [5, 2], [-100, 2], [1, 1], 2, 1, 0), ("count", [7, 2], [-100, 2], [1, 1], 2, 1, 3), ("shape", [7, 2], [-100, 2, 2], [1, 1], 2, 1, 1), ("pad", [7, 2, 0], [-100, 2, 0], [1, 1, 0], 2, 1, 1),
    ]
    batch = spark.createDataFrame(rows, "id string, input_ids array<int>, labels array<int>, attention array<int>, length int, prompt int, vectors int")
    got = found(contracts.batch_violations(batch, "id", pad=0, eos=2, prompt="prompt", placeholder=7, vectors="vectors"))
    assert got == [("no placeholder", "none"), ("padding supervised", "pad"), ("padding supervised", "shape"), ("placeholder supervised", "audio"), ("placeholders and vectors differ", "count"), ("prompt supervised", "prompt"), ("unequal shapes", "shape")]
    with pytest.raises(contracts.ContractError, match="lacks"):
        contracts.batch_violations(batch.drop("labels"), "id", 0, 2)


def test_parameters_of_runs_and_streams():
    contracts.check_text_stream("train", 1, 0.5, 0)
    for bad in (("test", 1, 0.5, 0), ("train", 0, 0.5, 0), ("train", 1, 0.0, 0), ("train", 1, 1.0, 0), ("train", 1, 0.5, None)):
        with pytest.raises(contracts.ContractError):
            contracts.check_text_stream(*bad)
    limits = dict.fromkeys(contracts._POSITIVE, 1) | {"save_every": 0, "max_steps": None}
    contracts.check_run(limits, False)
    contracts.check_run(limits, True, previous="p")
    contracts.check_run(limits, True, resume="r")
    for args in ((False, "p", None), (True, None, None), (True, "p", "r")):
        with pytest.raises(contracts.ContractError):
            contracts.check_run(limits, *args)
    for name, value in [(n, 0) for n in contracts._POSITIVE] + [("save_every", -1), ("max_steps", 0), ("sample_rate", -1)]:
        with pytest.raises(contracts.ContractError, match=name):
            contracts.check_run(limits | {name: value}, False)
    contracts.check_resume({"stage": 1, "x": 2}, {"stage": 1, "x": 3}, ["stage"])
    with pytest.raises(contracts.ContractError, match="manifest"):
        contracts.check_resume({"stage": 1, "manifest": "a"}, {"stage": 1, "manifest": "b"}, ["stage", "manifest"])


def test_sources_must_exist(spark, tmp_path):
    (tmp_path / "there x.parquet").write_bytes(b"")
    rows = spark.createDataFrame([(f"file:{tmp_path}/there%20x.parquet",), (str(tmp_path / "there x.parquet"),), (f"file:{tmp_path}/gone.parquet",)] * 2, "parquet_path string")
    assert found(manifest.missing_sources(rows)) == [("source missing", f"file:{tmp_path}/gone.parquet")]


def test_payload_cells(spark):
    df = spark.createDataFrame([((bytearray(b"x"), "p"),), ((None, "p"),), (None,)], "a struct<bytes:binary,path:string>")
    kind = df.schema["a"].dataType
    assert [r[0] and bytes(r[0]) for r in df.select(audio.payload_of("a", kind, allow_paths=True)).collect()] == [b"x", None, None]
    with pytest.raises(Exception, match="no embedded bytes"):
        df.select(audio.payload_of("a", kind)).collect()
    plain = spark.createDataFrame([(bytearray(b"y"),)], "a binary")
    assert bytes(plain.select(audio.payload_of("a", plain.schema["a"].dataType)).first()[0]) == b"y"
    close = spark.createDataFrame([(1.0, 1.25), (1.0, 1.26), (100.0, 98.0), (100.0, 97.9)], "a double, b double")
    assert [r[0] for r in close.select(audio.within_tolerance(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
    labels = spark.createDataFrame([("WAV", "PCM_16"), ("WAV", ""), ("", "PCM_16"), ("", "")], "a string, b string")
    assert [r[0] for r in labels.select(audio.format_label(F.col("a"), F.col("b"))).collect()] == ["WAV/PCM_16", "WAV", "PCM_16", ""]


def test_fragments_and_perplexity(spark):
    assert apply(spark, ["a<|b", "a|>b", "a<b|c>", ""], X.has_control_fragment) == [True, True, False, False]
    assert apply(spark, [0.0, 1.0, 30.0], X.perplexity, "double") == pytest.approx([1.0, math.e, math.exp(20)])


def test_sinks_of_evaluations_and_rows(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, None), ("a", 2, "ü")], "id string, n int, t string")
    for rows in (df, df.limit(1)):
        sinks.write_evaluation(rows, 7, f"file:{tmp_path}/e")
    assert spark.read.json(f"file:{tmp_path}/e").select("step").distinct().collect()[0][0] == 7 and spark.read.json(f"file:{tmp_path}/e/step=7").count() == 1
    assert sorted(json.loads(r[0])["id"] for r in sinks.as_json(df).collect()) == ["a", "b"]
    assert {"id": "b", "n": 1, "t": None} in [json.loads(r[0]) for r in sinks.as_json(df).collect()]


def test_text_files_and_yaml(spark, tmp_path):
    for name in ("x/a.parquet", "x/y/b.parquet", "x/c.txt", "z.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    got = discover.text_files(spark, [f"file:{tmp_path}/x", f"file:{tmp_path}/z.parquet"])
    assert [p.split(tmp_path.name)[1] for p in got] == ["/x/a.parquet", "/x/y/b.parquet", "/z.parquet"]
    for bad in ([f"file:{tmp_path}/none"], [f"file:{tmp_path}/x/c.txt"]):
        with pytest.raises(FileNotFoundError):
            discover.text_files(spark, bad)
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a: 1\nb: [x]\n")
    assert manifest.load_yaml(str(tmp_path / "c.yaml")) == {"a": 1, "b": ["x"]}
    (tmp_path / "c.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        manifest.load_yaml(str(tmp_path / "c.yaml"))


def test_audio_histograms(spark):
    a = {"format": "WAV", "subtype": "PCM_16", "original_sample_rate": 8000, "channels": 1, "rms": 0.3, "dc_offset": 0.0, "clipped_fraction": 0.005, "nonfinite_count": 0}
    schema = "error string, audit struct<" + audio.AUDIT.replace(" ", ":").replace(",:", ",") + ">"
    row = lambda **more: (None, {f.split()[0]: (a | more).get(f.split()[0]) for f in audio.AUDIT.split(", ")})
    df = spark.createDataFrame([row(), row(rms=0.0005, dc_offset=-0.03, channels=2), row(clipped_fraction=0.01, original_sample_rate=16000, rms=0.1), row(nonfinite_count=3), ("ValueError:near-silent audio", None)], schema)
    got = {(r.dimension, r.value): r.rows for r in profile.audio_histograms(df).collect()}
    assert got == {
        ("format", "WAV/PCM_16"): 3, ("sample_rate", "8000"): 2, ("sample_rate", "16000"): 1, ("channels", "1"): 2, ("channels", "2"): 1, ("signal", "clipped_fraction_ge_0.001"): 3,
        ("signal", "clipped_fraction_ge_0.01"): 1, ("signal", "abs_dc_offset_ge_0.02"): 1, ("signal", "rms_below_0.001"): 1, ("signal", "rms_above_0.25"): 1,
        ("rejected", "audio_decode_or_validation:ValueError:non-finite decoded samples"): 1, ("rejected", "audio_decode_or_validation:ValueError:near-silent audio"): 1,
    }


@pytest.mark.parametrize("rate, target", [(48_000, 16_000), (44_100, 16_000), (8_000, 16_000), (16_000, 11_025), (22_050, 22_050)])
def test_resampling(rate, target):
    """Length, phase and level of tones below the lower Nyquist frequency, and silence for what lies above it."""
    n = rate // 2
    t, u = np.arange(n) / rate, np.arange(-(-n * target // rate)) / target
    middle = slice(len(u) // 4, -len(u) // 4)
    low = min(rate, target) / 2
    for hz in (0.0, 50.0, 0.5 * low, 0.85 * low):
        got = audio.resample(np.cos(2 * np.pi * hz * t + 0.3).astype(np.float32), rate, target)
        assert len(got) == len(u) and got.dtype == np.float32
        assert np.abs(got[middle] - np.cos(2 * np.pi * hz * u + 0.3)[middle]).max() < 1e-3
    if target < rate:
        for hz in (1.02 * low, 1.3 * low, 0.49 * rate):
            got = audio.resample(np.sin(2 * np.pi * hz * t), rate, target)
            assert 20 * np.log10(np.sqrt(np.mean(got[middle] ** 2)) / np.sqrt(0.5)) < -60
    whole = audio.resample(np.random.default_rng(1).normal(size=50_000), 44_100, 16_000)
    audio.RESAMPLE_BLOCK, old = 7, audio.RESAMPLE_BLOCK
    try:
        assert np.array_equal(whole, audio.resample(np.random.default_rng(1).normal(size=50_000), 44_100, 16_000))
    finally:
        audio.RESAMPLE_BLOCK = old
    assert len(audio.resample(np.zeros(0), 44_100, 16_000)) == 0


def test_distances_of_long_texts(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60_000)]
    a = rng.choice(words, 100_000).tolist()
    b = [*a[:30_000], *["new"] * 40, *a[30_100:]]  # 40 of 100 words replaced, 60 lost
    df = spark.createDataFrame([(" ".join(a), " ".join(b)), ("", ""), (None, "x")], "r string, h string")
    assert [r[0] for r in df.select(edits.word_errors(F.col("r"), F.col("h"))).collect()] == [100, 0, None]
    for n, m, k in ((200, 150, 3), (64, 64, 2), (65, 130, 40), (0, 5, 2), (1, 1, 1)):
        x, y = (rng.integers(0, k, size).tolist() for size in (n, m))
        assert edits.distance(x, y) == distance(x, y) == edits.distance(y, x)


def riff(tag, channels, rate, bits, data, extensible=False, before=b"", cut=0):
    block = channels * bits // 8
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, rate, rate * block, block, bits)
    if extensible:
        head += struct.pack("<HHIH", 22, bits, 0, tag) + bytes.fromhex("000000001000800000aa00389b71")
    chunks = before + b"fmt " + len(head).to_bytes(4, "little") + head + b"data" + len(data).to_bytes(4, "little") + data
    return (b"RIFF" + (4 + len(chunks)).to_bytes(4, "little") + b"WAVE" + chunks)[:None if not cut else -cut]


def test_wav_samples_of_all_kinds():
    wave_ = np.sin(np.arange(400) / 7).astype(np.float32) * 0.9
    stereo = np.stack((wave_, -wave_), 1)
    kinds = {
        ("PCM_U8", 1, 8): np.round(stereo * 127 + 128).astype(np.uint8), ("PCM_16", 1, 16): np.round(stereo * 32767).astype("<i2"), ("PCM_32", 1, 32): np.round(stereo.astype(float) * (2**31 - 1)).astype("<i4"),
        ("FLOAT", 3, 32): stereo.astype("<f4"), ("DOUBLE", 3, 64): stereo.astype("<f8"),
    }
    for (name, tag, bits), x in kinds.items():
        for extensible in (False, True):
            got = audio.decode(riff(tag, 2, 8000, bits, x.tobytes(), extensible, before=b"LIST" + (3).to_bytes(4, "little") + b"abc\0"))
            assert (got.subtype, got.format, got.rate) == (name, "WAVEX" if extensible else "WAV", 8000)
            assert got.waveform.shape == (400, 2) and np.abs(got.waveform - stereo).max() < (0.012 if bits == 8 else 1e-4)  # a byte has steps of 1 / 128
    twentyfour = (np.round(stereo.astype(float) * (2**23 - 1)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    assert np.abs(audio.decode(riff(1, 2, 8000, 24, twentyfour)).waveform - stereo).max() < 1e-6
    # companded levels: known ends, odd symmetry, and rising magnitudes of every segment
    ulaw, alaw = audio._ulaw(), audio._alaw()
    assert (ulaw[0xFF], ulaw[0x00] * 32768, ulaw[0x80] * 32768) == (0, -32124, 32124) and (alaw[0xD5] * 32768, alaw[0x2A] * 32768, alaw[0xAA] * 32768) == (8, -32256, 32256)
    for table, flip in ((ulaw, 0x80), (alaw, 0x80)):
        assert all(table[c] == -table[c ^ flip] for c in range(256)) and len(set(np.abs(table))) >= 128 - 1
    assert audio.decode(riff(7, 1, 8000, 8, bytes([0xFF, 0x80]))).subtype == "ULAW" and audio.decode(riff(6, 1, 8000, 8, b"\xd5")).subtype == "ALAW"
    assert len(audio.decode(riff(1, 2, 8000, 16, bytes(40), cut=6)).waveform) == 8  # cut in the middle of a frame
    assert audio.audit(riff(3, 1, 8000, 32, np.array([0.5, np.nan, np.inf], "<f4").tobytes()))["nonfinite_count"] == 2
    for bad in (b"RIFF0000WAVE", b"RIFF0000AVI ", riff(2, 1, 8000, 4, b"x"), riff(1, 0, 8000, 16, b"")):
        with pytest.raises(ValueError):
            audio.decode(bad)
