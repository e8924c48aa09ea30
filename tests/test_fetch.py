import hashlib
import io
import json
import wave

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern import sinks
from quern.operators import audit, prepare, quality
from quern.schema import MANIFEST
from quern.sources import discover, fetch, manifest, row_groups, scan


def tone(seconds=1.0, rate=8000, hz=440.0, level=0.3, channels=1):
    x = (level * 32767 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.repeat(x, channels).tobytes())
    return out.getvalue()


def write(path, cells, rows_a_group, struct=True, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    audio = pa.array([c if c is None or not struct else {"bytes": c, "path": "x.wav"} for c in cells], pa.struct([("bytes", pa.binary()), ("path", pa.string())]) if struct else pa.binary())
    pq.write_table(pa.table({"audio": audio, **{k: pa.array(v) for k, v in columns.items()}}), path, row_group_size=rows_a_group, compression="none", use_dictionary=False)


def pointers(spark, rows):
    return spark.createDataFrame(rows, "id string, parquet_path string, row_group int, row_in_group int, audio_column string")


def test_footers_and_places(spark, tmp_path):
    for i in range(40):
        write(tmp_path / f"a b/{i:02}.parquet", [b"x"] * (i + 1), 7)
    write(tmp_path / "none.parquet", [], 7)
    (tmp_path / "bad.parquet").write_bytes(b"not parquet at all, by no means")
    paths = [f"file:{p}" for p in sorted((tmp_path / "a b").iterdir())] + [str(tmp_path / "none.parquet"), f"file://{tmp_path}/bad.parquet", f"file:{tmp_path}/gone.parquet"]
    got = row_groups.row_groups(spark, paths, files_a_task=5)
    assert got.rdd.getNumPartitions() == 9
    rows = got.collect()
    for i in range(40):
        own = sorted((r.row_group, r.first_row, r.rows) for r in rows if r.path.endswith(f"/{i:02}.parquet"))
        assert own == [(g, 7 * g, min(7, i + 1 - 7 * g)) for g in range(-(-(i + 1) // 7))]
    assert [r.rows for r in rows if r.path.endswith("none.parquet")] == [0]
    assert {r.path.rsplit("/")[-1]: r.error.split(":")[0] for r in rows if r.error} == {"bad.parquet": "ArrowInvalid", "gone.parquet": "FileNotFoundError"}
    asked = spark.createDataFrame([(paths[39], i) for i in (-1, 0, 6, 7, 39, 40)] + [("elsewhere", 0)], "parquet_path string, row_index long")
    placed = {(r.parquet_path, r.row_index): (r.row_group, r.row_in_group) for r in row_groups.locate(asked, got).collect()}
    assert [placed[paths[39], i] for i in (-1, 0, 6, 7, 39, 40)] == [(None, None), (0, 0), (0, 6), (1, 0), (5, 4), (None, None)] and placed["elsewhere", 0] == (None, None)


def test_fetch_equals_a_plain_read_and_errors_are_rows(spark, tmp_path):
    cells = [f"payload {i}".encode() * (i % 5 + 1) for i in range(500)]
    cells[17], cells[18] = None, b""
    write(tmp_path / "s.parquet", cells, 130)
    write(tmp_path / "b.parquet", cells, 130, struct=False)
    s, b = f"file:{tmp_path}/s.parquet", str(tmp_path / "b.parquet")
    rows = [(f"{p[-9:-8]}{i}", p, i // 130, i % 130, "audio") for p in (s, b) for i in range(500)]
    rows += [("twice", s, 1, 3, "audio"), ("over", s, 3, 110, "audio"), ("under", s, 0, -1, "audio"), ("null", s, 0, None, "audio"), ("group", s, 4, 0, "audio"), ("column", s, 0, 0, "nothing"), ("file", f"{s}.gone", 0, 0, "audio")]
    got = {r.id: r for r in fetch.fetch_cells(pointers(spark, rows).repartition(3), ["id"], partitions=5).collect()}
    assert len(got) == len(rows)
    for i in range(500):
        kept = [got[f"{p[-9:-8]}{i}"] for p in (s, b)]
        if i == 17:
            assert [r.error.split(":")[0] for r in kept] == ["ValueError", "TypeError"]
        elif i == 18:
            assert kept[0].error.startswith("ValueError") and kept[1].payload == b""
        else:
            assert all(bytes(r.payload) == cells[i] and r.error is None for r in kept)
    assert bytes(got["twice"].payload) == cells[133]
    assert {k: got[k].error.split(":")[0] for k in ("over", "under", "null", "group", "column", "file")} == {
        "over": "IndexError", "under": "IndexError", "null": "IndexError", "group": "IndexError", "column": "KeyError", "file": "FileNotFoundError",
    }
    assert all(got[k].payload is None for k in ("over", "group", "file"))


def test_row_groups_that_no_pointer_names_are_not_read(spark, tmp_path):
    cells = [bytes([i]) * 4000 for i in range(40)]
    path = tmp_path / "p.parquet"
    write(path, cells, 10, struct=False, text=[f"t{i}" for i in range(40)])
    data = bytearray(path.read_bytes())
    meta = pq.ParquetFile(path).metadata
    for g in (0, 1, 3):  # all pages of the other groups are wiped out, and the text column of the one that is read
        for c in range(meta.num_columns):
            column = meta.row_group(g).column(c)
            start = column.dictionary_page_offset or column.data_page_offset
            data[start:start + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    column = meta.row_group(2).column(1)
    data[column.data_page_offset:column.data_page_offset + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    path.write_bytes(data)
    got = fetch.fetch_cells(pointers(spark, [(str(i), str(path), 2, i, "audio") for i in range(10)]), ["id"]).collect()
    assert {r.id: bytes(r.payload) for r in got} == {str(i): cells[20 + i] for i in range(10)}
    with pytest.raises(Exception):
        fetch.fetch_cells(pointers(spark, [("x", str(path), 1, 0, "audio")]), ["id"]).collect()


def test_a_hot_file_is_spread_and_opened_in_order(spark, tmp_path):
    cells = [str(i).encode() for i in range(900)]
    write(tmp_path / "hot.parquet", cells, 100)
    rows = pointers(spark, [(str(i), str(tmp_path / "hot.parquet"), i // 100, i % 100, "audio") for i in range(900)])
    got = fetch.fetch_cells(rows.repartition(4), ["id"], partitions=6).withColumn("p", F.spark_partition_id()).collect()
    assert len({r.p for r in got}) >= 5 and all(bytes(r.payload).decode() == r.id for r in got)
    payloads = fetch.fetch_cells(rows, ["id"], partitions=6)._jdf.queryExecution().executedPlan().toString()
    assert payloads.index("MapInArrow") < payloads.index("Exchange")  # nothing is shuffled above the reader


def test_fetch_audio(spark, tmp_path):
    sound = tone(1.0, 8000, channels=2)
    write(tmp_path / "a.parquet", [sound, sound, b"junk", sound], 2)
    sha = hashlib.sha1(sound).hexdigest()
    rows = [("0", 1.1, sha), ("1", 9.0, sha), ("2", 1.0, ""), ("3", 1.0, "0" * 40)]
    df = spark.createDataFrame([(i, str(tmp_path / "a.parquet"), k // 2, k % 2, "audio", d, h) for k, (i, d, h) in enumerate(rows)], "id string, parquet_path string, row_group int, row_in_group int, audio_column string, duration double, audio_sha1 string")
    got = {r.id: r for r in fetch.fetch_audio(df, 16_000).collect()}
    assert len(got["0"].audio) == 16_000 and got["0"].rate == 16_000 and got["0"].error is None
    assert got["1"].error == "ValueError:Duration mismatch" and got["2"].error == "ValueError:no codec" and "hash differs" in got["3"].error
    assert fetch.fetch_audio(df.limit(0)).collect() == []


def corpus(tmp_path, spark):
    """Two datasets of tones in several row groups, with copies, silence, junk and a wrong duration."""
    word = "தமிழ் மொழி "
    for d, n in (("one", 30), ("two", 12)):
        cells = [tone(1 + (i % 4), 8000 if i % 2 else 16_000, 200 + 10 * i + (0 if d == "one" else 5)) for i in range(n)]
        texts = [f"{word}{'அஆஇஈஉஊஎஏஐஒஓஔ'[i % 12]}{'கஙசஞடணதநபமயரலவழளறன'[i % 18]} {d == 'one' and 'ஒன்று' or 'இரண்டு'} {'வ' * (i // 12 + 1)}" for i in range(n)]
        seconds = [float(1 + i % 4) for i in range(n)]
        cells[3], cells[4], seconds[5] = b"junk", tone(1, level=0.0), 4.0 if d == "one" else 2.0
        seconds[4] = 1.0
        cells[7], texts[7], seconds[7] = cells[6], texts[6], seconds[6]
        write(tmp_path / f"{d}/train-0.parquet", cells, 7, text=texts, seconds=seconds)
    return [
        scan.DatasetConfig(d, f"file:{tmp_path}", {"train": [f"{d}/*.parquet"]}, ["audio"], ["text"], ["seconds"], thresholds=quality.Thresholds(min_text_chars=5, min_chars_per_second=1, min_script_fraction=0.5))
        for d in ("one", "two")
    ]


def test_scan_gives_pointers_that_fetch_reads(spark, tmp_path):
    rows = scan.scan_enabled(spark, corpus(tmp_path, spark))
    got = rows.orderBy("id").collect()
    assert {(r.dataset, r.row_group, r.row_in_group) for r in got} == {(d, i // 7, i % 7) for d, n in (("one", 30), ("two", 12)) for i in range(n)}
    assert {r.id for r in got if r.dataset == "two"} == {f"two:two/train-0.parquet:rg{i // 7}:r{i % 7}" for i in range(12)}
    cells = fetch.fetch_cells(rows, ["id", "text"]).collect()
    table = {d: pq.read_table(tmp_path / f"{d}/train-0.parquet").to_pylist() for d in ("one", "two")}
    for r in cells:
        d, _, at = r.id.partition(":")
        g, i = at.rsplit(":rg")[1].split(":r")
        assert bytes(r.payload) == table[d][int(g) * 7 + int(i)]["audio"]["bytes"]


def test_audit_of_a_manifest(spark, tmp_path):
    rows = scan.scan_enabled(spark, corpus(tmp_path, spark)).withColumn("split", F.lit("train"))
    found = audit.audit_manifest(rows)
    assert found.rejected == {
        "audio_decode_or_validation:ValueError:no codec": 2, "audio_decode_or_validation:ValueError:near-silent audio": 2, "audio_decode_or_validation:ValueError:Duration mismatch": 1, "duplicate_audio_removed": 2,
    }
    kept = found.rows.collect()
    good = [(d, i) for d, n in (("one", 30), ("two", 12)) for i in range(n) if i not in (3, 4) and (d, i) != ("one", 5)]
    assert found.decoded_hours == round(sum(1 + ((6 if i == 7 else i) % 4) for _, i in good) / 3600, 4)
    assert sum(found.histograms["sample_rate"].values()) == sum(found.histograms["format"].values()) == len(good) == len(kept) + 2
    assert found.histograms["format"] == {"WAV/PCM_16": len(good)} and set(found.histograms["sample_rate"]) == {"8000", "16000"}
    assert all(r.audio_sha1 and r.decoded_duration > 0 and r.channels == 1 and r.audio_format == "WAV/PCM_16" for r in kept)


def test_prepare_manifests(spark, tmp_path):
    out = f"file:{tmp_path}/out"
    report = prepare.prepare_manifests(spark, corpus(tmp_path / "in", spark), out, 0.2, 0.1, smoke_train_hours=5 / 3600, smoke_validation_examples=3)
    assert json.loads((tmp_path / "out/audit_report.json").read_text())["rejections"] == report["rejections"]
    rows = spark.read.schema(MANIFEST).json(f"{out}/splits")
    by = {r["split"]: r["count"] for r in spark.read.json(f"{out}/splits").groupBy("split").count().collect()}
    assert by == {k: v["examples"] for k, v in report["overall"].items()} and sum(by.values()) == rows.count()
    smoke = spark.read.json(f"{out}/smoke_train")
    assert report["smoke"]["train_examples"] == smoke.count() and smoke.agg(F.sum("duration")).first()[0] >= 5.0
    assert report["smoke"]["validation_examples"] <= 3 and report["audio_profile"]["decoded_hours"] > 0
    assert set(report["text_profile"]) == {"one", "two"} and len(report["text_profile"]["one"]["examples"]) <= 8
    with pytest.raises(ValueError, match="accepted no row"):
        strict = corpus(tmp_path / "in", spark)
        strict[1].thresholds = quality.Thresholds(min_text_chars=10_000)
        prepare.prepare_manifests(spark, strict, out)
    with pytest.raises(ValueError, match="audio_audit"):
        prepare.prepare_manifests(spark, strict, out, audio_audit="some")


def test_json_errors_name_file_and_line(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, n int").schema
    good = [json.dumps({"id": f"r{i}", "n": i, "pad": "x" * 50}) for i in range(4000)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.jsonl").write_text("\n".join(good) + "\n\n  \n")
    (tmp_path / "m/b.jsonl").write_text("\n".join([*good[:4], "{bad", *good[4:3000], "", '{"id": 1', *good[3000:]]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(20_000))
    try:
        assert spark.read.text(f"file:{tmp_path}/m").rdd.getNumPartitions() > 10
        with pytest.raises(ValueError, match=r"b\.jsonl:5, .*b\.jsonl:3003"):
            manifest.read_jsonl(spark, f"file:{tmp_path}/m", schema)
        lines = manifest.numbered_lines(spark, f"file:{tmp_path}/m")
        want = {(n, i): t for n in "ab" for i, t in enumerate((tmp_path / f"m/{n}.jsonl").read_text().split("\n")[:-1], 1)}
        assert {(r.file[-7], r.line): r.value for r in lines.collect()} == want
        assert manifest.read_jsonl(spark, f"file:{tmp_path}/m/a.jsonl", schema).count() == 4000
        assert sum(r._corrupt_record is not None for r in manifest.read_jsonl(spark, f"file:{tmp_path}/m", schema, strict=False).collect()) == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_digests_in_chunks(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc" * 100_001)
    (tmp_path / "b.gz").write_bytes(b"")
    got = {r.path[-4:]: r for r in discover.file_digests(spark, [f"file:{tmp_path}/a", str(tmp_path / "b.gz"), str(tmp_path / "gone")], chunk=1000).collect()}
    a, b, gone = (next(r for k, r in got.items() if k.endswith(e)) for e in ("/a", "b.gz", "gone"))
    assert (a.length, a.sha256) == (300_003, hashlib.sha256(b"abc" * 100_001).hexdigest()) and (b.length, b.sha256) == (0, hashlib.sha256().hexdigest())
    assert gone.sha256 is None and gone.error.startswith("FileNotFoundError")


def test_report_is_replaced(spark, tmp_path):
    for i in range(2):
        sinks.write_report(spark, {"n": i}, f"file:{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 1} and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["r.json"]
