import json

import pytest
from pyspark.sql import functions as F

from quern import sinks
from quern.operators import batch, contracts, dedup, pack, profile, quality, sample, score, split, training_log
from quern.schema import MANIFEST, bind_manifest
from quern.sources import discover, manifest, scan


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_cascade(spark):
    t = quality.Thresholds(min_text_chars=3, min_duration=1, max_duration=10, min_chars_per_second=1, max_chars_per_second=5, min_alignment=0.5)
    data = [
        ("", 2.0, 1.0, "empty_or_short_text"), ("", None, None, "empty_or_short_text"), ("அஆஇ", None, 1.0, "invalid_duration"), ("அஆஇ", 0.5, 1.0, "duration_out_of_range"),
        ("அஆஇ", 9.0, 1.0, "implausible_text_audio_ratio"), ("abc", 1.0, 1.0, "low_tamil_fraction"), ("அஆஇ", 1.0, None, "low_or_missing_alignment"), ("அஆஇ", 1.0, 0.5, None), ("அஆஇ", 3.0, 0.6, None),
    ]
    df = spark.createDataFrame(data, "text string, duration double, alignment_score double, want string").withColumn("dataset", F.lit("d"))
    got = df.withColumn("reject_reason", quality.reject_reason(t))
    assert got.where("not (reject_reason <=> want)").count() == 0
    assert quality.accepted(got).count() == 2 and dict((r[1], r[2]) for r in quality.reject_counts(got).collect())["empty_or_short_text"] == 2
    assert rows(quality.without_survivors(df, df.limit(0)), "dataset") == [("d",)]


def test_base_error(spark):
    df = spark.createDataFrame([(0.1,), (0.5,)], "base_wer double")
    assert quality.under_base_error(df, 0.5).count() == 1
    for bad in ([(None,)], [(1.5,)], [(0.9,)]):
        with pytest.raises(ValueError):
            quality.under_base_error(spark.createDataFrame(bad, "base_wer double"), 0.5)


def record(i, split_="train", dataset="a", fp=None, speaker="", source="train"):
    return (f"id{i}", dataset, split_, source, fp or f"fp{i}", speaker, i)


SCHEMA = "id string, dataset string, split string, source_split string, text_fingerprint string, speaker_id string, ord int"


def test_assign(spark):
    df = spark.createDataFrame([record(i, "", source=s) for i, s in enumerate(["Validation", "valid", "DEV", "test", "train", "train"])] + [record(9, "", "only", source="other")], SCHEMA)
    got = dict(rows(split.assign(df, 0.0, 0.0, official_only={"only": True}), "id", "split"))
    assert [got[f"id{i}"] for i in (0, 1, 2, 3, 4, 9)] == ["validation"] * 3 + ["test", "train", "train"]
    assert set(dict(rows(split.assign(df, 0.5, 0.49, seed=1), "id", "split")).values()) <= {"train", "validation", "test"}
    same = split.assign(spark.createDataFrame([record(i, "", speaker="s") for i in range(20)], SCHEMA), 0.3, 0.3)
    assert same.select("split").distinct().count() == 1
    with pytest.raises(ValueError):
        split.assign(df, 0.6, 0.4)


def test_leakage(spark):
    data = [
        record(0, "test", fp="t"), record(1, "test", speaker="s"), record(2, "validation", "b", fp="t"), record(3, "validation", speaker="s"), record(4, "validation", "b", speaker="s"),
        record(5, "validation", fp="v"), record(6, "train", "c", fp="t"), record(7, "train", fp="v", speaker="s"), record(8, "train", "b", speaker="s"), record(9, "train"), record(9, "train"), record(10, "train", fp="fp3"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r[0]: r[1] for r in split.leakage_reasons(df, ["ord"]).where("id <> 'id9'").select("id", "drop_reason").collect()}
    assert got["id2"] == "validation_removed_test_text_overlap" and got["id3"] == "validation_removed_test_speaker_overlap" and got["id4"] is None
    assert got["id6"] == got["id7"] == "train_removed_eval_text_overlap" and got["id8"] == "train_removed_eval_speaker_overlap" and got["id10"] is None
    kept = split.prune(df, ["ord"])
    assert kept.where("id = 'id9'").count() == 1 and contracts.leakage_violations(kept).isEmpty()
    assert dict(rows(split.prune_statistics(df, ["ord"]), "drop_reason", "rows"))["duplicate_record_id"] == 1
    with pytest.raises(contracts.ContractError):
        contracts.check(contracts.leakage_violations(df), "leaks")


def test_dedup(spark):
    data = [("a", "x", "train", "f1"), ("b", "x", "test", "f1"), ("c", "y", "train", "f1"), ("d", "y", "train", "f2"), ("e", "z", "train", "f3")]
    df = spark.createDataFrame(data, "id string, identity string, split string, text_fingerprint string")
    got = dict(rows(dedup.resolve_identity(df), "id", "drop_reason"))
    assert got == {"a": "duplicate_audio_removed", "b": None, "c": "conflicting_transcripts_same_audio_removed", "d": "conflicting_transcripts_same_audio_removed", "e": None}
    first = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 3, "c")], "id string, ord int, v string")
    assert rows(dedup.keep_first(first, ["id"], ["ord"]), "id", "ord", "v") == [("k", 1, "a"), ("l", 3, "c")]
    audited = dedup.audio_identity(spark.createDataFrame([("p", "s"), ("", "s")], "audio_pcm_sha1 string, audio_sha1 string"))
    assert rows(audited, "identity") == [("p",), ("s",)]


def test_round_robin(spark):
    turns = sample.round_robin_schedule({"A": 1, "B": 3, "C": 3})
    assert turns == [("A", 1), ("B", 1), ("C", 1), ("C", 2), ("B", 2), ("C", 3), ("B", 3)]
    df = spark.createDataFrame([(f"{d}{i}", d, "train", 1800.0) for d, n in (("A", 1), ("B", 3), ("C", 3)) for i in range(n)], "id string, dataset string, split string, duration double")
    got = sample.round_robin(df, "train", max_examples=5).orderBy("position").collect()
    assert [r.dataset for r in got] == list("ABCCB") and len({r.id for r in got}) == 5
    assert sample.round_robin(df, "train", target_hours=0.6).count() == 2 and sample.round_robin(df, "test").count() == 0


def test_stratified(spark):
    assert sample.allocate({"a": 1, "b": 98, "c": 1}, 10) == {"a": 1, "b": 8, "c": 1}
    assert sample.allocate({"a": 5, "b": 5}, 3) == {"a": 1, "b": 2} or sum(sample.allocate({"a": 5, "b": 5}, 3).values()) == 3
    with pytest.raises(ValueError):
        sample.allocate({"a": 1, "b": 1}, 1)
    df = spark.createDataFrame([(f"{i:03}", "Dev" if i % 2 else "dev") for i in range(10)], "id string, source_split string")
    assert [r[0] for r in sample.stratified(df, 3).orderBy("pick").select("id").collect()] == ["000", "004", "009"]


def test_batches(spark):
    df = spark.createDataFrame([(f"i{i}", float(s), i) for i, s in enumerate([5, 3, 4, 4, 9, 1])], "id string, duration double, ord int")
    got = batch.greedy_batches(df, ["ord"], 8.0 + 1, 2, bucket_size=4)
    assert rows(got, "bucket", "batch", "place", "duration") == [(0, 0, 0, 3.0), (0, 0, 1, 4.0), (0, 1, 0, 4.0), (0, 1, 1, 5.0), (1, 0, 0, 1.0), (1, 1, 0, 9.0)]
    with pytest.raises(contracts.ContractError):
        batch.greedy_batches(df, ["ord"], 8.0, 2)
    shuffled = batch.greedy_batches(df, ["ord"], 10.0, 3, 4, seed=1)
    assert shuffled.count() == 6 and shuffled.groupBy("bucket", "batch").agg(F.sum("duration").alias("s")).where("s > 10").isEmpty()


def test_blocks(spark):
    docs = [(0, list(range(10, 15))), (1, []), (2, list(range(20, 23))), (3, [30] * 9)]
    stream = [t for _, d in docs if d for t in [*d, 0]]
    got = pack.pack_blocks(spark.createDataFrame(docs, "i int, ids array<int>").repartition(3), "ids", 0, 4, ["i"]).orderBy("block_id").collect()
    assert [r.tokens for r in got] == [stream[k:k + 4] for k in range(0, len(stream) - 3, 4)]


def test_profiles(spark):
    df = spark.createDataFrame([("a", "d", "train", "x", 3600.0, "f1", "s"), ("b", "d", "test", "y", 1800.0, "f2", "")], "id string, dataset string, split string, domain string, duration double, text_fingerprint string, speaker_id string")
    assert rows(profile.by_dataset_and_split(df), "dataset", "split", "examples", "hours") == [("d", "test", 1, 0.5), ("d", "train", 1, 1.0)]
    assert rows(profile.leakage_audit(df), "split", "unique_text_fingerprints", "unique_scoped_speakers") == [("test", 2, 1), ("train", 2, 1)]
    summary = rows(profile.manifest_summary(df, ("dataset", "domain")), "dimension", "value", "examples")
    assert summary == [("all", "all", 2), ("dataset", "d", 2), ("domain", "x", 1), ("domain", "y", 1)]
    for n in (1, 2, 20, 300):
        got = spark.range(n).withColumn("x", F.col("id").cast("double")).agg(profile.percentile("x", 0.95)).first()[0]
        assert got == max(0, -(-95 * n // 100) - 1)
    assert spark.range(0).withColumn("x", F.col("id").cast("double")).agg(profile.percentile("x", 0.5)).first()[0] == 0.0


def test_scores(spark):
    df = spark.createDataFrame(
        [("1", "d", "", "", "", "", 4.0, None, "a b c", "a c", False), ("2", "d", "x", "t", "", "n", 40.0, 0.9, "a b", "", True)],
        "id string, dataset string, domain string, source_split string, speaker_id string, scenario string, duration double, severity double, reference string, hypothesis string, hit_max_new_tokens boolean",
    )
    got = {(r.dimension, r.value): r for r in score.sliced_metrics(score.error_counts(df, enforce=True)).collect()}
    assert got["overall", "overall"].wer == pytest.approx(3 / 5) and got["overall", "overall"].empty_hypotheses == 1
    assert got["domain", "unknown"].examples == 1 and got["severity", "severe"].hit_max_new_tokens == 1 and ("speaker", "") not in got
    with pytest.raises(contracts.ContractError):
        score.error_counts(df.withColumn("reference", F.lit(" ")), enforce=True)


def test_contracts():
    contracts.check_recipe([0.2, 1.0], [0.5, 0.5])
    for bad in (([0.5, 0.2], [0.5, 0.5]), ([0.2], [0.5]), ([0.0], [1.0])):
        with pytest.raises(contracts.ContractError):
            contracts.check_recipe(*bad)
    with pytest.raises(contracts.ContractError):
        contracts.check_ranges({"a": 2}, {"a": (0, 1)})
    with pytest.raises(contracts.ContractError):
        contracts.check_lineage(["a", "b"], [], "b")
    assert split.step_plan([0.2, 1.0], [0.25, 0.75], 10) == [(0.2, 2), (1.0, 8)]


def test_log(spark):
    log = spark.createDataFrame([("r", 1, 3.0), ("r", 2, 2.0), ("r", 3, 2.0)], "run string, step long, loss double")
    assert rows(training_log.best_so_far(log, "step", "loss", "run"), "step", "improved") == [(1, True), (2, True), (3, False)]
    listing = spark.createDataFrame([("p/checkpoint-9", "checkpoint-9", True), ("p/checkpoint-10", "checkpoint-10", True), ("p/checkpoint-11", "checkpoint-11", False), ("p/best", "best", True)], "path string, name string, complete boolean")
    assert training_log.latest_checkpoint(listing) == "p/checkpoint-10" and training_log.latest_checkpoint(listing.where("name = 'best'")) == "p/best"
    assert rows(training_log.superseded_checkpoints(listing, 2), "path") == [("p/checkpoint-9",)]


def test_log_windows_timing(spark):
    log = spark.createDataFrame([(1, 2.0, 10, 2.0, 0.5), (2, 4.0, 30, 2.0, 1.5), (3, 1.0, 5, 1.0, 0.0)], "step long, loss double, tokens long, seconds double, wait double")
    got = training_log.log_windows(log, "step", 2, "loss", "tokens", seconds="seconds", waits=("wait",))
    assert rows(got, "window", "last_step", "token_loss", "microbatch_loss", "tokens_per_second", "wait_fraction") == [(0, 2, 3.5, 3.0, 10.0, 0.5), (1, 3, 1.0, 1.0, 5.0, 0.0)]


def test_enabled_and_embedded(spark, tmp_path):
    spark.createDataFrame([(bytearray(b"x"), "some text", 2.0)], "audio binary, text string, duration double").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("x.wav", "some text", 2.0)], "audio string, text string, duration double").write.parquet(str(tmp_path / "b"))
    make = lambda name, **more: scan.DatasetConfig(name, f"file:{tmp_path}", {"train": [f"{name}/*.parquet"]}, ["audio"], ["text"], ["duration"], **more)
    assert rows(scan.scan_enabled(spark, [make("b", enabled=False), make("a")]), "dataset") == [("a",)]
    with pytest.raises(ValueError, match="path-only"):
        scan.scan(spark, make("b"))
    with pytest.raises(ValueError, match="enabled"):
        scan.scan_enabled(spark, [make("a", enabled=False)])


def test_scan_and_round_trip(spark, tmp_path):
    root = tmp_path / "corpus"
    data = [(bytearray(b"x"), "தமிழ் மொழி " * 3, "2.5", "s1"), (bytearray(b"y"), None, "3", "s2")]
    spark.createDataFrame(data, "audio binary, sentence string, seconds string, who string").coalesce(1).write.parquet(str(root / "train"))
    spark.createDataFrame([(bytearray(b"z"), "தமிழ் நாடு", 2.0)], "audio binary, text string, duration double").coalesce(1).write.parquet(str(root / "test"))
    cfg = scan.DatasetConfig(
        "ds", f"file:{root}", {"train": ["train/*.parquet"], "test": ["test/*.parquet"]}, ["audio"], ["text", "sentence"], ["duration", "seconds"], speaker_columns=["who"],
        thresholds=quality.Thresholds(min_text_chars=5, min_chars_per_second=1),
    )
    got = scan.scan(spark, cfg)
    assert rows(got, "source_split", "speaker_id", "reject_reason") == sorted([("test", "", None), ("train", "s1", None), ("train", "s2", "empty_or_short_text")], key=lambda r: r[:2])
    assert got.where("source_split = 'test'").first().id.startswith("ds:test/part-")
    assert scan.inspect(spark, scan.DatasetConfig("ds", f"file:{root}", {"t": ["test/*.parquet"]}, ["audio"], ["text"], ["duration"]))["profile"]["fraction_ge_95"] == 1
    with pytest.raises(ValueError, match="more than one split"):
        discover.discover(spark, f"file:{root}", {"a": ["test/*"], "b": ["test/*.parquet"]})
    with pytest.raises(FileNotFoundError):
        scan.scan(spark, scan.DatasetConfig("ds", f"file:{root}", {"t": ["none/*"]}, ["audio"], ["text"], ["duration"]))
    out = f"file:{tmp_path}/manifest"
    kept = quality.accepted(got).withColumn("split", F.lit("train"))
    assert sinks.write_jsonl(kept, out) == 2 and sinks.write_jsonl(kept, out) == 2
    back = manifest.load_manifest(spark, out, "train")
    assert back.count() == 2 and back.columns == MANIFEST.fieldNames() and back.first().channels == 0
    with pytest.raises(contracts.ContractError):
        manifest.load_manifest(spark, out, "test")
    with pytest.raises(ValueError):
        bind_manifest(kept.drop("duration"))
    ids = tmp_path / "ids.jsonl"
    names = [r.id for r in back.collect()]
    ids.write_text(json.dumps(names[1]) + "\n\n" + json.dumps({"id": names[0]}) + "\n")
    assert [r.id for r in manifest.pick_ids(back, manifest.read_id_list(spark, f"file:{ids}")).collect()] == names[::-1]
    ids.write_text('"nobody"\n')
    with pytest.raises(contracts.ContractError):
        manifest.pick_ids(back, manifest.read_id_list(spark, f"file:{ids}"))
    sinks.append_metrics(spark, 1, "train", {"loss": 2}, f"file:{tmp_path}/log")
    sinks.write_report(spark, {"a": 1}, f"file:{tmp_path}/report.json")
    assert json.loads((tmp_path / "report.json").read_text()) == {"a": 1}
    sinks.write_splits(kept, f"file:{tmp_path}/splits")
    assert spark.read.json(f"file:{tmp_path}/splits/split=train").count() == 2


def test_streaming(spark, tmp_path):
    from quern.streaming.ingest import ingest_manifest, windowed_metrics

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"text": "short", "duration": 1.0, "alignment_score": 1.0}\n{"text": "தமிழ் மொழி தமிழ் மொழி", "duration": 2.0, "alignment_score": 1.0}\n')
    schema = spark.createDataFrame([], "text string, duration double, alignment_score double").schema
    ingest_manifest(spark, f"file:{source}", schema, f"file:{tmp_path}/out", f"file:{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"file:{tmp_path}/out"), "accepted") == [('false',), ('true',)]
    events = spark.createDataFrame([("k", 0, 1.0), ("k", 10, 2.0), ("k", 4000, 4.0)], "event_type string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(windowed_metrics(events, "ts", "value"), "rows", "total") == [(1, 4.0), (2, 3.0)]
