"""Preparation of manifests from corpora: scan, split, leakage removal, audit of audio, deduplication, sinks and the report."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import sinks
from quern.operators import profile, quality, sample, split
from quern.operators.audit import audit_manifest
from quern.operators.contracts import check, leakage_violations
from quern.sources.scan import DatasetConfig, inspect, scan
from quern.storage import stash

ORDER = ["parquet_path", "row_group", "row_in_group"]


def prepare_manifests(
    spark: SparkSession, configs: list[DatasetConfig], out: str, validation_fraction: float = 0.01, test_fraction: float = 0.01, seed: int = 42,
    audio_audit: str = "all", smoke_train_hours: float = 1.0, smoke_validation_examples: int = 256,
) -> dict:
    """Write ``train``, ``validation``, ``test`` (JSON lines under ``out``/splits by split), ``smoke_train``, ``smoke_validation`` and
    ``audit_report.json``; returns the report.

    ``audio_audit``: ``none``, ``smoke`` (only the smoke subsets, which are then all that is kept) or ``all``. A dataset of which the scan or the
    audit leaves no row is an error, and so are a leak between splits and an empty smoke subset. What reaches the driver are counts by reason, by
    dataset and by kind, and eight examples a dataset.
    """
    if audio_audit not in ("none", "smoke", "all"):
        raise ValueError("audio_audit must be none, smoke or all")
    enabled = sorted((c for c in configs if c.enabled), key=lambda c: c.name)
    if not enabled:
        raise ValueError("no dataset is enabled")
    schemas = {c.name: inspect(spark, c) for c in enabled}
    scanned = stash(reduce(lambda a, b: a.unionByName(b), [scan(spark, c) for c in enabled]), "scanned")
    reasons: Counter[str] = Counter({f"{r['dataset']}:{r['reason']}": r["rows"] for r in quality.reject_counts(scanned).collect()})
    rows = quality.accepted(scanned)
    names = spark.createDataFrame([(c.name,) for c in enabled], "dataset string")
    _none_gone(names, rows, "metadata filters accepted no row of")

    official = {c.name: c.use_official_eval_only for c in enabled}
    judged = stash(split.leakage_reasons(split.assign(rows, validation_fraction, test_fraction, seed, official), ORDER), "judged")
    reasons.update({r["drop_reason"]: r["n"] for r in judged.where("drop_reason is not null").groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n")).collect()})
    kept = judged.where("drop_reason is null").drop("drop_reason")

    smoke = lambda rows: (
        sample.round_robin(rows, "train", target_hours=smoke_train_hours, seed=seed, order=ORDER), sample.round_robin(rows, "validation", smoke_validation_examples, seed=seed, order=ORDER),
    )
    audio: dict = {"status": "not_run"}
    if audio_audit != "none":
        found = audit_manifest(kept if audio_audit == "all" else reduce(DataFrame.unionByName, smoke(kept)).drop("position"))
        kept = found.rows
        reasons.update(found.rejected)
        audio = found.histograms | {"decoded_hours": found.decoded_hours}
        _none_gone(names, kept, "the audit removed every row of")
    else:
        check(leakage_violations(kept), "leakage")
    kept = stash(kept, "kept")
    overall = {r["split"]: r.asDict() for r in profile.leakage_audit(kept, enforce=False).collect()}

    from quern.schema import bind_manifest

    sinks.write_splits(bind_manifest(kept), f"{out}/splits")
    train, validation = (stash(s.orderBy("position"), "smoke") for s in smoke(kept))
    counts = {}
    for name, rows_ in (("train", train), ("validation", validation)):
        counts[f"{name}_examples"] = sinks.write_jsonl(bind_manifest(rows_), f"{out}/smoke_{name}")
        if not counts[f"{name}_examples"]:
            raise ValueError(f"no smoke {name} row was selected")
        counts[f"{name}_hours"] = rows_.agg(profile.hours()).first()[0]
    texts = {r["dataset"]: {"counts": r.asDict()} for r in profile.text_profile(kept).collect()}
    for r in profile.text_examples(kept, ORDER).orderBy("dataset", "rank").collect():
        texts[r["dataset"]].setdefault("examples", []).append({k: v for k, v in r.asDict().items() if k not in ("dataset", "rank")})
    report = {
        "audio_audit": audio_audit, "overall": overall, "by_dataset": [r.asDict() for r in profile.by_dataset_and_split(kept).orderBy("dataset", "split").collect()],
        "rejections": dict(reasons), "audio_profile": audio, "schema_profiles": schemas, "text_profile": texts, "smoke": counts,
    }
    sinks.write_report(spark, report, f"{out}/audit_report.json")
    return report


def _none_gone(names: DataFrame, rows: DataFrame, what: str) -> None:
    gone = [r[0] for r in quality.without_survivors(names, rows).orderBy("dataset").collect()]
    if gone:
        raise ValueError(f"{what} {gone}")
