"""Audit of the audio of a whole manifest: every payload read and measured once, where it is; errors are values."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import audio as A
from quern.operators import dedup, profile
from quern.operators.contracts import check, dedup_violations, leakage_violations
from quern.sources.fetch import map_cells
from quern.storage import stash

_FIELDS = [f.split()[0] for f in A.AUDIT.split(", ")]


def _measure(row: dict, payload: bytes, minimum_rms: float) -> tuple:
    got = A.audit(payload)
    A.check_duration(row["duration"], got["duration"])
    if got["nonfinite_count"]:
        raise ValueError("non-finite decoded samples")
    if got["rms"] < minimum_rms:
        raise ValueError("near-silent audio")
    return ({f: got[f] for f in _FIELDS},)


def audit_rows(rows: DataFrame, minimum_rms: float = 1e-5, partitions: int | None = None) -> DataFrame:
    """The rows with ``audit`` (fields of functions.audio.AUDIT) and ``error``, one of them null. Bytes stay in the task that reads them."""
    fields = "audit struct<" + A.AUDIT.replace(" ", ":").replace(",:", ",") + ">"
    return map_cells(rows, partial(_measure, minimum_rms=minimum_rms), fields, None, partitions)


def accepted(audited: DataFrame) -> DataFrame:
    """Manifest rows whose audit succeeded, with its results in their columns."""
    a = lambda f: F.col(f"audit.{f}")
    return audited.where("error is null").withColumns({
        "audio_sha1": a("sha1"), "audio_pcm_sha1": a("pcm_sha1"), "audio_format": A.format_label(a("format"), a("subtype")), "sample_rate": a("original_sample_rate"),
        "channels": a("channels"), "decoded_duration": a("duration"),
    }).drop("audit", "error")


@dataclass
class Audit:
    """Rows that stay, a count for each reason of those that don't, and the histograms of accepted audits."""

    rows: DataFrame
    rejected: dict[str, int]
    histograms: dict[str, dict[str, int]]
    decoded_hours: float


def audit_manifest(rows: DataFrame, minimum_rms: float = 1e-5, partitions: int | None = None) -> Audit:
    """Audit every row, drop failures and duplicates of audio, and refuse what leaks between splits.

    Payloads are read once: the outcome of each row is written out, and all that follows works on it. Histograms are of audits that succeeded,
    before duplicates go. Reasons: ``audio_decode_or_validation:`` and the kind of error, and those of operators.dedup.
    """
    audited = stash(audit_rows(rows, minimum_rms, partitions), "audited")
    counts = profile.audio_histograms(audited, minimum_rms).collect()  # bounded by kinds of errors, formats, rates and channels
    histograms: dict[str, dict[str, int]] = {"format": {}, "sample_rate": {}, "channels": {}, "signal": {}, "rejected": {}}
    for r in counts:
        histograms[r["dimension"]][r["value"]] = r["rows"]
    rejected = histograms.pop("rejected")
    good = accepted(audited)
    check(dedup_violations(good), "audio deduplication")
    seconds = good.agg(F.sum("decoded_duration")).first()[0] or 0.0
    judged = stash(dedup.resolve_identity(dedup.audio_identity(good)).drop("identity"), "identities")
    rejected |= {r["drop_reason"]: r["n"] for r in judged.where("drop_reason is not null").groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = judged.where("drop_reason is null").drop("drop_reason")
    check(leakage_violations(kept), "leakage")
    return Audit(kept, rejected, histograms, round(seconds / 3600, 4))
