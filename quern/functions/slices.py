"""Slice labels of evaluation rows. Labels are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import TAMIL, ladder, strip


def script_slice(text: Column, low: int = TAMIL[0], high: int = TAMIL[1], name: str = "tamil") -> Column:
    script, latin = text.rlike(rf"[\x{{{low:x}}}-\x{{{high:x}}}]"), text.rlike("[A-Za-z]")
    return F.when(script & latin, f"{name}_latin_code_switch").when(script, f"{name}_script").when(latin, "latin_script").otherwise("other_script")


def duration_slice(seconds: Column) -> Column:
    return ladder(seconds, (5.0, "under_5s"), (15.0, "5_to_15s"), (30.0, "15_to_30s"), last="30s_and_over")


def severity_slice(scenario: Column, severity: Column) -> Column:
    """Thirds with inclusive upper bounds; a severity outside 0..1 is an error."""
    wrong = F.raise_error(F.concat(F.lit("severity must be in [0, 1], found "), severity.cast("string"))).cast("string")
    targeted = F.coalesce(scenario, F.lit("")) != ""
    return (
        F.when(severity.isNull() & ~targeted, "not_targeted").when(severity.isNull(), "targeted_unspecified")
        .when((severity < 0) | (severity > 1) | F.isnan(severity), wrong)
        .when(severity <= 1.0 / 3.0, "mild").when(severity <= 2.0 / 3.0, "moderate").otherwise("severe")
    )


def evaluation_slices() -> Column:
    """Array of (dimension, value): seven dimensions, and the speaker where there is one. Blank labels are "unknown"."""
    named = lambda c: F.coalesce(F.nullif(strip(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("")), F.lit("unknown"))
    scenario = strip(F.coalesce(F.col("scenario"), F.lit("")))
    speaker = strip(F.coalesce(F.col("speaker_id"), F.lit("")))
    pairs = {
        "dataset": named("dataset"), "domain": named("domain"), "source_split": named("source_split"),
        "script": script_slice(F.coalesce(F.col("reference"), F.lit(""))), "duration": duration_slice(F.coalesce(F.col("duration"), F.lit(0.0))),
        "scenario": F.coalesce(F.nullif(scenario, F.lit("")), F.lit("not_targeted")), "severity": severity_slice(scenario, F.col("severity")),
    }
    every = [F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in pairs.items()]
    own = F.when(speaker != "", F.struct(F.lit("speaker").alias("dimension"), speaker.alias("value")))
    return F.filter(F.array(*every, own), lambda x: x.isNotNull())
