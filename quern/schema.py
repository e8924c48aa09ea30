"""Row types: speech manifest, evaluation rows, text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(fields: str) -> T.StructType:
    """A struct from "name type" pairs, without the session that Spark's own parser needs."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


MANIFEST = _struct(
    "id string, dataset string, split string, source_split string, parquet_path string, row_group int, row_in_group int, "
    "audio_column string, text_column string, text string, duration double, text_fingerprint string, speaker_id string, domain string, "
    "alignment_score double, audio_sha1 string, audio_pcm_sha1 string, audio_format string, sample_rate int, channels int, "
    "decoded_duration double, text_variants map<string,string>, base_prediction string, base_wer double, scenario string, severity double"
)
#: Fields that a manifest row must bring along; the others have defaults.
REQUIRED = MANIFEST.fieldNames()[:12]
#: Defaults of the optional fields; fields that aren't named are null by default.
DEFAULTS = {
    "speaker_id": "", "domain": "", "audio_sha1": "", "audio_pcm_sha1": "", "audio_format": "", "sample_rate": 0, "channels": 0,
    "decoded_duration": 0.0, "base_prediction": "", "scenario": "",
}
EVALUATION = _struct(
    "id string, dataset string, source_split string, domain string, speaker_id string, duration double, base_wer double, scenario string, "
    "severity double, reference string, hypothesis string, generated_tokens int, hit_max_new_tokens boolean"
)
TEXT = _struct("doc_id string, text string")

SPLITS = ("train", "validation", "test")


def _default(field: T.StructField) -> Column:
    if field.name == "text_variants":
        return F.create_map().cast(field.dataType)
    return F.lit(DEFAULTS.get(field.name)).cast(field.dataType)


def bind_manifest(df: DataFrame) -> DataFrame:
    """Rows as manifest rows: unknown columns go, missing or null optional ones take their default, types are cast.

    A required column that the table lacks is an error; a null in one is left for the contracts to find.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"manifest rows lack {missing}")
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in REQUIRED else F.coalesce(F.col(f.name).cast(f.dataType), _default(f)) if f.name in df.columns else _default(f)).alias(f.name)
        for f in MANIFEST
    ])
