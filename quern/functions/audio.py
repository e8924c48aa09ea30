"""Audio cells: payload extraction, decoding by pluggable codecs, signal measurements."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT = (
    "sha1 string, pcm_sha1 string, format string, subtype string, original_sample_rate int, channels int, frames long, duration double, "
    "peak double, rms double, dc_offset double, clipped_fraction double, nonfinite_count long"
)
OUTCOME = f"error string, audit struct<{AUDIT.replace(' ', ':').replace(',:', ',')}>"


class Decoded(NamedTuple):
    waveform: np.ndarray  # frames x channels, float32
    rate: int
    format: str
    subtype: str


def _ulaw() -> np.ndarray:
    """Levels of mu-law bytes: sign, three bits of a segment, four of a step in it."""
    code = 255 - np.arange(256)
    level = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return (np.where(code & 128, -level, level) / 32768).astype(np.float32)


def _alaw() -> np.ndarray:
    """Levels of A-law bytes, whose even bits are inverted."""
    code = np.arange(256) ^ 0x55
    segment, step = (code >> 4) & 7, ((code & 15) << 4) + 8
    level = np.where(segment > 0, step + 256 << np.maximum(segment - 1, 0), step)
    return (np.where(code & 128, level, -level) / 32768).astype(np.float32)


def _pcm(data: bytes, width: int) -> np.ndarray:
    if width == 1:
        return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    if width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    return np.frombuffer(data, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))


#: Fixed values of the format: kinds of samples by tag and bits, with the names that they go by.
_SAMPLES = {(1, 8): "PCM_U8", (1, 16): "PCM_16", (1, 24): "PCM_24", (1, 32): "PCM_32", (3, 32): "FLOAT", (3, 64): "DOUBLE", (6, 8): "ALAW", (7, 8): "ULAW"}
_EXTENSIBLE = 0xFFFE


def decode_wav(payload: bytes) -> Decoded:
    """WAV with PCM, float, A-law or mu-law samples, plain or extensible. A data chunk that is cut short gives the frames that are there."""
    if payload[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head, data = 12, None, None
    while at + 8 <= len(payload) and data is None:
        name, size = payload[at:at + 4], int.from_bytes(payload[at + 4:at + 8], "little")
        if name == b"fmt ":
            head = payload[at + 8:at + 8 + size]
        elif name == b"data":
            data = payload[at + 8:at + 8 + size]
        at += 8 + size + size % 2
    if head is None or len(head) < 16 or data is None:
        raise ValueError("WAV file without a format or data")
    tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head[:16])
    wide = tag == _EXTENSIBLE and len(head) >= 26
    if wide:
        tag = int.from_bytes(head[24:26], "little")
    subtype = _SAMPLES.get((tag, bits))
    if not subtype or not channels or not rate:
        raise ValueError(f"unsupported WAV samples: tag {tag}, {bits} bits")
    data = data[:len(data) // (channels * bits // 8) * (channels * bits // 8)]
    if tag == 1:
        x = _pcm(data, bits // 8)
    elif tag == 3:
        x = np.frombuffer(data, f"<f{bits // 8}").astype(np.float32)
    else:
        x = (_alaw() if tag == 6 else _ulaw())[np.frombuffer(data, np.uint8)]
    return Decoded(x.reshape(-1, channels), rate, "WAVEX" if wide else "WAV", subtype)


#: Codecs by the first bytes that they read.
CODECS: list[tuple[bytes, Callable[[bytes], Decoded]]] = [(b"RIFF", decode_wav)]


def decode(payload: bytes) -> Decoded:
    for magic, codec in CODECS:
        if payload.startswith(magic):
            return codec(payload)
    raise ValueError("no codec: " + payload[:4].hex())


#: Zero crossings of the sinc on either side, and the shape of its Kaiser window (about 100 dB).
CROSSINGS, BETA = 48, 10.0
#: Outputs of one phase that are worked out together.
RESAMPLE_BLOCK = 1 << 14


def filter_bank(up: int, down: int) -> np.ndarray:
    """Taps by phase of a band-limited resampler by ``up / down``: row p holds those of outputs that lie p / up after an input.

    A windowed sinc that ends its transition at the lower of the two Nyquist frequencies; each row sums to 1.
    """
    scale = min(1.0, up / down)
    half = int(np.ceil(CROSSINGS / scale))
    width = (BETA / 0.1102 + 8.7 - 7.95) / (14.36 * 2 * CROSSINGS)  # half the transition that the window allows, in Nyquist frequencies
    cutoff = scale * (1 - width)
    at = np.arange(-half + 1, half + 1)[None, :] - (np.arange(up) / up)[:, None]
    shape = np.i0(BETA * np.sqrt(np.maximum(0, 1 - (at / half) ** 2))) / np.i0(BETA)
    taps = cutoff * np.sinc(cutoff * at) * shape
    return taps / taps.sum(1, keepdims=True)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """The samples at another rate: ceil(n * target / rate) of them, the first at the same moment, without what the new rate can't hold."""
    shared = math.gcd(rate, target)
    up, down = target // shared, rate // shared
    if up == down or not len(x):
        return x.astype(np.float32)
    bank = filter_bank(up, down)
    half = bank.shape[1] // 2
    n = -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(half - 1, np.float64), x, np.zeros(half + 1, np.float64)))
    out = np.empty(n, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, bank.shape[1])
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        phase, start = first * down % up, first * down // up
        for k in range(first, n, up * RESAMPLE_BLOCK):
            m = min(RESAMPLE_BLOCK, -(-(n - k) // up))
            at = start + (k - first) // up * down
            out[k:k + m * up:up] = windows[at:at + (m - 1) * down + 1:down] @ bank[phase]
    return out


def mono(decoded: Decoded, rate: int | None = None) -> np.ndarray:
    """Mean of the channels, resampled where another rate is asked for."""
    x = decoded.waveform.mean(axis=1, dtype=np.float32)
    return resample(x, decoded.rate, rate) if rate and rate != decoded.rate else x


def audit(payload: bytes) -> dict:
    """Measurements of one payload, in the fields of AUDIT."""
    got = decode(payload)
    x = mono(got)
    if not len(x):
        raise ValueError("empty audio")
    bad = int((~np.isfinite(x)).sum())
    nan = math.nan
    level = np.abs(x)
    return {
        "sha1": hashlib.sha1(payload).hexdigest(), "pcm_sha1": hashlib.sha1(f"{got.rate}:".encode() + x.astype("<f4").tobytes()).hexdigest(),
        "format": got.format, "subtype": got.subtype, "original_sample_rate": got.rate, "channels": got.waveform.shape[1],
        "frames": len(x), "duration": len(x) / got.rate, "peak": nan if bad else float(level.max()),
        "rms": nan if bad else float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))), "dc_offset": nan if bad else float(np.mean(x, dtype=np.float64)),
        "clipped_fraction": nan if bad else float(np.mean(level >= 0.999)), "nonfinite_count": bad,
    }


def _outcomes(payloads: pd.Series) -> pd.DataFrame:
    errors, audits = [], []
    for payload in payloads:
        try:
            if payload is None:
                raise ValueError("no payload")
            audits.append(audit(bytes(payload)))
            errors.append(None)
        except Exception as error:  # every kind is counted by its name and the first part of its message
            audits.append(None)
            errors.append(type(error).__name__ + ":" + str(error).split(":", 1)[0])
    return pd.DataFrame({"error": errors, "audit": audits})


def audit_column(payload: Column) -> Column:
    """Struct of ``error`` and ``audit``, one of them null."""
    return F.pandas_udf(_outcomes, OUTCOME)(payload)


def payload_of(column: str, kind: T.DataType, allow_paths: bool = False) -> Column:
    """Bytes of an audio cell. A cell with a path and no bytes is an error unless paths are allowed, then it is null."""
    if not isinstance(kind, T.StructType):
        return F.col(column)
    stale = F.lit(None) if allow_paths else F.raise_error(F.lit(f"{column} has a path but no embedded bytes"))
    return F.coalesce(F.col(column)["bytes"], F.when(F.col(column).isNotNull(), stale.cast("binary")))


def check_duration(stated: float | None, decoded: float) -> None:
    """within_tolerance() for one row: an error where the two differ by more."""
    if stated is None or abs(stated - decoded) > max(0.25, 0.02 * max(stated, decoded)):
        raise ValueError(f"Duration mismatch: metadata={stated} decoded={decoded:.3f}s")


def within_tolerance(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(0.25), 0.02 * F.greatest(a, b))


def format_label(kind: Column, subtype: Column) -> Column:
    return F.regexp_replace(F.concat(kind, F.lit("/"), subtype), "^/+|/+$", "")
