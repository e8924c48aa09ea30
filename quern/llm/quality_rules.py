"""Quality rules: base counts of every text and a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed into buckets. Two multinomials are estimated, one over the whole corpus and one over its
trusted part (rows labelled good and not toxic); a text's ratio is the sum of log(trusted / corpus) over its n-grams
divided by their number.

The number of buckets follows the size of the corpus at every size, one for each BYTES_A_BUCKET bytes, so that as many n-grams meet in a bucket
of a large corpus as in one of a small. A model of over 2^SLICE_BITS buckets is counted and applied in slices, a pass over the
texts each, and the parts of a text's sum are added up. The bound is a
quantile of ratios that trusted documents have: at every size the same small share of them falls under it, and it decides every
text alike. A document's own n-grams raise its ratio where it is counted as trusted, so one trusted document in FOLDS, by a hash of its
id, isn't counted, and the quantile is that of these.

Both multinomials are counted in one pass. Whether a text is trusted is told by a bitmap of the trusted ids; what the bitmap lets through wrongly is
found by the ids alone, counted apart and taken off again, so no text is shuffled but those few. Counts are summed in each task
before the shuffle, as blocks of about a byte a bucket, then in two steps by block, so neither a task nor the driver sees more than a slice of the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACES, map_arrow, quoted, sieve, stash, text_of, words

#: Least bits of a bucket, bytes of text for each bucket beyond, bits of what is counted at a time, bits of a bucket within a block of counts.
LEAST_BITS, BYTES_A_BUCKET, SLICE_BITS, BLOCK_BITS = 16, 2048, 25, 14
#: Groups in which the blocks of many tasks are summed first, and n-grams that a task counts together.
GROUPS, HELD = 64, 1 << 20
#: Steps of the ratio's histogram in a unit.
GRAIN = 10_000
FOLDS = 5
#: Bytes hashed together, so that memory stays bounded on very long texts.
BLOCK = 1 << 20
#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = np.where(_SPACE, 0, np.arange(256) + 1).astype(np.uint32)
_POWER = ((np.arange(1, 257, dtype=np.uint64) * 0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _word_hashes(b: np.ndarray) -> np.ndarray:
    gap = _SPACE[b]
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint32)
    b = b[starts[0]:]
    starts -= starts[0]
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    return np.add.reduceat(_VALUE[b] * _POWER[place & 255], starts, dtype=np.uint32)


def ngrams(text: str | None, bits: int = LEAST_BITS) -> Iterator[np.ndarray]:
    """Buckets of the words and word pairs of a whole text, repeats included, block by block."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    last, at = np.zeros(0, np.uint32), 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if not len(gaps):  # a word longer than a block ends where the next white space is
                later = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(later[0]) if len(later) else len(data)
            else:
                end = at + int(gaps[-1]) + 1
        one = _word_hashes(data[at:end])
        at = end
        if len(one):
            both = np.concatenate((last, one))
            two = (both[:-1] * np.uint32(0x85EBCA6B)) ^ (both[1:] + np.uint32(0x27D4EB2F))
            last = one[-1:]
            found = np.concatenate((one, two))
            yield ((found * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    found = words(text)
    n = len(found)
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, n)
    repeated = 0
    if n >= 3:
        pair = np.unique(word[:-1] * len(ids) + word[1:], return_inverse=True)[1]
        _, which, count = np.unique(pair[:-1].astype(np.int64) * len(ids) + word[2:], return_inverse=True, return_counts=True)
        again = count[which] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k:n - 2 + k] |= again
        repeated = int(covered.sum())
    seen: set[str] = set()
    copies = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            copies += line in seen
            seen.add(line)
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), copies, repeated


def _pack(counts: np.ndarray) -> bytes:
    """A block of counts: how many don't fit a byte, their places and values, and a byte for each bucket."""
    over = np.flatnonzero(counts > 255)
    low = np.minimum(counts, 255).astype(np.uint8)
    return np.array([len(over)], "<u4").tobytes() + over.astype("<u2").tobytes() + counts[over].astype("<u8").tobytes() + low.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    counts = np.frombuffer(data, np.uint8, offset=4 + 10 * n).astype(np.int64)
    counts[np.frombuffer(data, "<u2", n, 4)] = np.frombuffer(data, "<u8", n, 4 + 2 * n).astype(np.int64)
    return counts


_COUNTS = "part int, salt int, raw binary, trusted binary"


def _blocks(found: Iterator[tuple[int, np.ndarray, np.ndarray]], salt: int) -> Iterator[pa.RecordBatch]:
    for part, raw, trusted in found:
        kinds = [pa.array([part], pa.int32()), pa.array([salt], pa.int32()), pa.array([_pack(raw)], pa.binary()), pa.array([_pack(trusted)], pa.binary())]
        yield pa.RecordBatch.from_arrays(kinds, names=["part", "salt", "raw", "trusted"])


def _count(batches: Iterator[pa.RecordBatch], bits: int, first: int, size: int) -> Iterator[pa.RecordBatch]:
    """(part, salt, raw, trusted): the counts of a task's texts and of its trusted ones in the buckets from ``first`` on, as blocks of 2^BLOCK_BITS."""
    from pyspark import TaskContext

    total = np.zeros((2, size), np.uint32)
    held: tuple[list, list] = [], []

    def add() -> None:
        for k in (0, 1):
            if held[k]:
                found = np.concatenate(held[k])
                if size < 1 << bits:
                    found = found[(found >= first) & (found < first + size)] - first
                if 4 * len(found) < size:
                    at, n = np.unique(found, return_counts=True)
                    total[k][at] += n.astype(np.uint32)
                else:
                    total[k] += np.bincount(found, minlength=size).astype(np.uint32)
                held[k].clear()

    n = 0
    for batch in batches:
        for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
            for found in ngrams(text.as_py(), bits):
                held[bool(good)].append(found)
                n += len(found)
            if n >= HELD:
                add()
                n = 0
    add()
    total[0] += total[1]  # the corpus has the trusted texts too
    salt, blocks = TaskContext.get().partitionId() % GROUPS, total.reshape(2, -1, 1 << BLOCK_BITS)
    yield from _blocks((((first >> BLOCK_BITS) + i, raw, trusted) for i, (raw, trusted) in enumerate(zip(*blocks)) if raw.any()), salt)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, *both in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            block = np.stack([_unpack(c.as_py()) for c in both])
            total[part] = total[part] + block if part in total else block
    yield from _blocks(((part, *block) for part, block in total.items()), 0)


def count_ngrams(rows: DataFrame, bits: int, first: int = 0, size: int | None = None) -> DataFrame:
    """(part, salt, raw, trusted): counts of a slice of the buckets over all rows of (text, trusted), a row for each block that has any. Written out."""
    size = size or 1 << bits
    blocks = map_arrow(rows, partial(_count, bits=bits, first=first, size=size), _COUNTS)
    blocks = map_arrow(blocks.repartition("part", "salt"), _sum, _COUNTS)
    return stash(map_arrow(blocks.repartition("part"), _sum, _COUNTS), "ngrams")


def counts_of(blocks: DataFrame, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(raw, trusted) counts of a slice on the driver, block by block."""
    out = np.zeros((2, size >> BLOCK_BITS, 1 << BLOCK_BITS), np.uint32 if size > 1 << 20 else np.int64)
    for row in blocks.toLocalIterator():
        for k, data in enumerate((row.raw, row.trusted)):
            out[k, row.part - (first >> BLOCK_BITS)] += _unpack(bytes(data)).astype(out.dtype)
    return out[0].ravel(), out[1].ravel()


def bits_for(n_bytes: int) -> int:
    """Bits of a bucket for a corpus of so many bytes."""
    return max((n_bytes // BYTES_A_BUCKET).bit_length(), LEAST_BITS)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(good, measured): the ids that all labels call good and none toxic, and whether they serve to set the bound."""
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("good")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return told.where("q = 1 and coalesce(t, 0) = 0").select("good", (F.pmod(F.xxhash64("good"), F.lit(FOLDS)) == 0).alias("measured"))


def flagged(docs: DataFrame, good: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((text, trusted) of all rows, (text, trusted) of those wrongly trusted or None): who is trusted by a bitmap of ``good``, and what it lets through besides.

    Only ids are shuffled to find the latter, and then only the texts that a bitmap of their ids lets through.
    """
    rows = sieve(docs.withColumn("x", F.xxhash64("doc_id")), "x", good.select(F.xxhash64("good").alias("x"))).withColumnRenamed("maybe", "trusted")
    wrong = stash(rows.where("trusted").select("doc_id").distinct().join(good, F.col("doc_id").eqNullSafe(F.col("good")), "left_anti"), "wrong")
    if wrong.isEmpty():
        return rows.select("text", "trusted"), None
    again = sieve(rows.where("trusted"), "x", wrong.select(F.xxhash64("doc_id").alias("x"))).where("maybe").drop("maybe")
    again = again.join(wrong.withColumnRenamed("doc_id", "w"), F.col("doc_id").eqNullSafe(F.col("w")), "left_semi")
    return rows.select("text", "trusted"), again.select("text", "trusted")


def fit_ratio(docs: DataFrame, good: DataFrame, smooth: float = 1.0) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bits, first bucket, log(trusted / corpus) of the buckets from it on) for each slice of the model, from counts over all rows of ``docs`` (doc_id, text).

    Without trusted rows all are 0, in one slice.
    """
    bits = bits_for(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    if good.isEmpty():
        yield LEAST_BITS, 0, np.zeros(1 << LEAST_BITS, np.float32)
        return
    rows, wrong = flagged(docs, good)
    size = 1 << min(bits, SLICE_BITS)
    slices = [(first, count_ngrams(rows, bits, first, size), count_ngrams(wrong, bits, first, size) if wrong is not None else None) for first in range(0, 1 << bits, size)]

    def counts(first: int, all_: DataFrame, off: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
        raw, trusted = counts_of(all_, first, size)
        return raw, trusted if off is None else trusted - counts_of(off, first, size)[1]

    found = [counts(*slices[0])] if len(slices) == 1 else (counts(*s) for s in slices)
    sums = [tuple(float(c.sum(dtype=np.int64)) for c in both) for both in found]
    n_raw, n_trusted = (sum(x) + smooth * (1 << bits) for x in zip(*sums))
    for s in slices:
        raw, trusted = found[0] if len(slices) == 1 else counts(*s)
        yield bits, s[0], np.log((trusted + smooth) / (raw + smooth)).astype(np.float32) + np.float32(math.log(n_raw / n_trusted))


def log_ratio(text: str | None, ratio: np.ndarray, bits: int | None = None, first: int = 0) -> float:
    """Mean log-likelihood ratio of the n-grams of a text, 0 if it has none; the part of it that a slice of the model gives."""
    total, n, bits = 0.0, 0, bits or len(ratio).bit_length() - 1
    for found in ngrams(text, bits):
        n += len(found)
        if len(ratio) < 1 << bits:
            found = found[(found >= first) & (found < first + len(ratio))] - first
        total += float(ratio[found].sum(dtype=np.float64))
    return total / n if n else 0.0


def _judge(batches: Iterator[pa.RecordBatch], ratio: Broadcast, bits: int, first: int) -> Iterator[pa.RecordBatch]:
    names = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr"]
    ratio = ratio.value
    for batch in batches:
        rows = []
        for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py()
            base = base_counts(text) if not first else (0,) * 5  # once, with the first slice
            failed = base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED * base[0]
            rows.append((row, doc_id, *base, failed, log_ratio(text, ratio, bits, first)))
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)


def lower_quantile(scored: DataFrame, good: DataFrame, share: float) -> float:
    """The ratio, in steps of 1 / GRAIN, that at most ``share`` of the rows of these ids lie under. Rows that fail the base rules don't count."""
    told = scored.where("not base_failed").select("doc_id", F.floor(F.col("llr") * GRAIN).alias("step")).join(good, F.col("doc_id") == F.col("good"), "left_semi")
    steps = told.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy("step").collect()  # a mean of bounded logs: bounded
    under, most = 0, share * sum(r.n for r in steps)
    for r in steps:
        if under + r.n > most:
            return r.step / GRAIN
        under += r.n
    return -math.inf


def judge(docs: DataFrame, labels: DataFrame, share: float = 0.005, smooth: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, threshold, kept.

    ``threshold`` is the ratio that ``share`` of the measured trusted rows lie under, the same for all rows. Null text has no words and
    fails. Without trusted rows every ratio is 0 and the base rules decide alone. A document with contradictory labels
    isn't trusted, nor is a row without an id. Repeated rows are judged alike and count as often as they occur; an empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    good = stash(trusted_ids(labels), "good")
    schema = "row long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double"
    numbered, scored = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), None
    for bits, first, ratio in fit_ratio(rows, good.where("not measured").select("good"), smooth):
        held = docs.sparkSession.sparkContext.broadcast(ratio)  # a slice: at most 4 << SLICE_BITS bytes
        part = stash(map_arrow(numbered, partial(_judge, ratio=held, bits=bits, first=first), schema), "scored")
        more = None if scored is None else part.select("row", F.col("llr").alias("more"))
        scored = part if scored is None else stash(scored.join(more, "row").withColumn("llr", F.col("llr") + F.col("more")).drop("more"), "scored")
    scored = scored.drop("row")
    least = lower_quantile(scored, good.where("measured").select("good"), share)
    return scored.withColumn("threshold", F.lit(least)).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least))
