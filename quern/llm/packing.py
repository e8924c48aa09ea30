"""Packing of documents into fixed windows by non-negative least squares over the histogram of lengths.

A document is cut at multiples of the window; what is left has one of ``window - 1`` lengths. Combinations of two or
three lengths that fill a window exactly are enumerated, their repeat counts are solved against the histogram of
lengths by non-negative least squares, rounded, and held to what the histogram has. Residual lengths are matched
greedily where two or three of them still fill a window; the last residuals are cut at the powers of two in
their length, and such pieces, largest first, fill windows without a gap, so that at most one window is padded.

The histogram and the plan are bounded by the window, whatever the corpus; only they reach the driver. Texts are read
and encoded once, in place: checksums of every piece a plan may ask for are known before there is a plan.
Rows are numbered within a length by slices, hashes of id and checksums, so a length that a third of the corpus has is numbered by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import map_arrow, quoted, stash, text_of
from quern.llm.tokens import encoder, public_vocabulary

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def powers(n: int) -> list[int]:
    """The powers of two that make n up, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def combinations(window: int) -> np.ndarray:
    """All (a, b, c), a <= b <= c and a = 0 for pairs, with a + b + c = window and b > 0."""
    found = []
    for a in range(window // 3 + 1):
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        found.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate(found)


def solve(parts: np.ndarray, histogram: np.ndarray, steps: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 with least squared difference of the lengths used and the histogram (accelerated projection)."""
    size = len(histogram)

    def used(x: np.ndarray) -> np.ndarray:
        got = sum(np.bincount(parts[:, k], x, size) for k in range(3))
        got[0] = 0
        return got

    def back(r: np.ndarray) -> np.ndarray:
        return r[parts[:, 0]] + r[parts[:, 1]] + r[parts[:, 2]]

    probe = np.ones(len(parts))
    for _ in range(20):
        probe = back(used(probe))
        bound = float(np.linalg.norm(probe))
        probe /= bound
    bound *= 1.05
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - back(used(y) - histogram) / bound, 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


class Plan:
    """Where the piece of any length and rank goes. ``histogram[n]`` is the number of pieces of length n."""

    def __init__(self, histogram: np.ndarray, window: int) -> None:
        assert window & (window - 1) == 0, "the window must be a power of two"
        left = histogram.astype(np.int64).copy()
        self.window, chosen = window, []
        parts = combinations(window)
        exact = np.cumsum(solve(parts, histogram.astype(float)))
        counts = np.diff(np.floor(exact + 0.5).astype(np.int64), prepend=0)  # rounded so that sums stay near
        for i in np.flatnonzero(counts):
            self._take(left, [int(p) for p in parts[i] if p], int(counts[i]), chosen)
        for top in range(window - 1, window // 3, -1):
            while left[top]:
                small = np.arange(0, (window - top) // 2 + 1)
                other = window - top - small
                stock = np.minimum(np.where(small > 0, left[small], left[top]), left[other])
                stock[small == other] //= 2
                best = int(np.argmax(stock))
                if not stock[best] or not self._take(left, [int(p) for p in (small[best], other[best], top) if p], int(left[top]), chosen):
                    break
        entries, self.used, first = [], np.zeros(window, np.int64), 0
        for lengths, n in chosen:
            at = 0
            for length in lengths:
                entries.append((length, self.used[length], first, at))
                self.used[length] += n
                at += length
            first += n
        table = np.array(sorted(entries), np.int64).reshape(-1, 4)
        self.key, self.rank, self.first, self.at = (table[:, 0] << 40) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]
        self.left, self.tail = left, first  # the residual pieces of each length; the first window of their powers
        self.base, begin = {}, 0
        lengths = np.arange(window)
        for power in powers(window - 1):
            have = np.where(lengths & power, left, 0)
            self.base[power] = begin + power * (np.cumsum(have) - have)
            begin += power * int(have.sum())
        self.whole = first + -(-begin // window)  # the first window that one piece fills by itself

    @staticmethod
    def _take(left: np.ndarray, lengths: list[int], most: int, chosen: list) -> bool:
        n = min(most, *(int(left[p]) // lengths.count(p) for p in lengths))
        if n:
            for p in lengths:
                left[p] -= n
            chosen.append((lengths, n))
        return n > 0

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces that the rank-th remainder of this length becomes."""
        if rank < self.used[length]:
            i = int(np.searchsorted(self.key, (length << 40) + rank, "right")) - 1
            return [(length, int(self.first[i] + rank - self.rank[i]), int(self.at[i]))]
        found = []
        for power in powers(length):
            at = int(self.base[power][length]) + power * (rank - int(self.used[length]))
            found.append((power, self.tail + at // self.window, at % self.window))
        return found


def _measure(batches: Iterator[pa.RecordBatch], path: str, mode: str, end_id: int, window: int, units: int, span: int) -> Iterator[pa.RecordBatch]:
    """Token counts, and checksums of the whole windows, the remainder and the powers of two in it."""
    for batch in batches:
        sizes, sums = [], []
        for ids in encoder(path, mode, most_units=units, span=span).encode(batch.column(1)):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            cuts = [(i, i + window) for i in range(0, len(ids) - window + 1, window)]
            start = len(cuts) * window
            bits = powers(len(ids) - start)
            if len(bits) > 1:
                cuts.append((start, len(ids)))
            for power in bits:
                cuts.append((start, start + power))
                start += power
            sizes.append(len(ids))
            sums.append([zlib.crc32(ids[a:b]) for a, b in cuts])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "n", "sums"]
        )


def _place(batches: Iterator[pa.RecordBatch], plan: Broadcast) -> Iterator[pa.RecordBatch]:
    plan = plan.value
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc_id, n, sums, rank, before in zip(*(c.to_pylist() for c in batch.columns)):
            whole, rest = divmod(n, plan.window)
            pieces = [(plan.window, plan.whole + before + k, 0) for k in range(whole)]
            tail = plan.place(rest, rank) if rest else []
            crcs = sums[:whole] + (sums[whole:whole + 1] if len(tail) == 1 else sums[whole + 1:])
            start = 0
            for (length, sequence, offset), crc in zip(pieces + tail, crcs):
                for column, x in zip(out, (doc_id, start, length, crc, n, sequence, offset)):
                    column.append(x)
                start += length
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in PIECES.split(", ")])


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, mode: str = "word",
    end_id: int = 1, window: int = 2048, rows_per_slice: int = 50_000, units: int = 200_000, span: int = 1 << 22,
) -> DataFrame:
    """Pieces of every document in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty: a document of the end id alone. Every id lies in exactly one piece, offsets in
    a sequence are gapless from 0, and all sequences but one are full. Repeated rows are packed one by one; an empty
    table gives no rows. Other columns are ignored. ``vocabulary`` is a path that every executor can open. ``units`` and ``span`` bound a worker's
    memory: units of text whose ids it keeps, and bytes of text that it works on at a time.
    """
    spark = docs.sparkSession
    path = vocabulary or public_vocabulary("word_bpe_49k.json")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    work = partial(_measure, path=path, mode=mode, end_id=end_id, window=window, units=units, span=span)
    slim = stash(map_arrow(rows, work, "doc_id long, n long, sums array<long>"), "lengths")
    slim = slim.withColumn("r", F.col("n") % window).withColumn("whole", F.expr(f"n div {window}"))
    by_length = slim.groupBy("r").agg(F.count(F.lit(1)).alias("c")).collect()  # at most one row for each length
    histogram = np.zeros(window, np.int64)
    for r, c in by_length:
        histogram[r] = c
    slices = int(histogram.sum()) // rows_per_slice + 1
    histogram[0] = 0
    plan = spark.sparkContext.broadcast(Plan(histogram, window))
    slim = slim.withColumn("slice", F.pmod(F.xxhash64("doc_id", "n", "sums"), F.lit(slices)).cast("int"))
    order = ["doc_id", "n", "sums"]
    counts = stash(slim.groupBy("slice", "r").agg(F.count(F.lit(1)).alias("c"), F.sum("whole").alias("w")), "slices")
    before = Window.partitionBy("r").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("slice", "r", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("rank_from"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    windows = counts.groupBy("slice").agg(F.sum("w").alias("w")).select("slice", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("whole_from"))
    inner = Window.partitionBy("slice").orderBy(*order)
    ranked = slim.withColumn("rank", F.row_number().over(Window.partitionBy("slice", "r").orderBy(*order)) - 1).withColumn(
        "done", F.coalesce(F.sum("whole").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    ranked = ranked.join(starts, ["slice", "r"]).join(windows, "slice").select(
        "doc_id", "n", "sums", (F.col("rank") + F.col("rank_from")).alias("rank"), (F.col("done") + F.col("whole_from")).alias("before")
    )
    return map_arrow(ranked, partial(_place, plan=plan), PIECES)


def _cut(batches: Iterator[pa.RecordBatch], path: str, mode: str, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [np.append(ids, np.uint32(end_id)).astype(np.int64) for ids in encoder(path, mode).encode(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def sequences(docs: DataFrame, pieces: DataFrame, vocabulary: str | None = None, mode: str = "word", end_id: int = 1) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, for tables in which every row has an id of its own.

    Pieces are joined to their documents by id: those of rows without an id are left out, and a repeated id is an error.
    """
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several documents have id {twice[0]['doc_id']}")
    path = vocabulary or public_vocabulary("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ids = map_arrow(rows, partial(_cut, path=path, mode=mode, end_id=end_id), "doc_id long, ids array<long>")
    cut = pieces.join(ids, "doc_id").select("sequence_id", F.struct("offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")).alias("p"))
    return cut.groupBy("sequence_id").agg(F.flatten(F.array_sort(F.collect_list("p"))["ids"]).alias("ids"))
