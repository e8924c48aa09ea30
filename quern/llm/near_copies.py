"""Near copies by shingle sets: who meets by SimHash classes and MinHash bands, who goes by the exact Jaccard similarity.

A 64-bit fingerprint of a pair at similarity 0.8 differs in about 10 bits, too many to block on, so SimHash classes
alone miss most near copies. Each row also gets 20 bands of 5 MinHash values, which a pair at similarity s shares
with chance 1 - (1 - s^5)^20: 0.9996 at 0.8. Rows that meet are compared by their whole sets.

Before sets are compared, count parities are: every set is mapped to 512 bits, each the parity of the number of its shingles in
one of 512 hash segments. The Hamming distance of two such maps never exceeds the size of the sets' symmetric difference, which for
a given similarity is a fixed share of both sizes. So the test is a lower bound, loses nothing, and drops most unlike
pairs inside the join, where they are not even rows.

Rounds. At first every row is compared with one other only, the least that leads one of its buckets. What is a near
copy of a lesser row goes and is not compared again, so a large group of copies costs about one comparison a member.
Then small buckets are compared all with all. Rows of buckets over ``crowd``, who share a band for a header or a template that many have, are dealt anew by
their rarest shingles: of two sets at similarity s, each has one of the other's in its floor((1 - s) m) + 1 rarest ones, rare being one order for all, so
no pair is lost, and unlike rows no longer meet. That is followed by the same two steps; buckets that are still crowded are compared with some of
their rows, four times as many in each round, and a row leaves such a bucket once it was compared with all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import many, map_arrow, sieve, stash
from quern.operators.sieve import PAGE, SIEVE

BANDS, DEPTH = 20, 5
#: Longs of a parity map.
MAP = 8
_RNG = np.random.default_rng(42)
_FACTOR = _RNG.integers(0, 1 << 64, (BANDS * DEPTH, 1), np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, (BANDS * DEPTH, 1), np.uint64)
#: Shingles that are permuted at once, so that memory stays bounded on very long texts.
BLOCK = 2048


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """64-bit hashes of a text's shingles in order, repeats included; of the whole sequence if it has fewer words, none without any."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only SPACES cut
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = max(1, len(found) - width + 1), xxhash.xxh64_intdigest
    first, last = starts[:n].tolist(), ends[min(width, len(found)) - 1:].tolist()
    return np.fromiter((digest(joined[i:j], seed) for i, j in zip(first, last)), np.uint64, n)


def distinct(hashes: np.ndarray, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes; a text without words has one shingle, the empty one."""
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", seed)], np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each band."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[at:at + BLOCK] * _FACTOR + _ADD).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, DEPTH))]


#: Rows that are worked on together, so that memory stays bounded whatever the batches are.
ROWS = 256


def parities(hashes: np.ndarray) -> np.ndarray:
    """The parities of the numbers of hashes in 64 * MAP segments, as MAP signed longs."""
    odd = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=64 * MAP).astype(np.uint8) & 1
    return np.packbits(odd).view("<i8")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


_MAPS = [f"p{i}" for i in range(MAP)]


def _sketch(batches: Iterator[pa.RecordBatch], width: int, fingerprint: Callable) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sizes, buckets, prints, maps = [], [], [], []
        for text in batch.column(3):
            hashes = shingle_hashes(text.as_py(), width)
            found = distinct(hashes)
            sizes.append(len(found))
            buckets.append(np.array(bands(found), np.uint64))
            prints.append(fingerprint(hashes))
            maps.append(parities(found))
        arrays = [*batch.columns[:3], pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), _lists(buckets)]
        table = np.array(maps, np.int64).reshape(-1, MAP)
        yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, table.T)], names=["k", "k2", "id", "fp", "m", "buckets", *_MAPS])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = [distinct(shingle_hashes(t.as_py(), width)) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists(sets)], names=["k", "k2", "set"])


def sketches(rows: DataFrame, fingerprint: Callable, width: int = 5) -> DataFrame:
    """(k, k2, id, fp, m, buckets, p0.., row) of rows (k, k2, id, text): number of shingles, band keys, parities, a number for each row. Stashed."""
    schema = "k long, k2 long, id long, fp long, m int, buckets array<long>, " + ", ".join(f"{p} long" for p in _MAPS)
    made = map_arrow(rows, partial(_sketch, width=width, fingerprint=fingerprint), schema)
    return stash(made.withColumn("row", F.monotonically_increasing_id()), "sketch")


def _alike(similarity: float) -> Column:
    both = F.size(F.array_intersect("set_a", "set_b"))
    return both / (F.size("set_a") + F.size("set_b") - both) >= similarity


def _may_be(x: str, y: str, similarity: float) -> Column:
    """False only for pairs whose sets are less alike: by their sizes, and by the lower bound of their difference."""
    m = [F.col(f"{s}.m") for s in (x, y)]
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in _MAPS])
    most = F.floor((1 - similarity) / (1 + similarity) * (m[0] + m[1]) + 1e-6)
    return (apart <= most) & (F.least(*m) >= F.greatest(*m) * similarity - 1e-6)


def _leaders(members: DataFrame, similarity: float) -> DataFrame:
    """A pair (a, b) for a row b: the least row that leads one of its buckets and may be alike."""
    first = members.groupBy("bucket").agg(F.min("at").alias("p"))
    near = many(members).join(first, "bucket").where((F.col("p") < F.col("at")) & _may_be("p", "at", similarity))
    return near.groupBy(F.col("at").alias("b")).agg(F.min("p").alias("a")).select("a", "b")


def _small_and_large(members: DataFrame, crowd: int) -> list[DataFrame]:
    sized = many(members).join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket")
    return [sized.where(c).select("bucket", "at") for c in (F.col("n") <= crowd, F.col("n") > crowd)]


def _all_pairs(small: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a before b, of buckets of a bounded size."""
    both = small.select("bucket", F.col("at").alias("a")).join(small.select("bucket", F.col("at").alias("b")), "bucket")
    return both.where((F.col("a") < F.col("b")) & _may_be("a", "b", similarity)).select("a", "b")


def _first_ones(batches: Iterator[pa.RecordBatch], common: Broadcast, similarity: float) -> Iterator[pa.RecordBatch]:
    """(row, bucket): the first floor((1 - similarity) m) + 1 shingles of each set, those that many rows have after the others."""
    bits = common.value
    for batch in batches:
        rows, found = [], []
        for row, held in zip(batch.column(0).to_pylist(), batch.column(1)):
            held = held.values.to_numpy(zero_copy_only=False)
            place = held & (SIEVE - 1)
            order = np.lexsort((held, (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1))
            found.append(held[order[:int((1 - similarity) * len(held) + 1e-6) + 1]])
            rows.append(np.full(len(found[-1]), row, np.int64))
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, found)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "bucket"])


def rarest(rows: DataFrame, sets: DataFrame, similarity: float, crowd: int = 64) -> DataFrame:
    """(bucket, at): each row (at) in a bucket for each of its floor((1 - similarity) m) + 1 rarest shingles.

    Shingles of over ``crowd`` rows come last in the order, all others before them. Who is which is told by a bitmap of a fixed size, the same for
    all rows, so what it takes for common wrongly only comes later in the order of every row.
    """
    held = rows.join(sets.toDF("__k", "__k2", "set"), (F.col("at.k") == F.col("__k")) & (F.col("at.k2") == F.col("__k2"))).select(F.col("at.row").alias("row"), "set")
    place = F.pmod("bucket", F.lit(SIEVE))
    common = held.select(F.explode("set").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    pages = common.select(F.floor(place / PAGE).alias("page"), (place % PAGE).alias("p")).groupBy("page").agg(F.bitmap_construct_agg("p").alias("bits"))
    bits = np.zeros(SIEVE // 8, np.uint8)
    for r in pages.collect():  # at most SIEVE / PAGE rows of PAGE / 8 bytes
        bits[r.page * PAGE // 8:][:PAGE // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    told = rows.sparkSession.sparkContext.broadcast(bits)
    first = map_arrow(held, partial(_first_ones, common=told, similarity=similarity), "row long, bucket long")
    return first.join(rows.select(F.col("at.row").alias("row"), "at"), "row").select("bucket", "at")


def _meetings(members: DataFrame, crowd: int, pivots: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a before b, to compare; and the members of larger buckets without those that are compared with all."""
    small, large = _small_and_large(members, crowd)
    first = large.groupBy("bucket", F.pmod(F.xxhash64("at.row"), F.lit(pivots)).alias("salt")).agg(F.min("at").alias("p")).drop("salt")
    star = large.join(first, "bucket").where((F.col("at") != F.col("p")) & _may_be("p", "at", similarity)).select(F.least("at", "p").alias("a"), F.greatest("at", "p").alias("b"))
    return _all_pairs(small, similarity).unionByName(star), large.join(first.select("bucket", F.col("p").alias("at")), ["bucket", "at"], "left_anti")


def near_copies(rows: DataFrame, made: DataFrame, width: int = 5, similarity: float = 0.8, classes: DataFrame | None = None, crowd: int = 64) -> DataFrame:
    """(k, k2, stays): the rows that go, and, with ``stays``, those repeated rows of which one stays.

    made: the sketches of ``rows`` (k, k2, id, text). Rows are ordered by id (null last), key, number. A row goes if its shingle
    set has at least ``similarity`` in common with an earlier row's that it meets and that has not gone itself in an
    earlier round. At the end no two rows that stay and meet are near copies, and a chain of near copies leads from each
    row that went to an earlier one that stays. Of rows of one key only the least is looked at. classes: further (row,
    bucket) in which rows meet.
    """
    repeated = made.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("least")).where("times > 1")
    repeated = stash(repeated.select("k", "k2", "least"), "repeated")
    ones = made.join(repeated, ["k", "k2"], "left").where("least is null or least = row").drop("least")
    meets = ones.select("row", F.explode("buckets").alias("bucket"))
    if classes is not None:
        meets = meets.unionByName(classes.select("row", "bucket").join(ones.select("row"), "row", "left_semi"))
    shared = meets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    at = F.struct(F.col("id").isNull().alias("unnamed"), "id", "k", "k2", "row", "m", *_MAPS).alias("at")
    left = stash(many(meets).join(shared, "bucket").join(ones.drop("buckets"), "row").select("bucket", at).distinct(), "meets")
    # Only rows that meet others are read again, for their sets; rows of one key have one text.
    who = left.select(F.col("at.k").alias("k")).distinct()
    texts = sieve(rows.select("k", "k2", "text"), "k", who).where("maybe").select("k", "k2", "text")
    sets = map_arrow(texts, partial(_sets, width=width), "k long, k2 long, set array<long>")
    sets = stash(sets if repeated.isEmpty() else sets.dropDuplicates(["k", "k2"]), "sets")
    gone, turn = None, 0
    while not left.isEmpty():
        if turn in (0, 2):
            pairs, rest = _leaders(left, similarity), left
        elif turn == 1:
            small, large = _small_and_large(left, crowd)
            pairs, rest = _all_pairs(small, similarity), rarest(large.select("at").distinct(), sets, similarity, crowd)
        else:
            pairs, rest = _meetings(left, crowd, 4 ** (turn - 2), similarity)
        pairs = pairs.select(
            *[F.col(f"{s}.{k}").alias(f"{k}_{s}") for s in "ab" for k in ("k", "k2")], F.col("b.row").alias("row")
        ).distinct()
        for s in "ab":
            pairs = pairs.join(sets.select(F.col("k").alias(f"k_{s}"), F.col("k2").alias(f"k2_{s}"), F.col("set").alias(f"set_{s}")), [f"k_{s}", f"k2_{s}"])
        now = stash(pairs.where(_alike(similarity)).select("row", F.col("k_b").alias("k"), F.col("k2_b").alias("k2")).distinct(), "gone")
        gone = now if gone is None else gone.unionByName(now)
        left, turn = stash(rest.join(now.select("row"), F.col("at.row") == now["row"], "left_anti"), "meets"), turn + 1
    stay = repeated.select("k", "k2", F.lit(True).alias("stays"))
    if gone is None:
        return stay
    gone = gone.select("k", "k2", F.lit(False).alias("stays")).distinct()
    return gone.unionByName(stay.join(gone, ["k", "k2"], "left_anti"))
