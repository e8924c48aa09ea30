"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are the items, at every scale. The packing needs their sizes only: sizes are counted on the cluster,
and the driver packs runs of (size, count), largest first, each item into the bin whose remaining capacity is the tightest
that still holds it; a balanced tree finds that bin, and since it stays the tightest for items of one size, a run
enters it as a whole, as far as it fits. Sizes under 4096 are runs of their own; of larger ones those that agree in their 12
leading bits share a run, whose items count with their mean. So there are at most 2,048 runs for each doubling of
the size, whatever the corpus. The groups of a run are then numbered and dealt to the run's bins by number, in slices, so that
no task sees a whole run; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import quoted, stash, text_of

#: Leading bits of a size that tell runs apart, and steps of the capacities that are tried, by the mean load.
EXACT, STEPS = 12, 1 << 14


class RoomTree:
    """Balanced search tree (AVL) of bins by remaining capacity."""

    def __init__(self) -> None:
        self.root: list | None = None  # node: [key, left, right, height]

    @staticmethod
    def _fix(n: list) -> list:
        h = lambda x: x[3] if x else 0
        lift = lambda x: x.__setitem__(3, 1 + max(h(x[1]), h(x[2])))

        def turn(x: list, up: int) -> list:
            child, down = x[up], 3 - up
            x[up], child[down] = child[down], x
            lift(x)
            lift(child)
            return child

        lift(n)
        for up in (1, 2):
            other = 3 - up
            if h(n[up]) > h(n[other]) + 1:
                if h(n[up][other]) > h(n[up][up]):
                    n[up] = turn(n[up], other)
                return turn(n, up)
        return n

    def add(self, key: tuple[int, int]) -> None:
        def put(n: list | None) -> list:
            if n is None:
                return [key, None, None, 1]
            side = 1 if key < n[0] else 2
            n[side] = put(n[side])
            return self._fix(n)

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(n: list | None, key: tuple[int, int]) -> list | None:
            if n is None:
                return None
            if key == n[0]:
                if not n[1] or not n[2]:
                    return n[1] or n[2]
                least = n[2]
                while least[1]:
                    least = least[1]
                n[0] = least[0]
                n[2] = cut(n[2], least[0])
            else:
                side = 1 if key < n[0] else 2
                n[side] = cut(n[side], key)
            return self._fix(n)

        self.root = cut(self.root, key)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of at least ``need``; ties go to the lowest bin."""
        n, found = self.root, None
        while n:
            if n[0] >= (need, -1):
                found, n = n[0], n[1]
            else:
                n = n[2]
        return found


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """(bin, items) of every run of (size, items), which must come in falling order of size, in bins of a fixed capacity.

    A larger item has a bin of its own. None if that takes more than ``most`` bins.
    """
    tree, bins, where = RoomTree(), 0, []
    for size, left in runs:
        dealt = []
        while left:
            room = tree.tightest(size)
            if room is None:
                if bins == most:
                    return None
                room, bins = (max(capacity, size), bins), bins + 1
            else:
                tree.remove(room)
            n = min(left, room[0] // size)
            dealt.append((room[1], n))
            tree.add((room[0] - n * size, room[1]))
            left -= n
        where.append(dealt)
    return where


def even_bins(runs: list[tuple[int, int]], n_bins: int) -> list[list[tuple[int, int]]]:
    """(bin, items) of every run so that ``n_bins`` of the least common capacity hold them all.

    An item over the mean of what is left can't be evened out: it gets a bin to itself, and the rest is shared out
    among the other bins. Their capacity is the least multiple of a STEPS-th over the mean at which best-fit-decreasing
    needs no more bins than there are.
    """
    order, own, total = sorted(range(len(runs)), key=lambda i: (-runs[i][0], i)), 0, sum(s * n for s, n in runs)
    where: list[list[tuple[int, int]]] = [[] for _ in runs]
    left = [n for _, n in runs]
    for i in order:
        while left[i] and n_bins - own > 1 and runs[i][0] * (n_bins - own) >= total:
            where[i].append((own, 1))
            own, total, left[i] = own + 1, total - runs[i][0], left[i] - 1
    rest, bins = [(runs[i][0], left[i]) for i in order], n_bins - own
    fits = lambda k: best_fit_decreasing(rest, -(-total * (STEPS + k) // (STEPS * bins)), bins)
    low, high = -1, 0
    while (found := fits(high)) is None:
        low, high = high, max(1, high * 2)
    while high - low > 1:
        mid = (low + high) // 2
        if (less := fits(mid)) is None:
            low = mid
        else:
            high, found = mid, less
    for i, dealt in zip(order, found):
        where[i] += [(own + b, n) for b, n in dealt]
    return where


def run_of(size: Column) -> Column:
    """A size with all but its EXACT leading bits cleared."""
    drop = F.greatest(F.length(F.bin(size)) - EXACT, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def numbered(rows: DataFrame, keys: list[str], slice_of: Column, order: list[str], name: str) -> DataFrame:
    """Number the rows of every key from 0: those of each slice by themselves, after those of the slices before it."""
    sliced = rows.withColumn("slice", slice_of)
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy(*order)) - 1
    return sliced.withColumn("rank", rank).join(starts, [*keys, "slice"]).withColumn(name, (F.col("start") + F.col("rank")).cast("long")).drop("slice", "rank", "start")


def shard_documents(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rows_per_slice: int = 100_000,
) -> DataFrame:
    """Shard of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard. The law is ``bytes``.

    Size is the UTF-8 length plus 8. Equal texts share a shard (null counts as empty), so a group larger than a
    shard's share makes that shard as large as the group; the others are even. Items are 64-bit hashes of texts;
    two texts with one hash would only be kept together. Slots number the rows of a shard from 0 without gaps, in
    the order of hash slice, doc_id, crc; a null id comes first, repeated rows get a slot each. ``grown_shard`` is
    null under this law. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(
        F.col(quoted(id_col)).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"),
    )
    rows = stash(rows, "sizes")
    groups = stash(rows.groupBy("g").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).withColumn("run", run_of(F.col("size"))), "groups")
    counted = groups.groupBy("run").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("rows").alias("r")).orderBy(F.desc("run")).collect()  # bounded: 2^EXACT runs for each doubling
    dealt = even_bins([(-(-c.s // c.n), c.n) for c in counted], n_shards)
    table = []
    for c, parts in zip(counted, dealt):
        at = 0
        for shard, n in parts:
            table.append((c.run, at, at + n, shard))
            at += n
    parts = spark.createDataFrame(table, "run long, first long, stop long, shard int")
    slices = lambda n: max(1, n // (n_shards * rows_per_slice) + 1)
    ranked = numbered(groups.select("run", "g"), ["run"], F.pmod("g", F.lit(slices(sum(c.n for c in counted)))).cast("int"), ["g"], "number")
    homes = ranked.join(F.broadcast(parts), (ranked["run"] == parts["run"]) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("stop"))).select("g", "shard")
    # Both sides are read back, so the join may be split where a group is hot.
    placed = stash(rows.join(stash(homes, "homes"), "g").select("doc_id", "size", "text_crc32", "shard"), "placed")
    n_slices = slices(sum(c.r for c in counted))
    out = numbered(placed, ["shard"], F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slices)).cast("int"), ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
