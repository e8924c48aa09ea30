"""Deterministic samples: round robin over groups, stratified picks, quotas."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.tokens import evenly_spaced
from quern.operators.ranges import numbered, pick_ranks, prefix_scan


@dataclass(frozen=True)
class Turns:
    """A stretch of turns without an exhaustion: of ``groups`` in order, turn t (from ``start``) takes from group t modulo their number."""

    start: int
    length: int
    groups: tuple[str, ...]
    taken: tuple[int, ...]  # rows of each group that were taken before


def round_robin_segments(sizes: dict[str, int]) -> list[Turns]:
    """All turns in closed form, a stretch for each exhaustion at most: the turn is the cursor modulo the groups left, and one
    that is found exhausted is removed without moving the cursor."""
    live, taken, cursor, out = sorted(sizes), dict.fromkeys(sizes, 0), 0, []
    while live:
        n = len(live)
        first = cursor % n
        # the turn, counted from here, at which each group would be found empty
        empty = {g: (i - first) % n + (sizes[g] - taken[g]) * n for i, g in enumerate(live)}
        gone = min(live, key=empty.__getitem__)
        if empty[gone]:
            out.append(Turns(cursor, empty[gone], tuple(live), tuple(taken[g] for g in live)))
            for i, g in enumerate(live):
                taken[g] += -(-(empty[gone] - (i - first) % n) // n)
            cursor += empty[gone]
        live.remove(gone)
    return out


def round_robin_schedule(sizes: dict[str, int], most: int | None = None) -> list[tuple[str, int]]:
    """(group, rank from 1) in the order of turns, up to a count: the segments written out."""
    turns = []
    for s in round_robin_segments(sizes):
        taken = dict(zip(s.groups, s.taken))
        for t in range(s.start, s.start + s.length):
            if most is not None and len(turns) >= most:
                return turns
            g = s.groups[t % len(s.groups)]
            taken[g] += 1
            turns.append((g, taken[g]))
    return turns


def _subset_bucket(value: Column) -> Column:
    return X.stable_bucket(value, 2**31 - 1)


def round_robin(
    df: DataFrame, split: str, max_examples: int | None = None, target_hours: float | None = None, seed: int = 42, group: str = "dataset",
    bucket=_subset_bucket, order: list[str] | None = None,
) -> DataFrame:
    """Rows of one split with ``position``, one group after the other, up to a count or until the hours are reached.

    A row's position follows from its group and rank, by the stretch of turns that its rank lies in; there is at most one for each
    exhaustion of a group, whatever the number of rows. Ranks and the seconds before each row are summed by ranges. The row that reaches
    a budget is in, so there is one at least if the split has any.
    """
    spark = df.sparkSession
    rows = df.where(F.col("split") == split).withColumn("__b", bucket(F.concat(F.lit(f"smoke:{seed}:"), "id")))
    sizes = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    most = None if max_examples is None else max(max_examples, 1)  # the row that reaches a budget is in
    plan = [
        (g, taken, taken + (s.length - (i - s.start) % len(s.groups) - 1) // len(s.groups) + 1, s.start + (i - s.start) % len(s.groups), len(s.groups))
        for s in round_robin_segments(sizes) if most is None or s.start < most for i, (g, taken) in enumerate(zip(s.groups, s.taken))
    ]
    if not plan:
        return rows.drop("__b").withColumn("position", F.lit(0).cast("long")).limit(0)
    turns = spark.createDataFrame(plan, "__g string, __from long, __upto long, __first long, __step long")  # groups times stretches
    ranked = numbered(rows, ["__b", *(order or ["id"])], "__rank", [group])
    inside = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__upto"))
    placed = ranked.join(F.broadcast(turns), inside).withColumn("position", F.col("__first") + (F.col("__rank") - F.col("__from")) * F.col("__step"))
    placed = placed.drop("__b", "__rank", *turns.columns)
    if most is not None:
        placed = placed.where(F.col("position") < most)
    if target_hours is None:
        return placed
    return prefix_scan(placed, "duration", ["position"], "__s").where((F.col("__s") < target_hours * 3600) | (F.col("position") == 0)).drop("__s")


def allocate(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Shares of ``total`` for strata in first-seen order: rounded half to even, at least one, corrected one by one."""
    if total < len(sizes):
        raise ValueError("the total must cover every stratum")
    rows = sum(sizes.values())
    total = min(total, rows)
    got = {k: max(1, min(n, round(Fraction(total * n, rows)))) for k, n in sizes.items()}
    while sum(got.values()) > total:
        got[max((k for k in got if got[k] > 1), key=got.__getitem__)] -= 1
    while sum(got.values()) < total:
        got[max((k for k in got if got[k] < sizes[k]), key=lambda k: sizes[k] - got[k])] += 1
    return got


def stratified(df: DataFrame, total: int, stratum: str = "source_split", order: list[str] | None = None) -> DataFrame:
    """Evenly spaced picks in each stratum (case-folded), with ``pick``. Strata are few; only their sizes reach the driver."""
    order = order or ["id"]
    rows = df.withColumn("__k", F.lower(stratum))
    seen = rows.groupBy("__k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")).orderBy("first").collect()
    sizes = {r["__k"]: r["n"] for r in seen}
    shares = allocate(sizes, total)
    picks = df.sparkSession.createDataFrame([(k, sizes[k], c) for k, c in shares.items()], "__k string, n long, c long")
    picks = picks.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).select("__k", F.col("i").alias("pick"), evenly_spaced(F.col("i"), F.col("n"), F.col("c")).alias("__p"))
    picked = pick_ranks(rows, picks.withColumnRenamed("__p", "__rank"), "__k", order, "__rank")
    return picked.drop("__k", "__rank")


def per_source_quota(df: DataFrame, source: str, order: list[str], most: int) -> DataFrame:
    """The first ceil(most / sources) rows of each source, joined and cut at ``most`` in order of source."""
    sources = df.select(source).distinct().count()
    quota = -(-most // max(1, sources))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("rank") <= quota)
    return ranked.orderBy(source, "rank").limit(most)
