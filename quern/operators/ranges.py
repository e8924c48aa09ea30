"""Ordered work without a task that holds a key: running values, ranks and quantiles over sorted ranges.

Rows are dealt into ranges of their order and written out, since bounds of ranges are sampled and all uses must see the same. Each range is worked
on for itself; what it owes to the ranges before it comes from one row for each range (and key).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import stash

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}
#: Distinct values of a bracket that may be looked at one by one, and the share of ranks that a bracket is narrowed by in one pass.
FEW, SHARPNESS = 2_000, 2_000


def dealt(df: DataFrame, order: list, tag: str = "ranges") -> DataFrame:
    """The rows with ``__range``, the number of the range of ``order`` that they lie in, written out."""
    return stash(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), tag)


def prefix_scan(df: DataFrame, column: str, order: list[str], name: str, how: str = "sum", keys: list[str] | tuple = ()) -> DataFrame:
    """Add the sum, minimum or maximum of ``column`` over the rows before, in the given order (which must be total), apart for each key, as ``name``, in
    the place of a column that has it.

    A sum of nothing is 0, a minimum or maximum of nothing null; nulls don't count. A key's rows may fill any number of ranges, and no task sees
    more of them than one range has. A key is carried from range to range by one row, so what is broadcast has at most a row for each range.
    """
    total, combine = _COMBINE[how]
    keys, kind = list(keys), dict(df.dtypes)[column]
    ranged = dealt(df, [*keys, *order])
    inner = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range", *keys).agg(total(column).alias("__t"))
    carried = totals.select("__range", *keys, total("__t").over(before).alias("__c")).where("__c is not null").withColumnsRenamed({k: f"__key{i}" for i, k in enumerate(keys)})
    rows = ranged.withColumn("__in", total(column).over(inner))
    on = [rows["__range"] == carried["__range"], *[rows[k].eqNullSafe(carried[f"__key{i}"]) for i, k in enumerate(keys)]]
    found = rows.join(F.broadcast(carried), reduce(lambda a, b: a & b, on), "left")
    value = combine(F.col("__in"), F.col("__c"))
    value = value.cast("long") if how == "sum" and kind in ("tinyint", "smallint", "int", "bigint") else value
    return found.select(*[rows[c] for c in df.columns if c != name], value.alias(name))


def numbered(df: DataFrame, order: list[str], name: str = "ord", keys: list[str] | tuple = ()) -> DataFrame:
    """Number the rows from 0 in the given order, apart for each key."""
    return prefix_scan(df.withColumn("__one", F.lit(1).cast("long")), "__one", order, name, "sum", keys).drop("__one")


def pick_ranks(df: DataFrame, picks: DataFrame, key: str, order: list[str], rank: str = "rank") -> DataFrame:
    """The rows of given ranks (from 0) within their key, with the other columns of ``picks`` (key, rank, ...). Ranks that no row has are left out.

    Rows are counted by range and key; only the ranges that hold a pick are sorted.
    """
    ranged = dealt(df, [key, *order], "strata")
    counts = ranged.groupBy("__range", key).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    wanted = picks.join(starts, key).where((F.col(rank) >= F.col("__start")) & (F.col(rank) < F.col("__start") + F.col("__n")))
    wanted = stash(wanted.withColumn("__at", F.col(rank) - F.col("__start")).drop("__n", "__start"), "picks")
    held = ranged.join(wanted.select("__range", key).distinct(), ["__range", key], "left_semi")
    place = F.row_number().over(Window.partitionBy("__range", key).orderBy(*order)) - 1
    return held.withColumn("__at", place.cast("long")).join(wanted, ["__range", key, "__at"]).drop("__range", "__at")


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """Exact nearest-rank quantiles by name: the value of rank max(1, ceil(q * n)) of (column, q); None of nothing. Nulls don't count.

    Every quantile has a bracket of values that its rank lies in. A pass counts the rows below and inside all brackets at once and sketches where in each
    the rank lies; the bracket shrinks by a factor of some SHARPNESS / 4 a pass until it has a single value or at most FEW rows, which
    are sorted by Spark. No task gathers more than sketches or FEW rows a quantile. ``df`` is read once a pass: a slim stored table is best.
    """
    columns = sorted({c for c, _ in wanted.values()})
    first = df.agg(*[x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    found: dict[str, float | None] = {k: None for k, (c, _) in wanted.items() if not first[f"n_{c}"]}
    open_ = {}
    for name, (c, q) in wanted.items():
        if name not in found:
            n = first[f"n_{c}"]
            open_[name] = (c, max(1, math.ceil(q * n)), first[f"lo_{c}"], first[f"hi_{c}"], 0, n)  # column, rank, bracket, rows below and inside
    while open_:
        for name, (c, rank, lo, hi, below, inside) in list(open_.items()):
            if lo == hi:
                found[name] = lo
            elif inside <= FEW:
                values = [r[0] for r in df.where(F.col(c).between(lo, hi)).select(c).orderBy(c).limit(rank - below).collect()]  # at most FEW
                found[name] = values[-1]
            else:
                continue
            del open_[name]
        if not open_:
            break
        asked = []
        for name, (c, rank, lo, hi, below, inside) in open_.items():
            x = F.when(F.col(c).between(lo, hi), F.col(c))
            share, step = (rank - below - 0.5) / inside, 1.0 / SHARPNESS
            ends = [min(1.0, max(0.0, share + s * step)) for s in (-2, -1, 0, 1, 2)]
            asked.append(F.percentile_approx(x, ends, 2 * SHARPNESS).alias(name))
        guess = df.agg(*asked).first()
        cuts = {name: sorted({*guess[name], b[2], b[3]}) for name, b in open_.items()}
        # exact counts under and at each cut decide which two neighbours the rank lies between
        counted = df.agg(*[
            x for name, (c, *_) in open_.items() for i, v in enumerate(cuts[name])
            for x in (F.count_if(F.col(c) < F.lit(v)).alias(f"{name}_lt{i}"), F.count_if(F.col(c) <= F.lit(v)).alias(f"{name}_le{i}"))
        ]).first()
        for name, (c, rank, lo, hi, below, inside) in list(open_.items()):
            for i, v in enumerate(cuts[name]):
                if counted[f"{name}_lt{i}"] < rank <= counted[f"{name}_le{i}"]:
                    found[name] = v
                    del open_[name]
                    break
                if rank <= counted[f"{name}_lt{i}"]:  # strictly between this cut and the one before
                    least = counted[f"{name}_le{i - 1}"]
                    inner = df.where((F.col(c) > cuts[name][i - 1]) & (F.col(c) < v)).agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
                    open_[name] = (c, rank, inner["lo"], inner["hi"], least, counted[f"{name}_lt{i}"] - least)
                    break
    return found
