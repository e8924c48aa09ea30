"""Packing of a token stream into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranges import prefix_scan


def prefix_sum(df: DataFrame, amount: str, order: list[str], name: str) -> DataFrame:
    """Add the sum of ``amount`` over all rows before, in the given order (which must be total), see ranges.prefix_scan()."""
    return prefix_scan(df, amount, order, name)


def block_runs(lengths: DataFrame, length: str, block: int, order: list[str]) -> DataFrame:
    """(order, block_id, start, size, at): the runs that block edges cut each row of a stream into, from the rows' lengths alone.

    ``start`` is where in its row a run begins, ``at`` where in the stream. Runs of the incomplete block at the end are left out.
    """
    if block <= 0:
        raise ValueError("the block size must be positive")
    rows = lengths.select(*order, F.col(length).cast("long").alias("__n")).where("__n > 0")
    rows = prefix_sum(rows, "__n", order, "__at")
    blocks = rows.withColumn("block_id", F.explode(F.sequence(F.expr(f"__at div {block}"), F.expr(f"(__at + __n - 1) div {block}"))))
    start = F.greatest(F.col("block_id") * block - F.col("__at"), F.lit(0).cast("long"))
    stop = F.least((F.col("block_id") + 1) * block - F.col("__at"), F.col("__n"))
    runs = blocks.select(*order, "block_id", start.alias("start"), (stop - start).alias("size"), (F.col("__at") + start).alias("at"))
    whole = lengths.agg(F.sum(F.greatest(F.col(length), F.lit(0)).cast("long")).alias("__total"))  # one row
    return runs.crossJoin(F.broadcast(whole)).where(f"(block_id + 1) * {block} <= __total").drop("__total")


def pack_blocks(df: DataFrame, tokens: str | Column, eos: int, block: int, order: list[str], length: Column | None = None) -> DataFrame:
    """(block_id, tokens): the tokens of all rows in order, an end id after each row that has any, cut every ``block``.

    The incomplete tail is left out. Order and places come from lengths alone. A row's tokens are then cut at block edges where they are, and
    what is shuffled are its runs, each once. ``length`` says how many tokens a row has, where that is cheaper to tell than to tokenize.
    """
    ids = F.col(tokens) if isinstance(tokens, str) else tokens
    n = F.size(ids) if length is None else length
    rows = df.where(n > 0)
    places = block_runs(rows.select(*order, (n + 1).alias("__size")), "__size", block, order)
    cuts = places.groupBy(*order).agg(F.array_sort(F.collect_list(F.struct("start", "size", "block_id", "at"))).alias("__cuts"))
    met = rows.select(*order, ids.alias("__ids")).join(cuts, order)
    run = lambda c: F.struct(c["block_id"].alias("block_id"), F.struct(c["at"].alias("at"), F.slice("__all", (c["start"] + 1).cast("int"), c["size"].cast("int")).alias("ids")).alias("run"))
    runs = met.withColumn("__all", F.concat("__ids", F.array(F.lit(eos)))).select(F.explode(F.transform("__cuts", run)).alias("r")).select("r.*")
    packed = runs.groupBy("block_id").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    return packed.select("block_id", F.flatten(F.col("runs")["ids"]).alias("tokens"))
