"""A bitmap of keys that tells which rows a join can need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve (8 MB broadcast) and of one of its pages.
SIEVE, PAGE = 1 << 26, 1 << 15


def sieve(rows: DataFrame, column: str, keys: DataFrame, bits: int = SIEVE) -> DataFrame:
    """``rows`` with ``maybe``: false only where no row of ``keys`` (one bigint column) has the value of ``column``.

    A bitmap over the low bits of the keys is broadcast, ``bits / 8`` bytes at most, whatever the number of keys. So
    rows that no key asks for are never shuffled. With far more keys than bits nearly all rows pass and
    what comes after does all the work, as it would without a sieve.
    """
    (key,) = keys.columns
    bit = lambda c: F.pmod(F.col(c), F.lit(bits))
    pages = keys.select(F.floor(bit(key) / PAGE).alias("__page"), (bit(key) % PAGE).alias("p")).groupBy("__page").agg(F.bitmap_construct_agg("p").alias("__bits"))
    place = bit(column) % PAGE
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(pages), F.floor(bit(column) / PAGE) == F.col("__page"), "left")
    return found.withColumn("maybe", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("__page", "__bits")
