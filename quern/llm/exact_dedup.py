"""Exact deduplication: 128-bit content hash, byte comparison inside a hash group, one survivor a class.

Plan. One pass over the texts leaves a slim row of each: its id, length, 128-bit hash and SHA-256. Groups are counted and
survivors are picked among slim rows, combined on the map side first, so a group of copies that holds a third of
the corpus leaves each task as one row. The texts of hash groups with more than one row, found by a bounded bitmap, are then
compared byte by byte: a grouping on the text itself, again combined on the map side. Texts that share the
128-bit hash but not their bytes are classes of their own, told apart by SHA-256; that two byte strings share both is
excluded by that comparison, which raises an error. Unique texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACES, quoted, row_key, sieve, stash, text_of, without


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text))


def normalised(text: Column) -> Column:
    """The text without white space, what equality is judged on."""
    return F.translate(text, SPACES, "")


def facts(docs: DataFrame, id_col: str, text_col: str, hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, n, k, k2, x, h, sha) of every row, written out: code points, row_key(), 64 bits of the text, hash and SHA-256 of the normalised text."""
    text = text_of(text_col)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("t"), *[c.alias(k) for k, c in row_key(id_col, text_col).items()])
    rows = rows.withColumn("body", normalised(F.col("t")))
    return stash(rows.select(
        "doc_id", F.char_length("t").cast("long").alias("n"), "k", "k2", F.xxhash64("t").alias("x"),
        hash_fn(F.col("body")).alias("h"), F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"),
    ), "facts")


def compare_bytes(docs: DataFrame, slim: DataFrame, text_col: str, hash_fn: Callable[[Column], Column] = content_hash) -> None:
    """Raise unless every (hash, SHA-256) of a group with several rows stands for one byte string."""
    each = slim.groupBy("h", "x").agg(F.count(F.lit(1)).alias("c"))
    shared = each.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h")
    texts = sieve(docs.select(text_of(text_col).alias("t")).withColumn("x", F.xxhash64("t")), "x", each.join(shared, "h", "left_semi").select("x"))
    bodies = texts.where("maybe").select(normalised(F.col("t")).alias("body")).select(hash_fn(F.col("body")).alias("h"), "body").distinct()
    twice = bodies.select("h", F.sha2(F.col("body").cast("binary"), 256).alias("sha")).groupBy("h", "sha").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if not twice.isEmpty():
        raise ArithmeticError("two texts share both hashes")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Class of every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of SPACES. The row with the most code points in
    its original text stays, then the smallest id. Null text counts as empty, and all empty texts are one
    class. A null id loses every tie. Rows repeated with id and length alike count in group_size one by one, and
    only one of them has ``kept``. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    slim = facts(docs, id_col, text_col, hash_fn)
    compare_bytes(docs, slim, text_col, hash_fn)
    ids = slim.groupBy("h", "sha", "n", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    # Keys and results of both steps have a fixed width, so they are hashed and not sorted.
    level = ids.groupBy("h", "sha", "n").agg(F.min("doc_id").alias("least"), F.sum("times").alias("size"))
    best = level.groupBy("h", "sha").agg(F.max("n").alias("keep_n"), F.max_by("least", "n").alias("keep_id"), F.sum("size").alias("group_size"))
    best = stash(best, "best")  # read back, the join below has a plain shuffle on either side, which may be split where a class is hot
    # The same row twice is counted above and numbered again here, so that one of them is kept.
    one = ids.join(best, ["h", "sha"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")) & (F.col("copy") == 1)
    return one.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class with all its columns: the longest text, then the smallest id (null last), then any fixed row.

    Rows that share an id or have none are judged one by one, by id and text; of rows that have both in common one is
    returned. An empty table gives no rows, null text counts as empty, and columns of any name come back as they were.
    Only the slim rows and the texts of hash groups with several rows are shuffled.
    """
    slim = facts(docs, id_col, text_col)
    compare_bytes(docs, slim, text_col)
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k", "k2")
    best = slim.groupBy("h", "sha").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1").select("h", "sha", "best")
    best = stash(best, "best")  # read back, the join below has a plain shuffle on either side, which may be split where a class is hot
    rows = slim.groupBy("h", "sha", "k", "k2").agg(F.count(F.lit(1)).alias("times")).join(best, ["h", "sha"])
    stays = (F.col("k") == F.col("best.k")) & (F.col("k2") == F.col("best.k2"))
    lost = rows.withColumn("stays", stays).where("not stays or times > 1").select("k", "k2", "stays")
    return without(docs, id_col, text_col, stash(lost, "lost"))


SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
pick AS (
  SELECT body, count(*) AS group_size,
         first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM base GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM base JOIN pick USING (body)
"""
