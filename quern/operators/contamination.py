"""Word runs that a small table shares with a large one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.sieve import sieve


def _words(text: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(text, r"\s+", " ")), " ")


def _run(words: Column, at: Column, width: int) -> Column:
    return F.array_join(F.slice(words, at, width), " ")


def shared_runs(docs: DataFrame, small: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, shared): for each row of ``docs`` that has any, how many distinct runs of ``width`` words of its text occur in ``small``.

    Runs are words in lower case between white space, joined by a space. Of the large table only 64-bit hashes of runs leave the scan, and of
    those only what passes a bitmap of the small table's hashes. Hashes that meet are compared as texts: the runs of documents that
    have any are cut again, where the match was. Texts of fewer words, null and empty ones have no runs.
    """
    texts = lambda df, *keep: df.select(*keep, _words(F.col(text_col)).alias("x")).where(F.size("x") >= width)
    places = F.sequence(F.lit(1), F.size("x") - width + 1)
    wanted = texts(small).select(F.explode(F.transform(places, lambda i: _run(F.col("x"), i, width))).alias("gram")).distinct()
    wanted = wanted.withColumn("h", F.xxhash64("gram"))
    numbered = docs.select(id_col, text_col, F.xxhash64(F.col(id_col), F.col(text_col)).alias("__row"))
    # words are hashed once each, and a run by the hashes of its words
    by_word = F.transform("x", lambda w: F.xxhash64(w))
    hashes = F.arrays_zip(*[F.slice("y", k + 1, F.size("y") - width + 1).alias(f"w{k}") for k in range(width)])
    run_hash = lambda z: F.xxhash64(*[z[f"w{k}"] for k in range(width)])
    keys = texts(small).select(by_word.alias("y")).select(F.explode(F.transform(hashes, run_hash)).alias("h")).distinct()
    runs = texts(numbered, "__row").select("__row", by_word.alias("y")).select("__row", F.explode(F.transform(hashes, run_hash)).alias("h"))
    met = sieve(runs, "h", keys).where("maybe").select("__row", "h").join(keys, "h", "left_semi").select("__row").distinct()
    held = numbered.join(met, "__row", "left_semi")
    grams = texts(held, id_col).select(id_col, F.explode(F.transform(places, lambda i: _run(F.col("x"), i, width))).alias("gram")).distinct()
    return grams.join(wanted.select("gram"), "gram", "left_semi").groupBy(id_col).agg(F.count(F.lit(1)).alias("shared"))
