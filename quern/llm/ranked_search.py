"""Ranked lexical search: the best documents of many queries by three-phase uniform thresholds (TPUT) over term-partitioned postings.

A list holds a term's postings, highest share first. A document's score for a query is the sum over the query's lists of weight times
share, all integers.

1. The first k of every list give partial sums; the k-th highest of a query's partial sums is a lower bound of its k-th score.
2. With m lists, a document that is under bound / m in every one of them can't reach the bound. So every list is read down
   to that threshold, the same for all lists of a query. Sums of what was read give a better bound, and with
   the most that each list not read for a document could add, an upper bound of its score; the document is a candidate where that
   reaches the better bound. A list adds nothing if a single occurrence in a document of that length would have been read.
3. The candidates' postings that were not read are looked up, so their scores are exact.

Bounds count ties as reaching, so equal scores are all there to be ordered by id.

Plan. A task counts the terms of a batch of whole texts; only those that pass a bitmap of the queries' terms are written out. The lists
are dealt by (term, share) into sorted ranges, so a very frequent term fills as many files as it needs, and ranks within a list are cut on the
map side. What phase 2 reads is shuffled by document once: sums by (document, query) are local from there on. Queries have a row for each of
their terms; such tables are counted, and broadcast up to SMALL terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import map_arrow, quoted, sieve, stash, text_of

#: Terms of all queries together, some 50 bytes each, up to which tables of them are broadcast. With more Spark chooses the joins.
SMALL = 1 << 18
#: What stands between terms, as RE2 has it: the ASCII characters that are neither letters nor digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = pc.split_pattern_regex(pc.ascii_lower(batch["t"].cast(pa.large_string())), BETWEEN)
        code = pc.dictionary_encode(split.flatten())
        terms = code.dictionary
        which = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(split.offsets.to_numpy())
        doc = np.repeat(np.arange(batch.num_rows), sizes)
        real = pc.not_equal(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False) if len(terms) else np.zeros(0, bool)
        keep = real[which] if len(terms) else np.zeros(0, bool)  # an edge of the text that is no term leaves an empty string
        doc, which = doc[keep], which[keep]
        n = np.bincount(doc, minlength=batch.num_rows)
        pairs, times = np.unique(doc * max(len(terms), 1) + which, return_counts=True)
        doc, which = pairs // max(len(terms), 1), pairs % max(len(terms), 1)
        nothing = lambda kind: pa.nulls(batch.num_rows, kind)
        yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], pa.array(n, pa.int64()), nothing(pa.string()), nothing(pa.int64())], ["row", "id", "n", "term", "tf"])
        for k in range(0, len(pairs), 1 << 16):
            some = slice(k, k + (1 << 16))
            at = pa.array(doc[some])
            yield pa.RecordBatch.from_arrays(
                [batch["row"].take(at), pa.nulls(len(at), batch["id"].type), pa.array(n[doc[some]], pa.int64()), terms.take(pa.array(which[some])).cast(pa.string()), pa.array(times[some], pa.int64())],
                ["row", "id", "n", "term", "tf"],
            )


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, term, tf): for each row one row without a term, with its id and number of terms, and one for each distinct term, without the id."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).alias("id"), text_of(text_col).alias("t"))
    return map_arrow(rows, _count, f"row long, id {rows.schema['id'].dataType.simpleString()}, n long, term string, tf long")


def weight(df: Column, documents: int) -> Column:
    return F.floor(1000 * F.ln((2.0 * documents + 2) / (2.0 * df + 1))).cast("long")


def share(tf: Column, n: Column, documents: int, terms: int) -> Column:
    """What a posting gives for each unit of its term's weight."""
    m = F.lit(100 - 50) + F.call_function("div", F.lit(50).cast("long") * n * documents, F.lit(terms).cast("long"))
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, 1000 * tf + 20 * m)


def index(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(lists, documents, N): postings (tid, share, row, base) of the vocabulary's terms in sorted ranges, and (row, id) of every document, written out.

    ``base`` is the share that a single occurrence has in the document, the least of any.
    """
    counted = sieve(term_counts(docs, id_col, text_col).withColumn("h", F.xxhash64("term")), "h", vocabulary.select(F.xxhash64("term").alias("h")))
    counted = stash(counted.where("maybe or term is null").drop("h", "maybe"), "terms")
    documents = counted.where("term is null")
    total = documents.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = total[0], total[1] or 0
    part = lambda tf: share(tf, F.col("n"), n_docs, max(n_terms, 1)).cast("int")  # noqa: E731  under 10^6
    postings = counted.where("term is not null").join(vocabulary, "term").select("tid", part(F.col("tf")).alias("share"), "row", part(F.lit(1).cast("long")).alias("base"))
    order = [F.col("tid"), F.col("share").desc(), F.col("row")]
    return stash(postings.repartitionByRange(*order).sortWithinPartitions(*order), "lists"), documents.select("row", "id"), n_docs


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(query, bound): the k-th highest sum of each query, 0 where it has fewer."""
    first = sums.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s")))).where(F.col("at") <= k)
    return first.groupBy("query").agg(F.max(F.when(F.col("at") == k, F.col("s")).otherwise(0)).alias("bound"))


def search(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for every query, equal scores by ascending id.

    Terms are maximal runs of letters and digits of ASCII and of all other characters beyond it, A-Z lower-cased; a query's terms count once
    each. Null and empty texts have none: such documents are never found and such queries find nothing. Rows are documents and queries of their
    own, whatever their ids; rows without an id come last among equal scores. Empty tables give no rows; other columns are ignored.
    """
    asked = stash(term_counts(queries, query_id_col, query_text_col), "queries")
    vocabulary = stash(asked.where("term is not null").select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
    lists, documents, n_docs = index(docs, vocabulary, id_col, text_col)
    about = lists.groupBy("tid").agg(F.count(F.lit(1)).alias("df"), F.max("share").alias("top"))
    about = stash(about.withColumn("w", weight(F.col("df"), n_docs)).where("w > 0"), "weights")  # a list of weight 0 adds nothing to any score
    each = asked.where("term is not null").select(F.col("row").alias("query"), "term").join(vocabulary, "term").join(about, "tid").select("query", "tid", "w", "top")

    # 1: heads
    heads = lists.withColumn("at", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("share"), "row"))).where(F.col("at") <= k).drop("at")
    sums = heads.join(each, "tid").groupBy("query", "row").agg(F.sum(F.col("w") * F.col("share")).alias("s"))
    first = _kth(sums, k)
    per = each.groupBy("query").agg(F.count(F.lit(1)).alias("m")).join(first, "query")
    # the least contribution that is read, and the most that a list can add to a document for which it isn't read
    least = F.greatest(F.lit(1).cast("long"), F.expr("(bound + m - 1) div m"))
    asks = each.join(per.select("query", least.alias("least")), "query").withColumn("rest", F.least(F.col("least") - 1, F.col("w") * F.col("top")))
    asks = stash(asks.select("query", "tid", "w", "least", "rest"), "asks")
    few = F.broadcast if asks.count() <= SMALL else lambda df: df

    # 2: all lists down to the threshold
    down_to = asks.groupBy("tid").agg(F.min(F.expr("(least + w - 1) div w")).alias("floor"))
    read = lists.join(few(down_to), "tid").where("share >= floor").select("tid", "share", "row", "base").repartition("row")
    low = F.col("w") * F.col("base") < F.col("least")  # if not, the document's posting, were there one, would have been read
    met = read.join(few(asks), "tid").where(F.col("w") * F.col("share") >= F.col("least"))
    sums = met.groupBy("row", "query").agg(
        F.sum(F.col("w") * F.col("share")).alias("s"), F.sum("rest").alias("seen"), F.sum(F.when(low, F.col("rest")).otherwise(0)).alias("seen_low"), F.max("base").alias("base"),
    )
    by_weight = F.array_sort(F.collect_list(F.struct("w", "rest")))
    about = asks.groupBy("query").agg(F.sum("rest").alias("rests"), F.max("least").alias("least"), by_weight.alias("by_weight")).join(first, "query")
    # a plain upper bound first, then one of the lists alone that may hold something of this document
    hopeful = sums.join(few(about), "query").where("s + rests - seen >= bound")
    some = F.filter("by_weight", lambda x: x["w"] * F.col("base") < F.col("least"))
    hopeful = hopeful.withColumn("most", F.col("s") - F.col("seen_low") + F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x["rest"])).where("most >= bound")
    hopeful = stash(hopeful.select("query", "row", "s", "base", "most"), "hopeful")
    candidates = hopeful.join(few(_kth(hopeful, k)), "query").where("most >= bound").select("query", "row", "s", "base")

    # 3: what was not read of the candidates' lists
    candidates = stash(candidates, "candidates")
    missing = candidates.select("query", "row", "base").join(asks, "query").where(low).select("query", "row", "tid", "w", "least")
    found = missing.join(lists.select("tid", "row", "share"), ["tid", "row"]).where(F.col("w") * F.col("share") < F.col("least"))
    found = found.groupBy("query", "row").agg(F.sum(F.col("w") * F.col("share")).alias("more"))
    scored = candidates.join(found, ["query", "row"], "left").withColumn("score", F.col("s") + F.coalesce("more", F.lit(0)))
    named = scored.join(documents.withColumnRenamed("id", "doc_id"), "row")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    items = asked.where("term is null").select(F.col("row").alias("query"), F.col("id").alias("item_id"))
    return ranked.join(items, "query").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), corpus),
postings AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS part
  FROM counts JOIN sizes USING (doc_id) JOIN weights USING (term), corpus),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN postings USING (term) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
