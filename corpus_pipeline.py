"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, and returns a table that is written and read
again as the next one's ``docs``. All but the last return the columns of ``documents``:

1. quality classifier: documents that score under 0.3 go;
2. exact deduplication: of texts equal but for white space the longest stays, then the smallest id;
3. near-deduplication by SimHash classes and MinHash bands: a row with an earlier one at Jaccard similarity 0.8 or more goes;
4. secret scan: secrets are masked in place, no document goes;
5. packing into windows of 2048 ids: one row for each piece.

Null texts count as empty, empty tables give empty results, rows without an id are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup, packing, quality_classifier, secrets, simhash
from quern.llm.common import stash, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier scores 0.3 or more, see quality_classifier.keep_good."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts equal but for white space, see exact_dedup.keep_one."""
    return exact_dedup.keep_one(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without an earlier near copy, see simhash.keep_one."""
    return simhash.keep_one(docs)


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked, see secrets.mask_secrets."""
    return secrets.mask_secrets(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, see packing.pack_documents. Its workers share an executor with what earlier stages have left there, so they keep less."""
    return packing.pack_documents(docs, window=2048, end_id=1, units=100_000, span=1 << 20)


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", distinct_documents),
    ("simhash_near_dedup", unlike_documents),
    ("secret_scan", masked_documents),
    ("packing", packed_documents),
]

#: A fitted classifier and a tokenizer have no SQL. The tests check the stages on a small table, and the operators behind them on their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
