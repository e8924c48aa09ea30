import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern.functions import text as X
from quern.functions.tokens import tokenize
from quern.operators import pack
from quern.operators.contamination import shared_runs
from quern.plans import catalog
from quern.plans.manifest_view import DOCS, manifest_view

TABLES = "documents labels benchmark conversations events".split()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, sf, name, tmp_path):
    out = f"{tmp_path}/out"
    catalog.QUERIES[name](spark, sf).write.parquet(f"file:{out}")
    db = duckdb.connect()
    got = db.sql(f"SELECT * FROM '{out}/*.parquet'")
    if name not in catalog.ORACLE_SQL:
        assert db.sql(f"SELECT count(*) FROM '{out}/*.parquet'").fetchall()[0][0] > 0
        return
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = ", ".join(f'"{c}"' for c in sorted(want.columns))
    assert sorted(db.sql(f"SELECT {cols} FROM got").fetchall(), key=str) == sorted(db.sql(f"SELECT {cols} FROM want").fetchall(), key=str)


def test_entry(spark):
    assert entry.entry(spark).columns == ["dataset", "split", "examples", "hours"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_word_blocks(spark, sf):
    """Against the stream of hashed words of all texts, cut by hand."""
    import xxhash

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    ids = lambda t: [xxhash.xxh64_intdigest(w.encode(), 42) % 2**30 for w in t.split()]
    stream = [t for (text,) in db.sql(f"SELECT text FROM {DOCS} ORDER BY doc_id").fetchall() if text.split() for t in [*ids(text), 0]]
    blocks = pack.pack_blocks(manifest_view(spark, sf), tokenize("word", F.col("text")), 0, 2048, ["doc_id"], X.word_count(F.col("text")))
    got = {r.block_id: r.tokens for r in blocks.collect()}
    assert got == {k: stream[k * 2048:(k + 1) * 2048] for k in range(len(stream) // 2048)} and len(got) > 10
    assert catalog.QUERIES["token_blocks_word"](spark, sf).count() == len(got)


def test_shared_runs_against_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t or "").lower().split(" ")
    grams = lambda x, n: {" ".join(x[i:i + n]) for i in range(len(x) - n + 1)}
    for n in (1, 3, 8):
        wanted = set().union(*[grams(words(r.text), n) for r in items.collect()])
        want = {r.doc_id: len(grams(words(r.text), n) & wanted) for r in docs.collect()}
        assert {r.doc_id: r.shared for r in shared_runs(docs, items, n).collect()} == {k: v for k, v in want.items() if v}
    assert shared_runs(docs.limit(0), items, 8).collect() == [] == shared_runs(docs, items.limit(0), 8).collect()
