import math
import random
import re
from collections import Counter

import duckdb
import pytest
from helpers import documents, empty, rows

from quern.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """docs and items: (id, text). The contract's arithmetic over every document and item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    full = [b for _, b in bags if b]
    n_docs, n_terms, df = len(full), sum(sum(b.values()) for b in full), Counter(w for b in full for w in b)
    out = []
    for item, text in items:
        asked = set(terms(text))
        scored = []
        for at, (i, bag) in enumerate(bags):
            n, s = sum(bag.values()), 0
            for w in asked & set(bag):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                s += weight * (1000000000 * bag[w] // (1000 * bag[w] + 20 * (50 + 50 * n * n_docs // n_terms)))
            if s > 0:
                scored.append((-s, i is None, i or 0, at, i))
        out += [(item, r, x[4], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_matches_sql(spark, sf):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(db.sql(R.SQL).fetchall())
    got = R.search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted(rows(got, "item_id", "rank", "doc_id", "score")) == want and len(want) > 1000


@pytest.mark.parametrize("seed, k", [(0, 1), (1, 3), (2, 10), (3, 50)])
def test_against_brute_force(spark, seed, k):
    """Few words and short texts, so that scores are equal often and thresholds leave much unread."""
    pick = random.Random(seed)
    word = lambda: f"{'Ab'[pick.random() < 0.5]}{min(int(pick.expovariate(0.12)), 60)}"
    docs = [(i, " ".join(word() for _ in range(pick.randint(0, 25)))) for i in range(300)]
    docs += [(300 + i, docs[i][1]) for i in range(60)]  # copies, with equal scores
    items = [(i, ", ".join(word() for _ in range(pick.randint(0, 12)))) for i in range(25)]
    got = R.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(rows(got), key=str) == brute(docs, items, k)


def test_odd_rows(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "SAME text, HERE", "x", 1), (2, None, "x", 1), (3, "no id a ﬁ", "x", 1), (3, "é straße", "x", 1), (None, "word nul in", "x", 1), (7, "absent", "x", 1)], "item_id long, text string, doc_id string, rank int")
    got = R.search(docs, items, 5)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(pairs, [(r.item_id, r.text) for r in items.collect()], 5)
    assert sorted(rows(got), key=str) == want and got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(R.search(empty(spark), items, 5)) == []
    assert rows(R.search(docs, items.limit(0), 5)) == []
    assert rows(R.search(documents(spark, [None, "", " ,;"], repeat=False), items, 5)) == []
