import hashlib
import itertools

from helpers import documents, empty, rows
from pyspark.sql import functions as F

from quern.llm import multiset_hash as M


def vector(text):
    """The fingerprint's lanes of digests by hand."""
    lanes = [0] * M.LANES
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            digest = hashlib.sha512(line.encode()).hexdigest()
            lanes = [(x + int(digest[8 * i:8 * i + 8], 16)) % 2**32 for i, x in enumerate(lanes)]
    return lanes


def edits(pairs):
    """(id, n_chars, digest of the edited text, old text, edited text) by brute force; pairs in descending order."""
    out = []
    for i, (key, text) in enumerate(pairs):
        after, m = pairs[(i + 1) % len(pairs)][1], len(text) // 2
        new = text[:len(text) - m] + after[:m]
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), text, new))
    return out


def test_lanes_of_digests_and_order(spark):
    texts = ["a b c\nd e f", "d e f\na b c", "a b c\n\n \t\nd e f", "a b c\na b c\nd e f", "", " \n\x0b\n", "ü 😀\x00x"]
    got = M.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.vector[:M.LANES] for r in got] == [vector(t) for t in texts]
    assert got[0].fingerprint == got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    assert got[4].fingerprint == got[5].fingerprint and set(got[4].vector) == {0}
    back = spark.createDataFrame([(r.doc_id, r.fingerprint) for r in got], "doc_id long, f string").select("doc_id", M.decode(F.col("f")).alias("v"))
    assert {r.doc_id: r.v for r in back.collect()} == {r.doc_id: r.vector for r in got}
    assert all(len(r.fingerprint) == 4 * -(-4 * (M.LANES + M.MARKS) // 3) for r in got)


def test_insert_and_delete(spark):
    texts = ["one two three four", "five\nsix six six", "one two three four\nfive\nsix six six"]
    a, b, both = (r.vector for r in M.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect())
    row = spark.createDataFrame([(a, b, both)], "a array<long>, b array<long>, c array<long>")
    got = row.select(M.insert(F.col("a"), F.col("b")), M.delete(F.col("c"), F.col("a")), M.delete(M.delete(F.col("c"), F.col("a")), F.col("b")) == M.zero()).first()
    assert tuple(got) == (both, b, True)


def test_edited_fingerprints_are_those_of_the_edited_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    pairs = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    want = edits(pairs)
    got = {r.doc_id: r for r in M.edited_fingerprints(docs).collect()}
    assert {(k, n, sha) for k, n, sha, _, _ in want} == {(r.doc_id, r.n_chars, r.edited_sha256) for r in got.values()}
    plain = lambda at: {r.doc_id: r for r in M.fingerprint(spark.createDataFrame([(w[0], w[at]) for w in want], "doc_id long, text string")).collect()}
    old, new = plain(3), plain(4)
    assert all(got[k].fingerprint == old[k].fingerprint and got[k].edited_fingerprint == new[k].fingerprint for k in got)
    both = [(k, old[k].vector, new[k].vector, old[pairs[(i + 1) % len(pairs)][0]].vector) for i, (k, _) in enumerate(pairs)]
    near = spark.createDataFrame(both, "k long, a array<long>, b array<long>, c array<long>").select("k", M.likeness(F.col("a"), F.col("b")).alias("ab"), M.likeness(F.col("a"), F.col("c")).alias("ac"))
    for r in near.collect():
        assert abs(got[r.k].near_edited - r.ab) < 1e-9 and abs(got[r.k].near_next - r.ac) < 1e-9
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)


def test_likeness_follows_the_cosine_of_windows(spark):
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join(words[:1500] + [f"x{i}" for i in range(500)]), " ".join(f"y{i}" for i in range(2000))]
    v = [r.vector for r in M.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    pairs = spark.createDataFrame([(v[i], v[j]) for i, j in itertools.combinations(range(3), 2)] + [(v[0], v[0])], "a array<long>, b array<long>")
    near = [r[0] for r in pairs.select(M.likeness(F.col("a"), F.col("b"))).collect()]
    assert abs(near[0] - 0.75) < 0.2 and near[1] < 0.3 and near[2] < 0.3 and near[3] == 1.0


def test_odd_rows(spark):
    docs = documents(spark)
    got = M.edited_fingerprints(docs).collect()
    assert len(got) == docs.count()
    order = {r.doc_id: r.text or "" for r in docs.collect()}
    by_id = [(r.doc_id, r.n_chars, r.edited_sha256) for r in got]
    # the two repeated rows come twice each, next to their equals; the row without an id comes last
    ids = sorted((k for k in (r.doc_id for r in docs.collect()) if k is not None), reverse=True)
    pairs = [(k, order[k]) for k in ids] + [(None, "no id")]
    assert sorted(by_id, key=str) == sorted([w[:3] for w in edits(pairs)], key=str)
    assert rows(M.edited_fingerprints(empty(spark))) == [] and rows(M.fingerprint(empty(spark))) == []
    alone = M.edited_fingerprints(documents(spark, ["a b\nc d"], repeat=False)).first()
    assert (alone.near_next, alone.n_chars) == (1.0, 7)


def test_blocks_meet_at_their_edges(spark):
    texts = [(i, f"text number {i}\n" * (i % 5 + 1)) for i in range(3 * M.BLOCK)]
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in M.edited_fingerprints(spark.createDataFrame(texts, "doc_id long, text string").repartition(7)).collect()}
    assert got == {w[:3] for w in edits(texts[::-1])}
