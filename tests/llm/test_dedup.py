import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from helpers import documents, empty, rows
from pyspark.sql import functions as F

from quern.llm import exact_dedup, near_copies, simhash
from quern.llm.common import row_key, stash
from quern.llm.components import components


def body(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def check_exact(got, source):
    groups = defaultdict(list)
    for doc_id, text in source:
        groups[body(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = []
    for text, members in groups.items():
        keep = min(members)[3]
        want += [(m[3], keep, len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    assert sorted((r[0] is None, r[0] or 0, *r[1:3], r[4]) for r in got) == sorted((w[0] is None, w[0] or 0, *w[1:]) for w in want)
    kept = defaultdict(int)
    for r in got:
        kept[r[4]] += r[3]
    assert set(kept.values()) == {1}


def test_exact(spark):
    df = documents(spark)
    source = rows(df, "doc_id", "text")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check_exact(rows(exact_dedup.exact_dedup(df), *cols), source)
    check_exact(rows(exact_dedup.exact_dedup(df, hash_fn=lambda t: F.substring(F.md5(t), 1, 0)), *cols), source)  # every hash collides
    assert exact_dedup.exact_dedup(empty(spark)).isEmpty()
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(map(body, [r[0] for r in rows(kept, "text")])) == sorted({body(t) for _, t in source})


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    left, out = set(range(len(prints))), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            i = todo.pop()
            seen.add(i)
            near = [j for j in left if (prints[i] ^ prints[j]).bit_count() <= 2]
            left.difference_update(near)
            todo += near
        for i in seen:
            out[i] = frozenset(seen)
    return out


def test_simhash_documents(spark):
    df = documents(spark, ["a b c d e f g", "A B C D E F G", "a b c d e f", "", None, "x", "one two", *["p q r s t u v w %d" % i for i in range(5)]])
    source = rows(df, "doc_id", "text")
    prints = [brute_print(t) for _, t in source]
    groups = classes(prints)
    got = sorted(rows(simhash.simhash_dedup(df)), key=str)
    want = sorted([(d, f"{prints[i]:016x}", min(source[j][0] for j in groups[i] if source[j][0] is not None) if any(source[j][0] is not None for j in groups[i]) else None) for i, (d, _) in enumerate(source)], key=str)
    assert got == want
    assert simhash.simhash_dedup(empty(spark)).isEmpty()
    long = "word %d " * 10
    assert simhash.fingerprint(long * 20_000) == brute_print(long * 20_000) and simhash.BLOCK < 200_000


def test_simhash_links(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base[:6]:  # crowds within two bits, chains of near ones, and pairs three bits apart
        values |= {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    for b in base[6:20]:
        values |= {b ^ 1, b ^ 3, b ^ 7 ^ (1 << 60), b ^ 15 ^ (7 << 60)}
    values = sorted(values | {0, (1 << 64) - 1, 1, 3})
    want = classes(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    for crowd, grids in ((64, (16, 32)), (4, (16, 32)), (0, (16, 32)), (0, (8,)), (4, (32,))):
        pairs = simhash.near_pairs(spark.createDataFrame(signed, "fp long"), grids, crowd)[0].collect()
        assert all((a ^ b).bit_count() <= 2 or bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2 for a, b in pairs) and len(pairs) == len(set(pairs))
        index = {s[0]: i for i, s in enumerate(signed)}
        left = list(range(len(values)))

        def find(i):
            while left[i] != i:
                i = left[i]
            return i

        for a, b in pairs:
            left[find(index[a])] = find(index[b])
        groups = defaultdict(set)
        for i in range(len(values)):
            groups[find(i)].add(i)
        assert {frozenset(g) for g in groups.values()} == set(want.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(20)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, **{50 + i: 50 for i in range(20)}, 100: 50, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_near_copies_keep_one(spark):
    rng = np.random.default_rng(0)
    text = " ".join(f"w{i}" for i in rng.integers(0, 5000, 3000))
    kept = rows(simhash.keep_one(documents(spark, [text, text + " end", "other words entirely here"], repeat=False)), "doc_id")
    assert (2,) in kept and (0,) in kept


def jaccard(a, b, width=5):
    a, b = ({tuple(t.lower().split()[i:i + width]) for i in range(max(1, len(t.split()) - width + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_planted_copies_go(spark):
    """The near copies of 60 texts at similarities from 0.8 on go, unlike texts and copies under 0.8 stay."""
    rng = random.Random(5)
    texts, want = [], set()
    for k in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for edits in (0, 1, 2, 4, 6, 8):  # an edited word breaks five shingles
            copy = list(base)
            for at in range(edits):
                copy[(at * 37 + k) % 290 + 5] = f"new{at}"
            if edits and jaccard(" ".join(base), " ".join(copy)) >= 0.8:
                want.add(len(texts))
            texts.append(" ".join(copy))
    same = [jaccard(texts[i], texts[i - i % 6]) for i in want]
    assert min(same) < 0.82 and max(same) > 0.95 and len(want) > 150
    kept = {r[0] for r in rows(simhash.keep_one(documents(spark, texts, repeat=False)), "doc_id")}
    assert not kept & want and set(range(0, 360, 6)) <= kept
    for i in set(range(360)) - kept:  # what goes has an earlier near copy
        assert any(jaccard(texts[i], texts[j]) >= 0.8 for j in range(i - i % 6, i))
    assert not any(jaccard(texts[i], texts[j]) >= 0.8 for i in kept for j in range(i - i % 6, i) if j in kept)


def test_crowd_of_copies(spark):
    """Crowded buckets: copies of one text go, texts that are unlike but meet stay."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    near = [" ".join([*base[:i], "x", *base[i + 1:]]) for i in range(100)]
    unlike = [" ".join(f"v{rng.randrange(9999)}" for _ in range(50)) for _ in range(30)]
    df = documents(spark, near + unlike, repeat=False)
    keyed = df.select(*[c.alias(k) for k, c in row_key("doc_id", "text").items()], F.col("doc_id").alias("id"), "text")
    made = near_copies.sketches(keyed, simhash.fingerprint_of)
    meet = made.select("row", F.lit(1).cast("long").alias("bucket"))
    gone = near_copies.near_copies(keyed, made, classes=meet, crowd=4).join(made, ["k", "k2"])
    gone = {r[0] for r in rows(gone, "id")}
    assert gone == set(range(1, 100))


def test_rows_without_own_id(spark):
    """Rows that share an id or have none are judged one by one."""
    rng = random.Random(7)
    text = [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(6)]
    near = text[0] + " end"
    data = [(1, text[0]), (None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (7, text[3]), (7, text[4]), (3, text[4]), (7, text[5]), (7, text[5])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = [(1, text[0]), (None, text[1]), (None, text[2]), (7, text[3]), (3, text[4]), (7, text[5])]
    assert sorted(rows(exact_dedup.keep_one(df)), key=str) == sorted(want, key=str)
    assert sorted(rows(simhash.keep_one(df)), key=str) == sorted(want, key=str)
    df = spark.createDataFrame([*want, (None, near), (7, near)], "doc_id long, text string")
    assert sorted(rows(simhash.keep_one(df)), key=str) == sorted(want, key=str)
    swapped = spark.createDataFrame([(None, text[0]), (9, near), (None, text[1])], "doc_id long, text string")
    assert sorted(rows(simhash.keep_one(swapped)), key=str) == sorted([(9, near), (None, text[1])], key=str)


CLASH = "doc_id long, text string, __id long, __gone int, __row int, maybe boolean, stays int, k string, k2 int, d int, h int, sha int, `a.b` int, `od``d` int"


def brute_near(data, width=5):
    """What stays by the definition: in order of id (null last), a row goes for an earlier one that stays or went."""
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0))
    stay = []
    for i in order:
        if not any(jaccard(data[i][1] or "", data[j][1] or "", width) >= 0.8 for j in order[:order.index(i)]):
            stay.append(i)
    return stay


def test_clashing_columns(spark):
    """Names that the operators use inside, names with dots and quotes, null and repeated ids, ties, repeated rows."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(8)]
    data = [(1, texts[0]), (1, texts[1]), (None, texts[0]), (None, texts[2]), (2, texts[2] + " "), (3, None), (4, ""), (5, texts[3]), (5, texts[3]), (6, texts[3])]
    df = spark.createDataFrame([(*r, 1, 2, 3, True, 4, "k", 5, 6, 7, 8, 9, 10) for r in data], CLASH)
    for got in (exact_dedup.keep_one(df), simhash.keep_one(df)):
        assert got.columns == df.columns and [t for _, t in got.dtypes] == [t for _, t in df.dtypes]
        found = rows(got)
        assert all(r[2:] == (1, 2, 3, True, 4, "k", 5, 6, 7, 8, 9, 10) for r in found)
        assert sorted(body(r[1]) for r in found) == sorted({body(t) for _, t in data})
        assert {r[0] for r in found if r[1] and r[1].strip() in (texts[2], texts[3])} == {2, 5}
        assert got.where("__gone = 2").count() == len(found)
    assert exact_dedup.keep_one(df.limit(0)).isEmpty() and simhash.keep_one(df.limit(0)).isEmpty()


def test_stays_as_by_brute_force(spark):
    """Mixed copies of few texts: the pairs that meet are all pairs at 0.8 or more, so what stays is what brute force keeps."""
    rng = random.Random(9)
    data = []
    for k in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 4)):
            copy = list(base)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "new"
            data.append((rng.choice([None, rng.randrange(50), 1000 + len(data)]), " ".join(copy)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert all(jaccard(a[1], b[1]) < 0.8 for i, a in enumerate(kept) for b in kept[:i])
    for row in data:  # what goes has a near copy, and clean texts stay
        if row not in kept:
            assert any(other != row and jaccard(row[1], other[1]) >= 0.8 for other in data)
    alone = [r for r in data if not any(o is not r and jaccard(r[1], o[1]) >= 0.8 for o in data)]
    assert set(alone) <= set(kept)


def test_crowded_buckets_are_dealt_by_rare_shingles(spark):
    """Rows with one long header share bands; unlike ones are hardly compared, and near copies among them are all found."""
    rng = random.Random(3)
    header = [f"h{i}" for i in range(120)]
    data, pairs = [], []
    for i in range(900):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 100))]
        data.append((2 * i, " ".join(header + own)))
        if i % 30 == 0:  # a copy at about 0.9
            own[rng.randrange(len(own))] = "new"
            data.append((2 * i + 1, " ".join(header + own)))
            pairs.append(2 * i + 1)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    rows_ = df.select(F.xxhash64("doc_id", "text").alias("k"), F.xxhash64("text").alias("k2"), F.col("doc_id").alias("id"), "text")
    made = near_copies.sketches(rows_, simhash.fingerprint_of, 5)
    at = F.struct(F.col("id").isNull().alias("unnamed"), "id", "k", "k2", "row", "m", *near_copies._MAPS).alias("at")
    sets = made.sparkSession.createDataFrame([(r.k, r.k2, [int(x) for x in near_copies.distinct(near_copies.shingle_hashes(r.text, 5)).view("<i8")]) for r in rows_.collect()], "k long, k2 long, set array<long>")
    dealt = near_copies.rarest(made.select(at), sets, 0.8)
    sizes = [r["count"] for r in dealt.groupBy("bucket").count().collect()]
    assert sum(n * (n - 1) // 2 for n in sizes) < len(data) ** 1.5 / 2
    lost = near_copies.near_copies(rows_, made, 5, 0.8, None, crowd=16)
    kept = {r[0] for r in rows_.join(lost, ["k", "k2"], "left_anti").select("id").collect()}
    texts = dict(data)
    assert {i for i in texts if i not in kept} == {p for p in pairs if jaccard(texts[p], texts[p - 1]) >= 0.8} and len(kept) < len(data)


def test_sieve(spark):
    from quern.llm.common import sieve

    rng = random.Random(1)
    keys, others = ([rng.getrandbits(64) - (1 << 63) for _ in range(500)] for _ in range(2))
    keys += [0, -1, (1 << 63) - 1, -(1 << 63), 32767, 32768]
    rows_ = spark.createDataFrame([(k, True) for k in keys] + [(k, False) for k in others], "x long, want boolean")
    for bits in (1 << 26, 1 << 15, 1 << 8):
        got = sieve(rows_, "x", spark.createDataFrame([(k,) for k in keys], "k long"), bits).collect()
        assert len(got) == len(keys) + 500 and all(r.maybe for r in got if r.want)
        if bits > 1 << 20:
            assert not any(r.maybe for r in got if not r.want)
    none = sieve(rows_, "x", spark.createDataFrame([], "k long"))
    assert not none.where("maybe").count() and none.count() == len(keys) + 500


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 30, 400, 5000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for share in (0, 0.05, 0.3, 1):
            b = np.unique(np.where(rng.random(len(a)) < share, rng.integers(0, 1 << 64, len(a), np.uint64), a))
            apart = sum(int(x).bit_count() for x in (near_copies.parities(a) ^ near_copies.parities(b)).view(np.uint64))
            assert apart <= len(np.setxor1d(a, b)) and (share or not apart)


def broadcast(df):
    """Whether the optimizer, by its own estimate of sizes, broadcasts a side of a join."""
    return "BroadcastHashJoin" in df._jdf.queryExecution().sparkPlan().toString()


def test_grid_points_are_not_broadcast_by_the_size_of_the_fingerprints_file(spark, monkeypatch):
    # Spark's own limit of 10 MB holds in this session; a file of fingerprints below it makes 33 times as many points.
    fps, found, write = stash(spark.range(2_000).select(F.xxhash64("id").alias("fp")), "nodes"), [], simhash.stash_at
    monkeypatch.setattr(simhash, "stash_at", lambda df, path: found.append(broadcast(df)) or write(df, path))
    links, _ = simhash.near_pairs(fps, crowd=1)
    assert found == [False, False] and not broadcast(links)


def test_members_of_buckets_are_not_broadcast_by_the_size_of_their_file(spark):
    texts = spark.createDataFrame([(i, i, i, f"text number {i % 40} of a few words") for i in range(80)], "k long, k2 long, id long, text string")
    made = near_copies.sketches(texts, simhash.fingerprint_of)
    at = F.struct(F.col("id").isNull().alias("unnamed"), "id", "k", "k2", "row", "m", *near_copies._MAPS).alias("at")
    members = stash(made.select(F.explode("buckets").alias("bucket"), at), "meets")
    leaders = near_copies._leaders(members, 0.8)
    assert not any(map(broadcast, [leaders, *near_copies._small_and_large(members, 64)]))
    assert leaders.count() == 40
