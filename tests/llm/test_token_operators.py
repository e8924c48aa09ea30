import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F
from helpers import documents, empty, rows

from quern.llm import packing, piece_sampling, sharding, token_store
from quern.llm.common import fresh_path
from quern.llm.tokens import Encoder, public_vocabulary

TEXTS = ["", None, " a  b\n\n c\t d ", "I'm don't <|endoftext|> é", "ΑΣ ΟΔΟΣ", "日本 語 123 ½", "nul\0 in, text", "a\r\nb", "x, y. z!! w### ", "word here, " * 3000, "unbroken" * 3000]
FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}


def library(mode, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_vocabulary(FILES[mode]))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("mode", FILES)
@pytest.mark.parametrize("bounds", [{}, {"span": 500, "most_units": 20}])
def test_encoder(mode, bounds):
    assert [g.tolist() for g in Encoder(public_vocabulary(FILES[mode]), mode, **bounds).encode(TEXTS)] == library(mode, TEXTS)


@pytest.mark.parametrize("mode", FILES)
def test_words_are_encoded_without_offsets(mode):
    """Only the library's call that leaves out offsets is made; white space of every kind and in runs is no unit's."""
    texts = ["two  words\tand\x0bsome\x0cmore\r\nhere, now.", "\n\n", " \t ", "end \r", "a b  c   d"]
    made = Encoder(public_vocabulary(FILES[mode]), mode)
    made.tokenizer = type("Fast", (), {"encode_batch_fast": made.tokenizer.encode_batch_fast})
    assert [g.tolist() for g in made.encode(texts)] == library(mode, texts)


def test_encoder_forgets(spark):
    """Texts come out the same while the cache is thinned again and again."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 300) % 5000) + " the cat, sat" for _ in range(60)]
    for mode in FILES:
        made = Encoder(public_vocabulary(FILES[mode]), mode, most_units=300)
        got = [g.tolist() for k in range(0, 60, 6) for g in made.encode(texts[k:k + 6])]
        assert got == library(mode, texts) and len(made.at) < 2500
        assert len(made.uses) == len(made.at) == len(made.ends) - 1 and made.ends[-1] == len(made.flat)


def check_pieces(got, source, window):
    by_id = {d: np.array([*ids, 1], "<u4") for (d, _), ids in zip(source, library("word", [t for _, t in source]))}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(by_id[r.doc_id][r.start:r.start + r.length]) and r.doc_tokens == len(by_id[r.doc_id])
        docs[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    times = Counter(d for d, _ in source)
    for d, ids in by_id.items():
        covered = Counter(i for s, n in docs[d] for i in range(s, s + n))
        assert covered == {i: times[d] for i in range(len(ids))}
    full = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        full += at == window
    assert full >= len(sequences) - 1


def test_packing(spark):
    df = documents(spark, TEXTS + [f"some words {i} " * (i % 40) for i in range(150)])
    for window in (16, 256):
        check_pieces(packing.pack_documents(df, window=window, rows_per_slice=20).collect(), rows(df, "doc_id", "text"), window)
    assert packing.pack_documents(empty(spark)).isEmpty()
    own = documents(spark, TEXTS, repeat=False)
    pieces = packing.pack_documents(own, window=64)
    ids = [i for r in packing.sequences(own, pieces).collect() for i in r.ids]
    assert Counter(ids) == Counter(i for x in library("word", TEXTS) for i in [*x, 1])


def test_plan():
    rng = np.random.default_rng(0)
    for histogram in (np.bincount(rng.integers(1, 64, 4000), minlength=64), np.bincount([40] * 300, minlength=64), np.zeros(64, int), np.bincount([63] * 99 + [1], minlength=64)):
        plan = packing.Plan(histogram.astype(np.int64), 64)
        taken = defaultdict(set)
        for length, count in enumerate(histogram):
            for rank in range(count):
                for n, sequence, offset in plan.place(length, rank):
                    cells = set(range(offset, offset + n))
                    assert offset + n <= 64 and not cells & taken[sequence]
                    taken[sequence] |= cells
        assert sum(len(c) < 64 for c in taken.values()) <= 1 and set(taken) == set(range(plan.whole))
    parts = packing.combinations(64)
    assert (parts.sum(axis=1) == 64).all() and len({tuple(p) for p in parts}) == len(parts)
    x = packing.solve(parts, np.bincount(parts[5], minlength=64) * 10.0)
    assert (x >= 0).all()


def test_store(spark):
    df = documents(spark, TEXTS)
    got = sorted(rows(token_store.token_store(df)), key=lambda r: r[1])
    source = sorted(rows(df, "doc_id", "text"), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for (doc_id, start, n, crc), (want, text), ids in zip(got, source, library("byte", [t for _, t in source])):
        ids = np.array([*ids, 2], "<u4")
        assert (doc_id, start, n, crc) == (want, at, len(ids), zlib.crc32(ids))
        at += n
    assert len(got) == len(source) and token_store.token_store(empty(spark)).isEmpty()
    folder = fresh_path(spark, "test")
    files = token_store.write_store(documents(spark, TEXTS, repeat=False), folder)
    wanted = library("byte", TEXTS)
    for path, _, _ in files:
        opened = token_store.TokenFile(path)
        for k, doc_id in enumerate(opened.index["doc_id"].tolist()):
            if doc_id != token_store.NO_ID:
                assert opened.find(doc_id).tolist() == opened.ids(k).tolist() == [*wanted[doc_id], 2]
        assert opened.find(10**9) is None
    store, name = fs.FileSystem.from_uri(files[0][0])
    with store.open_output_stream(name) as f:
        f.write(b"broken" * 100)
    with pytest.raises(ValueError):
        token_store.TokenFile(files[0][0])


def test_store_sample(spark):
    """The dictionary depends on the rows alone, rows that share an id or have none are dealt out, long runs are cut from ids."""
    data = [(i if i % 3 else None if i % 2 else 7, f"some words of text {i} {i * 7 % 31} " * (1 + i % 50)) for i in range(1200)] + [(5000, "x y " * 20_000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    names = []
    for dealt in (df.repartition(3), df.orderBy("text").coalesce(2)):
        folder = fresh_path(spark, "test")
        token_store.write_store(dealt, folder)
        store, root = fs.FileSystem.from_uri(folder)
        names.append({f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.extension == "zdict"})
    assert names[0] == names[1] and len(names[0]) == 1
    got = sorted(rows(token_store.token_store(df)), key=lambda r: r[1])
    wanted = Counter((d, len(ids) + 1) for (d, _), ids in zip(data, library("byte", [t for _, t in data])))
    assert Counter((d, n) for d, _, n, _ in got) == wanted
    assert [d for d, *_ in got] == sorted((d for d, _ in data), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == list(itertools.accumulate((r[2] for r in got), initial=0))[:-1]
    path, long = public_vocabulary(FILES["byte"]), "x y z " * 9_000
    runs = token_store.sample_runs(spark.createDataFrame([(1, long), (1, long), (2, "ab")], "doc_id long, text string"), path, "byte", 5, 2)
    want = np.array(library("byte", [long])[0], "<u2").tobytes()
    assert sorted(map(len, runs)) == [2, 2 * token_store.SPAN] and max(runs, key=len) in want
    assert token_store.train_dictionary([b"ab"]) == b""


def brute_best_fit(sizes, capacity):
    room, where = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
        if fit:
            b = min(fit)[1]
        else:
            room.append(max(capacity, sizes[i]))
            b = len(room) - 1
        room[b] -= sizes[i]
        where[i] = b
    return where, len(room)


def runs_of(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def brute_even(sizes, n_bins):
    """Sizes in each bin: items over the mean of the rest alone, then the least capacity, tried one step after the other."""
    left, own = sorted(sizes, reverse=True), []
    while left and n_bins - len(own) > 1 and left[0] * (n_bins - len(own)) >= sum(left):
        own.append([left.pop(0)])
    bins, total, k = n_bins - len(own), sum(left), 0
    while True:
        where, used = brute_best_fit(left, -(-total * (sharding.STEPS + k) // (sharding.STEPS * bins)))
        if used <= bins:
            return own + [[s for s, w in zip(left, where) if w == b] for b in range(bins)]
        k += 1


def test_best_fit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 400):
        sizes = sorted(rng.integers(1, 100, n).tolist(), reverse=True)
        where, bins = brute_best_fit(sizes, 120)
        got = sharding.best_fit_decreasing(runs_of(sizes), 120)
        assert [b for dealt in got for b, k in dealt for _ in range(k)] == where
        assert n == 0 or sharding.best_fit_decreasing(runs_of(sizes), 120, bins - 1) is None
    for sizes in ([1000] + [1] * 500, rng.integers(1, 50, 800).tolist(), [5], [7, 7, 7], [], [9, 9] + [1] * 20):
        dealt = sharding.even_bins(runs_of(sizes), 5)
        got = [[] for _ in range(5)]
        for (size, n), parts in zip(runs_of(sizes), dealt):
            assert sum(k for _, k in parts) == n
            for b, k in parts:
                got[b] += [size] * k
        assert got == brute_even(sizes, 5)


def test_runs(spark):
    sizes = [8, 4095, 4096, 4097, 8191, 8192, 10_000_001, (1 << 40) + 12345]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(sharding.run_of(F.col("s"))).collect()]
    assert got == [s >> max(0, s.bit_length() - 12) << max(0, s.bit_length() - 12) for s in sizes]


def test_shards(spark):
    texts = [None, "", "a", *["same text"] * 300, *[f"text number {i} " * (1 + i % 9) for i in range(2000)]]
    df = documents(spark, texts)
    got = sharding.shard_documents(df, n_shards=4, rows_per_slice=100).collect()
    source = rows(df, "doc_id", "text")
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in source)
    homes, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        homes[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(h) == 1 for h in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(load) == 4 and max(load.values()) < 1.005 * min(load.values()) and {r.law for r in got} == {"bytes"}
    groups = Counter((t or "") for _, t in source)
    sizes = [n * (len(t.encode()) + 8) for t, n in groups.items()]
    held = defaultdict(Counter)
    for r in got:
        held[r.shard][r.text_crc32] += r.size
    exact = [s for s in sizes if s < 4096]
    if len(exact) == len(sizes):  # then runs are sizes, and the packing is that of brute force
        assert [sorted(held[b].values()) for b in range(4)] == [sorted(b) for b in brute_even(sizes, 4)]
    small = spark.createDataFrame([(i, f"{i % 150} " * (1 + i % 30)) for i in range(400)] + [(None, "a"), (None, "b"), (3, "c"), (3, "c")], "doc_id long, text string")
    held, sizes = defaultdict(Counter), Counter()
    for r in sharding.shard_documents(small, n_shards=7, rows_per_slice=3).collect():
        held[r.shard][r.text_crc32] += r.size
        sizes[r.text_crc32] += r.size
    assert max(sizes.values()) < 4096 and [sorted(held[b].values()) for b in range(7)] == [sorted(b) for b in brute_even(list(sizes.values()), 7)]
    assert sharding.shard_documents(empty(spark)).isEmpty()


def pieces_for(alpha=0.8):
    return piece_sampling.pieces_of(public_vocabulary("piece_bpe_32k.model"), alpha)


def weights(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_vocabulary("piece_bpe_32k.model"))
    return {p: (i, (2 + min(-model.get_score(i), 32000)) ** -0.8) for i, p in enumerate(pieces.text) if i >= 259 and (model.get_score(i) > -1e8 or p == "▁")}


def test_sampling_distribution():
    pieces = pieces_for()
    known = weights(pieces)

    def cuts(unit):
        if not unit:
            yield (), 1.0
        for k in range(1, len(unit) + 1):
            if unit[:k] in known:
                i, w = known[unit[:k]]
                for rest, v in cuts(unit[k:]):
                    yield (i, *rest), w * v

    every = {a + b: x * y for (a, x), (b, y) in itertools.product(cuts("▁the"), cuts("▁ca"))}
    total = sum(every.values())
    p = {k: w / total for k, w in every.items()}
    first, pairs, weight, n = Counter(), Counter(), Counter(), 6000
    before = None
    for d, s, ids, log_prob, _, inclusion in piece_sampling.sample(["the ca"] * n, list(range(n)), pieces, 3):
        key = tuple(ids.tolist())
        assert math.log(p[key]) == pytest.approx(log_prob, abs=1e-9)
        weight[key] += math.exp(-inclusion)
        if s == 0:
            first[key], before, seen = first[key] + 1, key, {key}
        else:
            assert key not in seen
            seen.add(key)
            pairs[before, key] += s == 1
    top = sorted(p, key=p.get)[::-1][:3]
    for a in top:
        assert first[a] / n == pytest.approx(p[a], abs=4 * math.sqrt(p[a] / n))
        assert weight[a] / n == pytest.approx(1, abs=0.15)
        for b in top:
            if a != b:
                want = p[a] * p[b] / (1 - p[a])
                assert pairs[a, b] / n == pytest.approx(want, abs=4 * math.sqrt(want / n) + 0.002)


def test_sampling_rows(spark):
    df = documents(spark, ["", None, "a", "the cat sat", "a  b\n　c é日 \U0001f600x  ", "x" * 2000, "nul\0 byte", "same", "same"])
    got = piece_sampling.sample_pieces(df, samples=3, with_ids=True, block=10).collect()
    texts, seen = dict(rows(df, "doc_id", "text")), defaultdict(list)
    for r in got:
        assert pieces_for().decode(r.ids) == (texts[r.doc_id] or "") and r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) and r.inclusion <= 0
        seen[r.doc_id].append((r.sample, r.perturbed, tuple(r.ids)))
    assert set(seen) == set(texts) and len(seen[5]) == 3 and {len(r.ids) for r in got if r.doc_id == 1} == {0}
    for d in (3, 5):
        order = sorted(seen[d])
        assert len({ids for _, _, ids in order}) == 3 and [p for _, p, _ in order] == sorted([p for _, p, _ in order], reverse=True)
    again = piece_sampling.sample_pieces(df.repartition(5), samples=3, with_ids=True).collect()
    assert sorted((str(r.doc_id), r.sample, tuple(r.ids)) for r in again) == sorted((str(r.doc_id), r.sample, tuple(r.ids)) for r in got)
    assert piece_sampling.sample_pieces(empty(spark)).isEmpty()


def segmentations(unit, known, pieces):
    """All ways to cut a unit into pieces, single characters without a piece as their bytes, with their weights."""
    if not unit:
        return {(): 1.0}
    out = {}
    for k in range(1, len(unit) + 1):
        if unit[:k] in known:
            (i, w), head = known[unit[:k]], 1
            steps = [((i,), w)]
        elif k == 1:
            data = unit[0].encode()
            steps = [(tuple(int(pieces.byte_id[b]) for b in data), (2.0 + 32000) ** (-0.8 * len(data)))]
        else:
            continue
        for ids, w in steps:
            for rest, v in segmentations(unit[k:], known, pieces).items():
                out[ids + rest] = w * v
    return out


def test_no_segmentation_is_lost():
    """Every text has min(samples, segmentations) samples, also where one of them has next to all the mass."""
    pieces, known = pieces_for(), weights(pieces_for())
    texts = ["a", "the", "is a", "house", "reading", "q", "zz", "é", "日本", "to be", "abcdefg", "\u2581x", " ", "a\u2581b"]
    for most in (2, 5, 40):
        got = defaultdict(list)
        for d, s, ids, log_prob, _, inclusion in piece_sampling.sample(texts, list(range(len(texts))), pieces, most):
            got[d].append((tuple(ids.tolist()), log_prob, inclusion))
        for d, text in enumerate(texts):
            unit = [u.replace("\u2581", "\ue000") for u in text.split(" ")]  # a sign of its own, without a piece
            every = {(): 1.0}
            for u in unit:
                more = segmentations("▁" + u, known, pieces)
                every = {a + b: x * y for a, x in every.items() for b, y in more.items()}
            sign = tuple(int(pieces.byte_id[b]) for b in "\ue000".encode()), tuple(int(pieces.byte_id[b]) for b in "\u2581".encode())

            def spelt(ids):
                for i in range(len(ids) - 2):
                    if ids[i:i + 3] == sign[0]:
                        ids = ids[:i] + sign[1] + ids[i + 3:]
                return ids

            every = {spelt(ids): w for ids, w in every.items()}
            total = sum(every.values())
            assert len(got[d]) == min(most, len(every)) == len({ids for ids, _, _ in got[d]}), text
            for ids, log_prob, inclusion in got[d]:
                assert math.log(every[ids] / total) == pytest.approx(log_prob, abs=1e-9)
                assert pieces.decode(list(ids)) == text and inclusion <= 0 and (inclusion == 0 or len(every) > most)


def test_decoding(spark):
    texts = ["", None, "a ▁ b▁", "日 é\n\t x", "nul\0 end ", "same", "same"]
    df = documents(spark, texts)
    got = piece_sampling.sample_pieces(df, samples=2, with_ids=True)
    assert all(r.round_trip and r.text_crc32 == zlib.crc32((dict(rows(df, "doc_id", "text"))[r.doc_id] or "").encode()) for r in got.collect())
    want = dict(rows(df, "doc_id", "text"))
    back = piece_sampling.decode_pieces(got.select("doc_id", "ids", "sample", F.lit(1).alias("decoded"))).collect()
    assert back and all(r.decoded == (want[r.doc_id] or "") for r in back)
    odd = spark.createDataFrame([(None, 1), ([], 2)], "ids array<int>, d int")
    assert sorted(rows(piece_sampling.decode_pieces(odd), "d", "decoded")) == [(1, None), (2, "")]
    assert piece_sampling.decode_pieces(odd.limit(0)).isEmpty()


def test_sequences_need_ids_of_their_own(spark):
    from quern.llm import packing

    df = spark.createDataFrame([(1, "one two three"), (None, "four five"), (2, "six")], "`a b` long, text string")
    pieces = packing.pack_documents(df, id_col="a b", window=8)
    assert pieces.count() >= 3
    docs = df.toDF("doc_id", "text")
    ids = [i for r in packing.sequences(docs, pieces).collect() for i in r.ids]
    assert ids.count(1) == 2  # two end ids: the row without an id is left out
    with pytest.raises(ValueError, match="id 1"):
        packing.sequences(docs.unionByName(docs), pieces)
