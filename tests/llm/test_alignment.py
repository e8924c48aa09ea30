import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, empty, rows

from quern.llm import alignment as L
from quern.llm.tokens import public_vocabulary

PATHS = public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model")


def brute(texts):
    """What the contract says, from the libraries' own encodings of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters, names = L.byte_letters(), {i: t for t, i in a.get_vocab().items()}
    found = []
    for text in texts:
        data = (" " + (text or "")).encode()
        ai = a.encode(" " + (text or ""), add_special_tokens=False).ids
        bi = b.encode(text or "")
        ab = [bytes(letters[c] for c in names[i]) for i in ai]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in bi]
        if not text or b"".join(ab) != data or b"".join(bb) != data:
            found.append((0, 0, [], []))
            continue
        ae, be = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, links, i0, j0 = [], [], 0, 0
        for cut in sorted(set(ae) & set(be)):
            i, j = ae.index(cut) + 1, be.index(cut) + 1
            groups.append(",".join(map(str, ai[i0:i])) + "|" + ",".join(map(str, bi[j0:j])))
            links.append((ai[i - 1], bi[j - 1]))
            i0, j0 = i, j
        found.append((len(ai), len(bi), groups, links))
    count = Counter(x for f in found for x in f[3])
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(na, nb, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), sha(g)) for na, nb, g, x in found]


HARD = [
    "plain words, with marks; and: more!! a.b,c 3.14 x'll don't", "  two  spaces\n\nand lines \n here \t tab\r\nend ", "a▁b", "nul\0 in\0it", "<s> </s> <unk> <|endoftext|> <0x41>",
    "ﬁ é é Straße ñandú 你好 \U0001f600\U0001f600 क्षि", "x y　z w  ", " ", "\n", "\n\n", "a", " a", "a ", "a\n", "\na", "!!??..", "-- --a --", "word" * 300, "...\n...\n", "A,B,C;D", "1,2,3", "»,« é, ü.", "a\x85b \x85c",
]


def test_units_encode_as_whole_texts(spark, sf):
    texts = HARD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in L.align_tokens(docs).collect()}
    for i, (text, want) in enumerate(zip(texts, brute(texts))):
        assert got[i] == want, text[:60]


@pytest.mark.parametrize("span", [1, 7, 50])
def test_spans_change_nothing(span, monkeypatch):
    made, text = L.Aligner(*PATHS, most_units=5), "".join(t for t in HARD if "▁" not in t) * 3
    monkeypatch.setattr(L, "SPAN", 1 << 30)
    (whole,) = made.align([text])
    monkeypatch.setattr(L, "SPAN", span)
    cut, same, none, odd, again = made.align([text, text, None, "a▁b " + text, text])
    assert none[:4] == odd[:4] == (0, 0, 0, "") and same[:4] == again[:4] == cut[:4]
    assert whole[:4] == cut[:4] and whole[2] > 0
    assert (whole[4] == cut[4]).all() and (whole[5] == cut[5]).all()


def test_entries_hold_large_multiplicities():
    pairs, entries, links = L._postings([0, 3], [(np.array([5, 9]), np.array([2 * L.MOST + 7, 1])), (np.array([5]), np.array([2]))])
    assert pairs.tolist() == [5, 9] and links.tolist() == [2 * L.MOST + 9, 1]
    back = Counter()
    for p, es in zip(pairs.tolist(), entries.to_pylist()):
        for e in es:
            back[p, e >> 20] += e & L.MOST
    assert back == {(5, 0): 2 * L.MOST + 7, (5, 3): 2, (9, 0): 1}


def test_odd_rows(spark):
    docs = documents(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, *w) for (i, _), w in zip(texts, brute([t for _, t in texts]))]
    got = L.align_tokens(docs)
    assert sorted(rows(got), key=str) == sorted(want, key=str)
    assert rows(L.align_tokens(empty(spark))) == []
