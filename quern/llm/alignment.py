"""Alignment of two tokenizers over a corpus: groups between common cuts, and how often each pair of ids ends together.

Every text is encoded by a byte-level vocabulary (A, over a space and the text) and by a piece model (B, which adds that space). Where a token
of A and one of B end at the same byte, the two are linked and both token streams are cut into groups.

Both tokenizers are taken over units of a text, at whose edges neither lets a token or a merge through: before a space and
around a line feed between two characters that aren't white space, and between a letter and one of some marks. A unit's
groups are worked out once while it is cached, and a text's are those of its units in order.

Plan, a cogroup of postings. A task turns a run of documents into postings: for each linked pair, the documents of the run that have it, with
multiplicities. Postings are written out with a slim row of each document. Counts of pairs come from the postings' totals, combined on the
map side; the highest count of each B id comes from the counts. Then postings and counts, both shuffled by the pair and sorted by
B id, then A id, are merged as sorted streams that spill; each posting gives its documents their contributions, which are summed by document,
again combined first. Pairs are dealt by both ids, since a B id alone may hold a third of all rows, and a pair's postings
hold a row for each run of documents, which a join may split further.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_arrow, quoted, stash, text_of
from quern.llm.tokens import _LETTERS, _WS, _tokenizer, public_vocabulary

#: Documents of a run at most, and most occurrences that one entry of a posting holds (more take several entries).
RUN, MOST = 1 << 11, (1 << 20) - 1
#: Units that a worker keeps; characters of a text that are worked on at a time.
UNITS, SPAN = 250_000, 1 << 20
_PLAIN = re.compile(" " + _LETTERS).fullmatch
_ODD = re.compile(f"[ \\n][{_WS}]|[{_WS}][ \\n]|\\0")
_SAFE = re.compile(f"(?<=[^{_WS}])(?= [^{_WS}])|(?<=[^{_WS}])(?=\\n[^{_WS}])|(?<=[^{_WS}]\\n)(?=[^{_WS}])")
_CUT = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")
_EDGE = re.compile(f"([,.!?;:|#$%&*])(?<={_LETTERS[:-1]}.)")


def byte_letters() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes bytes as: printable Latin ones stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def parts(text: str) -> list[str]:
    """The units of a text that begins with a space; in order they make it up."""
    if _ODD.search(text):
        return [u for u in _SAFE.split(text) if u]
    marked = _EDGE.sub("\0\\1", text).replace("\n", "\0\n\0").replace(" ", "\0 ")
    return [u for u in marked.split("\0") if u]


def spans(text: str, span: int = 0) -> Iterator[str]:
    """A text that begins with a space in spans of some ``span`` characters, cut where units are."""
    start, span = 0, span or SPAN
    while len(text) - start > span:
        cut = _CUT.search(text, start + span)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Aligner:
    """Groups of units by two vocabulary files, with a bounded cache."""

    def __init__(self, bytes_path: str, pieces_path: str, most_units: int = 0) -> None:
        import sentencepiece

        self.a = _tokenizer(bytes_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(f"[^▁]▁|{_LETTERS[:-1]}[,.!?;:|#$%&*]|.\\n|\\n.", p) for i, p in enumerate(pieces) if not self.b.is_byte(i)):
            raise ValueError("a piece reaches over the edge of a unit")
        self.lead = self.b.encode("\n")  # what stands before a unit that is encoded after a line feed
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in each], np.int64) for each in (self.a_bytes, self.b_bytes))
        self.a_first = np.array([t[:1] == b" " for t in self.a_bytes])
        self.b_first = np.array([t[:1] == b" " for t in self.b_bytes])
        #: Every id in decimals, with each thing that may follow it: in a stream, between streams, between groups, at a unit's end.
        self.digits = [f"{i}{end}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for end in ",|;\n"]
        self.most_units = most_units or UNITS
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        #: By unit: tokens of A and of B, batches that had it, its links among ``flat``. A unit whose bytes a tokenizer changed has no links.
        self.sizes, self.uses, self.flat, self.ends = np.zeros((0, 2), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _thin(self) -> None:
        """Forget the units that one batch alone had, and of the others the rarer ones if they fill over half of the cache."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.most_units // 2:
            keep = np.sort(keep[np.argpartition(-self.uses[keep], self.most_units // 2)[:self.most_units // 2]])
        units, which = list(self.at), keep.tolist()
        self.at, self.groups = {units[i]: k for k, i in enumerate(which)}, [self.groups[i] for i in which]
        self.flat, size = _runs(self.flat, self.ends, keep)
        self.ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        self.sizes, self.uses = self.sizes[keep], self.uses[keep] // 2

    def _streams(self, new: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and of B over all units, and how many of each a unit has. Plain units, a space and letters, are encoded in a row; None where
        the edges between them can't be told apart."""
        if plain:
            rows = ["".join(new[k:k + 1000]) for k in range(0, len(new), 1000)]
            a = np.array([i for e in self.a.encode_batch_fast(rows, add_special_tokens=False) for i in e.ids], np.int64)
            b = np.array([i for ids in self.b.encode([r[1:] for r in rows], num_threads=1) for i in ids], np.int64)
            firsts = np.flatnonzero(self.a_first[a]), np.flatnonzero(self.b_first[b])
            if any(len(f) != len(new) for f in firsts):
                return None
            return a, b, np.diff(firsts[0], append=len(a)), np.diff(firsts[1], append=len(b))
        a_ids = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        b_ids = [i[len(self.lead):] for i in self.b.encode(["\n" + u for u in new], num_threads=1)]
        flat = [np.array([i for ids in x for i in ids], np.int64) for x in (a_ids, b_ids)]
        return *flat, *(np.array([len(i) for i in x], np.int64) for x in (a_ids, b_ids))

    def _learn(self, new: list[str]) -> None:
        """Work out the groups of units that aren't known yet."""
        plain = [u for u in new if _PLAIN(u)]
        if len(plain) > 1:
            streams = self._streams(plain, True)
            if streams:
                self._add(plain, *streams)
                new = [u for u in new if u not in self.at]
        if new:
            self._add(new, *self._streams(new, False))

    def _add(self, new: list[str], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        data = [u.encode("utf-8", "surrogatepass") for u in new]
        bytes_, size_a, size_b = np.array([len(d) for d in data], np.int64), self.a_sizes[a], self.b_sizes[b]
        unit_a, unit_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        sound = (np.bincount(unit_a, size_a, len(new)) == bytes_) & (np.bincount(unit_b, size_b, len(new)) == bytes_)
        whole = b"".join(data)
        if not sound.all() or any(b"".join(map(table.__getitem__, ids.tolist())) != whole for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            at_a, at_b = np.cumsum(n_a), np.cumsum(n_b)
            for i, d in enumerate(data):
                x, y = a[at_a[i] - n_a[i]:at_a[i]], b[at_b[i] - n_b[i]:at_b[i]]
                sound[i] = b"".join(self.a_bytes[t] for t in x) == d == b"".join(self.b_bytes[t] for t in y)
            if not sound.all():
                for i in np.flatnonzero(~sound).tolist():
                    self._put([new[i]], [""], np.zeros((1, 2), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
                good = np.flatnonzero(sound)
                if len(good):
                    self._add([new[i] for i in good.tolist()], a[sound[unit_a]], b[sound[unit_b]], n_a[good], n_b[good])
                return
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        place = np.searchsorted(end_b, end_a)
        cut_a = np.flatnonzero(end_b[place] == end_a)  # tokens of A that end where one of B does; every unit's last is one
        cut_b = place[cut_a]
        links = b[cut_b] << 32 | a[cut_a]
        unit = unit_a[cut_a]
        last = np.diff(unit, append=-1) != 0
        # tokens in the order of the text of groups: a group's of A, then its of B; what follows a token depends on where it stands
        group_a, group_b = np.searchsorted(cut_a, np.arange(len(a))), np.searchsorted(cut_b, np.arange(len(b)))
        before_b, upto_a = np.concatenate(([0], cut_b + 1))[group_a], (cut_a + 1)[group_b]
        what = np.empty(len(a) + len(b), np.int64)
        in_a, in_b = np.arange(len(a)) + before_b, np.arange(len(b)) + upto_a
        what[in_a], what[in_b] = a * 4, b * 4
        what[in_a[cut_a]] += 1
        what[in_b[cut_b]] += np.where(last, 3, 2)
        groups = "".join(map(self.digits.__getitem__, what.tolist())).split("\n")[:-1]
        self._put(new, groups, np.stack((n_a, n_b), 1), links, np.cumsum(np.bincount(unit, minlength=len(new))))

    def _put(self, new: list[str], groups: list[str], sizes: np.ndarray, links: np.ndarray, ends: np.ndarray) -> None:
        n = len(self.at)
        self.at.update(zip(new, range(n, n + len(new))))
        self.groups += groups
        self.sizes, self.uses = np.concatenate((self.sizes, sizes)), np.concatenate((self.uses, np.zeros(len(new), np.int32)))
        self.ends, self.flat = np.concatenate((self.ends, self.ends[-1] + ends)), np.concatenate((self.flat, links))

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """For each whole text: tokens of A, of B, groups, SHA-256 of the groups, linked pairs as B id << 32 | A id, multiplicities.

        Zeros and empty values for a null or empty text, and for one whose bytes a tokenizer changes. Spans of texts are worked on together, up to
        SPAN characters.
        """
        made = [_Text() for _ in texts]
        held, size = [], 0
        for text, one in zip(texts, made):
            for span in spans(" " + text) if text else ():
                held.append((one, parts(span)))
                size += len(span)
                if size >= SPAN:
                    self._spans(held)
                    held, size = [], 0
        self._spans(held)
        return [one.result() for one in made]

    def _spans(self, held: list[tuple["_Text", list[str]]]) -> None:
        if not held:
            return
        if len(self.at) > self.most_units:
            self._thin()
        get = self.at.get
        which = [list(map(get, units)) for _, units in held]
        if any(None in w for w in which):
            self._learn(list(dict.fromkeys(u for (_, units), w in zip(held, which) for u, i in zip(units, w) if i is None)))
            which = [list(map(get, units)) if None in w else w for (_, units), w in zip(held, which)]
        at = np.fromiter(chain.from_iterable(which), np.int64, sum(map(len, which)))
        codes, size = _runs(self.flat, self.ends, at)
        edges = np.cumsum([0, *map(len, which)])
        self.uses[np.unique(at)] += 1
        n = np.add.reduceat(self.sizes[at], edges[:-1], axis=0)
        upto = np.concatenate(([0], np.cumsum(size)))[edges]
        sound, groups = np.add.reduceat(size == 0, edges[:-1]) == 0, self.groups.__getitem__
        for k, (one, _) in enumerate(held):
            if sound[k]:
                one.add(n[k], codes[upto[k]:upto[k + 1]], ";".join(map(groups, which[k])))
            else:
                one.sound = False


class _Text:
    """What the spans of a text add up to."""

    def __init__(self) -> None:
        self.n, self.found, self.digest, self.sound = np.zeros(2, np.int64), [], None, True

    def add(self, n: np.ndarray, codes: np.ndarray, groups: str) -> None:
        self.n = self.n + n
        self.found.append(_distinct(codes))
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(groups.encode())

    def result(self) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        if not self.sound or not self.found:
            return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, times = self.found[0]
        if len(self.found) > 1:
            pairs, back = np.unique(np.concatenate([p for p, _ in self.found]), return_inverse=True)
            times = np.bincount(back, np.concatenate([c for _, c in self.found])).astype(np.int64)
        return int(self.n[0]), int(self.n[1]), int(times.sum()), self.digest.hexdigest(), pairs, times


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with counts, without its overhead for small arrays."""
    held = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    return held[first], np.diff(first, append=len(held))


def _runs(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the runs ``at``, one after the other, and the size of each run."""
    begin, size = ends[at], ends[at + 1] - ends[at]
    upto = np.cumsum(size)
    return flat[np.repeat(begin - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)], size


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """The aligner of this worker process."""
    key = bytes_path, pieces_path
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _postings(rows: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, pa.ListArray, np.ndarray]:
    """(pair, entries, links): a run's pairs, and for each its entries document << 20 | multiplicity."""
    pairs = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
    times = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
    docs = np.repeat(np.array(rows, np.int64), [len(p) for p, _ in found])
    more = -(-times // MOST)  # an entry for each MOST occurrences
    if len(more) and more.max() > 1:
        first = np.concatenate(([0], np.cumsum(more)[:-1]))
        left = np.repeat(times, more) - (np.arange(more.sum()) - np.repeat(first, more)) * MOST
        pairs, docs, times = np.repeat(pairs, more), np.repeat(docs, more), np.minimum(left, MOST)
    order = np.argsort(pairs, kind="stable")
    pairs, entries, times = pairs[order], (docs << 20 | times)[order], times[order]
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(pairs)), pa.int32()), pa.array(entries, pa.int32()))
    return pairs[starts], lists, np.add.reduceat(times, starts) if len(starts) else times


def _encode(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    made = aligner(*paths)
    for whole in batches:
        for k in range(0, whole.num_rows, RUN):
            batch = whole.slice(k, RUN)
            first = batch["row"][0].as_py()
            got = made.align(batch["t"].to_pylist())
            digits = [pa.array([g[i] for g in got], pa.string() if i == 3 else pa.int64()) for i in range(4)]
            nulls = lambda kind, n=batch.num_rows: pa.nulls(n, kind)
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "sha", "pair", "links", "entries"]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], *digits, nulls(pa.int64()), nulls(pa.int64()), nulls(pa.list_(pa.int32()))], names)
            with_links = [i for i, g in enumerate(got) if len(g[4])]
            pairs, entries, links = _postings(with_links, [got[i][4:] for i in with_links])
            for j in range(0, len(pairs), 1 << 16):
                some = slice(j, j + (1 << 16))
                n = len(pairs[some])
                rest = [pa.nulls(n, batch.schema.field("doc_id").type), *[pa.nulls(n, d.type) for d in digits]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, first)), *rest, pa.array(pairs[some]), pa.array(links[some]), entries.slice(j, n)], names)


def postings(docs: DataFrame, id_col: str, text_col: str, bytes_path: str, pieces_path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, postings), written out.

    documents: row, doc_id, n_a, n_b, n_groups, sha. postings: pair, row (of the run's first document), links, entries.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).alias("doc_id"), text_of(text_col).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, sha string, pair long, links long, entries array<int>"
    out = stash(map_arrow(rows, partial(_encode, paths=(bytes_path, pieces_path)), schema), "postings")
    return out.where("pair is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "sha"), out.where("pair is not null").select("pair", "row", "links", "entries")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, b, a, count, best) of every linked pair of ids: its links corpus-wide, and whether no pair of its B id has more."""
    counts = found.groupBy("pair").agg(F.sum("links").alias("count"))
    counts = stash(counts.withColumns({"b": F.expr("cast(pair >> 32 as int)"), "a": F.expr("cast(pair & 4294967295 as int)")}), "pairs")
    return counts.join(counts.groupBy("b").agg(F.max("count").alias("most")), "b").withColumn("best", F.col("count") == F.col("most")).drop("most")


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, whole texts.

    Tokens of no bytes don't occur in either vocabulary, so at a common end one token of A meets one of B, and links are as many as groups. A
    text that is null or empty, or that a tokenizer doesn't give back byte for byte, has zeros and an empty ``groups_sha256``. Rows count one by
    one, equal ones and those without an id too; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    paths = bytes_path or public_vocabulary("byte_bpe_50k.json"), pieces_path or public_vocabulary("piece_bpe_32k.model")
    slim, found = postings(docs, id_col, text_col, *paths)
    told = stash(pair_counts(found), "counts").select("pair", "count", "best")
    met = found.select("pair", "row", "entries").join(told.hint("merge"), "pair")
    each = met.select("row", "count", "best", F.explode("entries").alias("e"))
    times = F.col("e").bitwiseAND(F.lit(MOST)).cast("long")
    each = each.select((F.col("row") + F.shiftrightunsigned("e", 20)).alias("row"), (times * F.col("count")).alias("s"), F.when(F.col("best"), times).otherwise(0).alias("m"))
    sums = each.groupBy("row").agg(F.sum("s").alias("count_sum"), F.sum("m").alias("n_best"))
    zero = F.lit(0).cast("long")
    return slim.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), F.col("sha").alias("groups_sha256"),
    )
