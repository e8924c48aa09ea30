"""Sampled segmentations without replacement: Gumbel top-k by a perturbed best-first search over the piece lattice.

The vocabulary file names the pieces; a piece of merge rank r has log-probability -log(r + 2) up to a constant, characters
without a piece fall back to their bytes, and a segmentation's probability is the product of its pieces' to the power
``alpha``, normalised over the whole lattice of the whole text. ``samples`` distinct segmentations are drawn by
the Gumbel-top-k trick: the root gets a Gumbel variate, every subtree left aside one that is bounded by its parent's,
and the search always continues in the subtree with the largest. Bounds are exact, since lattice edges carry exact
conditional probabilities (backward sums), so no node is ever opened in vain. The inclusion score of a sample is
the log-probability that it is among the ``samples`` largest given the next perturbed value.

A piece reaches across no space, so the lattice of a text is a chain of lattices of its space-separated units. Those
of the distinct units of a block of documents are built once, and paths are drawn for all units of the block at
a time. Random numbers are a hash of seed, row key, sample and place: results do not depend on partitions or blocks.

Probabilities are doubles. What is left beside an edge is the sum of its siblings and never one minus the edge, so no subtree, however
rare, gets lost: a text with fewer segmentations than asked for comes back with all of them. Every sample is decoded
again, and compared with the text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import map_arrow, quoted, text_of
from quern.llm.tokens import public_vocabulary

SPACE = "▁"
RESULT = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, text_crc32 long, round_trip boolean"
#: Stands for a space sign that is part of a text: no piece has it, so it falls back to its bytes.
FOREIGN = 0x110000


class Pieces:
    """A vocabulary as a trie over code points. ``edges[state, code]`` are sorted keys; ``final`` has a state's piece."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.parts: np.ndarray | None = None
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = np.zeros(256, np.int64)
        trie: dict[tuple[int, int], int] = {}
        final, weight = [-1], [0.0]
        self.longest = 1
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                continue
            score = model.get_score(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or (score < -1e8 and piece != SPACE):
                continue  # what no merge makes isn't sampled, but for a space that stands alone
            score = max(score, -float(size))
            state = 0
            for c in map(ord, piece):
                nxt = trie.setdefault((state, c), len(final))
                if nxt == len(final):
                    final.append(-1)
                    weight.append(0.0)
                state = nxt
            final[state], weight[state] = i, (2 - score) ** -alpha
            self.longest = max(self.longest, len(piece))
        keys = sorted((s << 21 | c, n) for (s, c), n in trie.items())
        self.keys, self.next = (np.array(x, np.int64) for x in zip(*keys))
        self.final, self.weight = np.array(final), np.array(weight)
        self.byte_weight = (2.0 + size) ** -alpha
        self.after = np.full(1 << 16, -1, np.int64)  # the state after a first character
        begin = self.keys < 1 << 16
        self.after[self.keys[begin]] = self.next[begin]
        self._hash()

    def _hash(self) -> None:
        """An open hash table of the edges, filled all at once, one probe after the other."""
        self.shift = 64 - (4 * len(self.keys)).bit_length()
        size = 1 << 64 - self.shift
        self.slot_key, self.slot_next = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left, self.probes = np.arange(len(self.keys)), 0
        while len(left):
            slot = (self._slot(self.keys[left]) + self.probes) & (size - 1)
            first = np.unique(slot, return_index=True)[1]
            first = first[self.slot_key[slot[first]] < 0]
            self.slot_key[slot[first]], self.slot_next[slot[first]] = self.keys[left[first]], self.next[left[first]]
            left, self.probes = np.delete(left, first), self.probes + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).view(np.int64)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The states that the edges with these keys lead to, -1 where there is none."""
        slot = self._slot(keys)
        held = self.slot_key[slot]
        found = np.where(held == keys, self.slot_next[slot], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        for probe in range(1, self.probes):
            if not len(left):
                break
            at = (slot[left] + probe) & (len(self.slot_key) - 1)
            held = self.slot_key[at]
            same = held == keys[left]
            found[left[same]] = self.slot_next[at[same]]
            left = left[~same & (held >= 0)]
        return found

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of piece ids: spaces restored, the first space dropped."""
        if self.parts is None:
            self.parts = np.array([t.replace(SPACE, " ").encode() for t in self.text], object)
            for byte, i in enumerate(self.byte_id.tolist()):
                self.parts[i] = bytes([byte])
        return b"".join(self.parts[ids])[1:]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, np.int64)).decode("utf-8", "surrogatepass")


_pieces: dict[tuple[str, float], Pieces] = {}


def pieces_of(path: str, alpha: float) -> Pieces:
    if (path, alpha) not in _pieces:
        _pieces[path, alpha] = Pieces(path, alpha)
    return _pieces[path, alpha]


class Lattice:
    """Edges out of every character of the given units, with conditional probabilities, longest piece first."""

    def __init__(self, units: list[str], pieces: Pieces) -> None:
        sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
        codes = np.frombuffer("".join(SPACE + u for u in units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        own, codes = codes, codes.copy()
        codes[codes == ord(SPACE)] = FOREIGN
        codes[self.start] = ord(SPACE)
        n = len(codes)
        room = np.repeat(self.end, sizes) - np.arange(n)
        active, state, found, weights = np.arange(n), np.zeros(n, np.int64), [], []
        for length in range(1, pieces.longest + 1):
            ok = room[active] >= length
            active, state = active[ok], state[ok]
            if length == 1 and n and codes.max() < 1 << 16:
                state = pieces.after[codes]
                active = np.flatnonzero(state >= 0)
                state = state[active]
            else:
                state = pieces.step(state.astype(np.int64) << 21 | codes[active + length - 1])
                ok = state >= 0
                active, state = active[ok], state[ok]
            hit = pieces.final[state] >= 0
            pos, ids, w = active[hit], pieces.final[state[hit]], pieces.weight[state[hit]]
            if length == 1:  # characters without a piece: their bytes, as one edge
                bare = np.ones(n, bool)
                bare[pos] = False
                bare = np.flatnonzero(bare)
                c = own[bare]
                many = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                order = np.argsort(np.concatenate((pos, bare)), kind="stable")
                pos, ids = np.concatenate((pos, bare))[order], np.concatenate((ids, -1 - c))[order]
                w = np.concatenate((w, pieces.byte_weight ** many))[order]
            if not len(active) and not len(pos):
                break
            found.append((pos, ids))
            dense = np.zeros(n)
            dense[pos] = w
            weights.append(dense)
        self._normalise(weights, sizes)
        count = np.zeros(n, np.int64)
        for pos, _ in found:
            count[pos] += 1
        self.to = np.cumsum(count)
        self.first = self.to - count
        total = int(self.to[-1]) if n else 0
        self.id, self.length, self.pos = (np.zeros(total, np.int32) for _ in range(3))
        self.p, self.cdf, aside = np.zeros(total), np.zeros(total), np.zeros(total)
        fill, sums = self.first.copy(), np.zeros(n)
        for length in range(len(found), 0, -1):
            pos, ids = found[length - 1]
            slot, p = fill[pos], weights[length - 1][pos]
            fill[pos] += 1
            aside[slot] = sums[pos]
            sums[pos] += p
            self.id[slot], self.length[slot], self.p[slot], self.cdf[slot], self.pos[slot] = ids, length, p, sums[pos], pos
        sums[:] = 0.0
        for length in range(1, len(found) + 1):  # and the edges after each
            pos = found[length - 1][0]
            fill[pos] -= 1
            aside[fill[pos]] += sums[pos]
            sums[pos] += weights[length - 1][pos]
        with np.errstate(divide="ignore"):
            self.log_p, self.log_aside = np.log(self.p), np.log(aside)
        self.cdf[self.to - 1] = 2.0
        self.last = np.repeat(self.end, sizes) if total else np.zeros(0, np.int64)

    def _normalise(self, weights: list[np.ndarray], sizes: np.ndarray) -> None:
        """Turn weights into conditional probabilities, from the last character of every unit to its first."""
        order = np.argsort(-sizes, kind="stable")
        ends, lengths = self.end[order], sizes[order]
        ring = len(weights) + 1
        back = np.zeros((ring, len(order)))
        back[0] = 1.0
        longest = int(lengths[0]) if len(order) else 0
        live = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")
        for d in range(1, longest + 1):
            m = live[d - 1]
            pos = ends[:m] - d
            parts = [weights[k - 1][pos] * back[(d - k) % ring, :m] for k in range(1, min(d, len(weights)) + 1)]
            total = np.sum(parts, axis=0)
            for k, part in enumerate(parts):
                weights[k][pos] = part / total
            back[d % ring, :m] = total
            if d % 16 == 0:  # only ratios matter: keep them away from underflow
                back[:, :m] /= total


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = np.atleast_1d(x) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, more: np.ndarray | int) -> np.ndarray:
    """Uniform in (0, 1) for a key and a counter."""
    x = _mix(key ^ _mix(np.asarray(more).astype(np.uint64)))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def _draw(lat: Lattice, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths from lattice places to the ends of their units: edges in order, and how many each place has."""
    n = len(start)
    end = lat.last[np.minimum(start, len(lat.last) - 1)] if n else start
    active, pos, end, key, steps = np.arange(n), start.copy(), end, key, []
    count = np.zeros(n, np.int64)
    step = 0
    while len(active):
        u = _uniform(key, step)
        e = lat.first[pos]
        todo = np.flatnonzero(u > lat.cdf[e])
        while len(todo):
            e[todo] += 1
            todo = todo[u[todo] > lat.cdf[e[todo]]]
        steps.append((active, e))
        count[active] += 1
        pos = pos + lat.length[e]
        go = pos < end
        active, pos, end, key = active[go], pos[go], end[go], key[go]
        step += 1
    where = np.cumsum(count) - count
    edges = np.zeros(int(count.sum()), np.int64)
    for step, (who, e) in enumerate(steps):
        edges[where[who] + step] = e
    return edges, count


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Samples:
    """The samples of a block of documents. Arrays run over documents; lists over samples."""

    def __init__(self, texts: list[str], keys: np.ndarray, pieces: Pieces, seed: int) -> None:
        split = [t.split(" ") if t else [] for t in texts]
        flat = [u for s in split for u in s]
        ids = {u: i for i, u in enumerate(dict.fromkeys(flat))}
        self.lat, self.pieces, self.n = Lattice(list(ids), pieces), pieces, len(texts)
        self.unit = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
        self.units = np.fromiter(map(len, split), np.int64, len(split))
        self.unit_from = np.cumsum(self.units) - self.units
        self.key = _mix(keys.astype(np.uint64) ^ _mix(np.full(len(keys), seed, np.uint64)))
        self.paths: list[list[np.ndarray | None]] = []  # whole edge paths
        self.own: list[list[tuple[int, np.ndarray, np.ndarray, tuple] | None]] = []  # first own piece, bounds, prefix sums, edges barred there
        self.value, self.best = [], []  # perturbed value of each sample; largest bound among its open subtrees

    def _stream(self, docs: np.ndarray, sample: int, kind: int) -> np.ndarray:
        return _mix(self.key[docs] + np.uint64(4 * sample + kind + 1))

    def _open(self, sample: int, docs: np.ndarray, prefix: list, start: np.ndarray, unit: np.ndarray, count: np.ndarray, lead: list, bound: np.ndarray) -> None:
        """Complete paths and bound the subtrees beside them. start, unit: places to go on from, count of them for each document.

        lead: for each document None or the edge taken where the path leaves an earlier one, with all edges barred there.
        """
        owner = np.repeat(docs, count)
        edges, many = _draw(self.lat, start, _mix(self._stream(owner, sample, 0) ^ unit.astype(np.uint64)))
        ends = np.cumsum(many)
        cut = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(count)))]
        whole, own, value, best = [None] * self.n, [None] * self.n, np.full(self.n, -np.inf), np.full(self.n, -np.inf)
        log_all, aside_all = self.lat.log_p[edges], self.lat.log_aside[edges]
        spot = np.arange(len(edges)) - np.repeat(cut[:-1], np.diff(cut)) + 1
        noise_key = np.repeat(self._stream(docs, sample, 1), np.diff(cut))
        gumbel_all = -np.log(-np.log(_uniform(noise_key, spot))) if len(edges) else np.zeros(0)
        first_noise = -np.log(-np.log(_uniform(self._stream(docs, sample, 1), np.zeros(len(docs)))))
        for j, d in enumerate(docs.tolist()):
            a, b = cut[j], cut[j + 1]
            e, logs, aside, gumbel = edges[a:b], log_all[a:b], aside_all[a:b], gumbel_all[a:b]
            barred, begin, base = (), 0, 0.0
            if lead[j] is not None:
                edge, barred = lead[j]
                begin, base = len(prefix[j][0]), prefix[j][1]
                others = self._others(int(self.lat.pos[edge]), barred)
                e, logs = np.concatenate(([edge], e)), np.concatenate(([self.lat.log_p[edge]], logs))
                aside = np.concatenate(([np.log(self.lat.p[others].sum()) if others else -np.inf], aside))
                gumbel = np.concatenate(([first_noise[j]], gumbel))
            done = np.cumsum(logs) + base
            mass = done - logs + aside
            some = np.flatnonzero(mass > -np.inf)
            open_ = np.full(len(mass), -np.inf)
            open_[some] = -np.logaddexp(-bound[j], -(mass[some] + gumbel[some]))
            whole[d] = np.concatenate((prefix[j][0], e)) if begin else e
            own[d] = (begin, open_, done, barred)
            value[d] = bound[j]
            best[d] = open_.max(initial=-np.inf)
        self.paths.append(whole)
        self.own.append(own)
        self.value.append(value)
        self.best.append(best)

    def _others(self, pos: int, barred: tuple) -> list[int]:
        """The edges out of a place but for those barred there."""
        return [e for e in range(int(self.lat.first[pos]), int(self.lat.to[pos])) if e not in barred]

    def first(self) -> None:
        docs = np.arange(self.n)
        root = -np.log(-np.log(_uniform(self._stream(docs, 0, 2), 0)))
        start = self.lat.start[self.unit] if len(self.unit) else self.unit
        place = np.arange(len(self.unit)) - np.repeat(self.unit_from, self.units)
        self._open(0, docs, [None] * self.n, start, place, self.units, [None] * self.n, root)

    def next(self) -> None:
        """The next sample of every document that has one: the open subtree with the largest bound."""
        t, lat = len(self.paths), self.lat
        table = np.stack(self.best)
        source = table.argmax(axis=0)
        docs = np.flatnonzero(table.max(axis=0) > -np.inf)
        draws = _uniform(self._stream(docs, t, 2), 0)
        prefix, lead, bound, start, unit, count = [], [], [], [], [], []
        for d, draw in zip(docs.tolist(), draws.tolist()):
            s = int(source[d])
            begin, open_, done, barred = self.own[s][d]
            i = int(open_.argmax())
            path = self.paths[s][d]
            edge = int(path[begin + i])
            bars = (*barred, edge) if i == 0 and barred else (edge,)
            pos = int(lat.pos[edge])
            left = self._others(pos, bars)
            target, chosen = draw * float(lat.p[left].sum()), left[-1]
            for e in left:
                target -= float(lat.p[e])
                if target <= 0:
                    chosen = e
                    break
            before = float(done[i] - lat.log_p[edge])
            prefix.append((path[:begin + i], before))
            lead.append((chosen, (*bars, chosen)))
            bound.append(float(open_[i]))
            open_[i] = -np.inf
            self.best[s][d] = open_.max(initial=-np.inf)
            # the unit that the path leaves in is the one whose pieces reach past this place
            k = int(np.searchsorted(self._ends(d), int(lat.length[path[:begin + i]].sum()), "right"))
            at, stop = pos + int(lat.length[chosen]), int(lat.last[pos])
            later = np.arange(k + 1, int(self.units[d]))
            begin_at = lat.start[self.unit[self.unit_from[d] + later]]
            inside = [at] if at < stop else []
            start.append(np.concatenate((inside, begin_at)).astype(np.int64))
            unit.append(np.concatenate(([k] * len(inside), later)).astype(np.int64))
            count.append(len(start[-1]))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self._open(t, docs, prefix, join(start), join(unit), np.array(count, np.int64), lead, np.array(bound))

    def _ends(self, d: int) -> np.ndarray:
        u = self.unit[self.unit_from[d]:self.unit_from[d] + self.units[d]]
        return np.cumsum(self.lat.end[u] - self.lat.start[u])

    def next_value(self) -> np.ndarray:
        """The perturbed value that follows the samples drawn, minus infinity where none does."""
        return np.stack(self.best).max(axis=0)

    def ids(self, path: np.ndarray) -> np.ndarray:
        found = self.lat.id[path]
        bare = np.flatnonzero(found < 0)
        if len(bare):
            chars = [chr(-1 - i).encode("utf-8", "surrogatepass") for i in found[bare].tolist()]
            many = np.ones(len(found), np.int64)
            many[bare] = list(map(len, chars))
            is_byte = np.repeat(found < 0, many)
            found = np.repeat(found, many)
            found[is_byte] = self.pieces.byte_id[np.frombuffer(b"".join(chars), np.uint8)]
        return found


def _log_inclusion(ahead: float) -> float:
    """log(1 - exp(-exp(ahead))), with its digits kept on either side."""
    rate = math.exp(min(ahead, 700.0))
    return math.log1p(-math.exp(-rate)) if rate > 0.7 else math.log(-math.expm1(-rate)) if rate > 0 else -math.inf


def sample(
    texts: list[str], keys: list[int | None], pieces: Pieces, samples: int, seed: int = 42
) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(document, sample, ids, log_prob, perturbed, inclusion) of each text, samples in falling order of perturbed value."""
    drawn = _Samples(texts, np.array([hash_key(k) for k in keys], np.uint64), pieces, seed)
    drawn.first()
    for _ in range(samples - 1):
        drawn.next()
    kappa = drawn.next_value()
    for d in range(len(texts)):
        for s in range(samples):
            if drawn.paths[s][d] is None:
                break
            _, _, done, _ = drawn.own[s][d]
            log_prob = float(done[-1]) if len(done) else 0.0
            score = 0.0 if np.isneginf(kappa[d]) else _log_inclusion(log_prob - float(kappa[d]))
            yield d, s, drawn.ids(drawn.paths[s][d]), log_prob, float(drawn.value[s][d]), score


def hash_key(key: int | None) -> int:
    return (0 if key is None else key + 1) & ((1 << 64) - 1)


def _rows(batches: Iterator[pa.RecordBatch], path: str, alpha: float, samples: int, seed: int, ids: bool, block: int) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(path, alpha)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()] + [pa.list_(pa.int32())] * ids
    names = [f.split()[0] for f in RESULT.split(", ")] + ["ids"] * ids
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        a = 0
        while a < len(texts):
            b, held = a, 0
            while b < len(texts) and (b == a or held + len(texts[b]) <= block):
                held += len(texts[b])
                b += 1
            rows = []
            for d, s, got, log_prob, perturbed, score in sample(texts[a:b], keys[a:b], pieces, samples, seed):
                back = pieces.decode_bytes(got)
                same = back == texts[a + d].encode("utf-8", "surrogatepass")
                rows.append((keys[a + d], s, len(got), zlib.crc32(got.astype("<u4")), log_prob, perturbed, score, zlib.crc32(back), same, *([got] * ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            a = b


def sample_pieces(
    docs: DataFrame, samples: int = 2, alpha: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None, with_ids: bool = False, block: int = 1 << 22,
) -> DataFrame:
    """Distinct sampled segmentations of every whole text, one row each: see RESULT, and ``ids`` on request.

    ``text_crc32`` is that of the text that the pieces decode to, ``round_trip`` whether it is the row's. ``sample`` counts from 0 in falling order of ``perturbed``. A text with fewer segmentations than ``samples``
    has a row for each, with inclusion score 0 (certain). Null and empty texts have one segmentation, of no
    pieces. Rows are seeded by their id (null as a key of its own), so repeated rows have equal samples. An empty table gives
    no rows; other columns are ignored. No shuffle. Memory follows ``block`` characters or the longest text.
    """
    path = vocabulary or public_vocabulary("piece_bpe_32k.model")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    work = partial(_rows, path=path, alpha=alpha, samples=samples, seed=seed, ids=with_ids, block=block)
    return map_arrow(rows, work, RESULT + ", ids array<int>" * with_ids)


def _texts(batches: Iterator[pa.RecordBatch], path: str, column: str) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(path, 1.0)
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(column)).to_pylist()
        got = pa.array([None if i is None else pieces.decode(i) for i in ids], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, "decoded"])


def decode_pieces(rows: DataFrame, column: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The rows with ``decoded``, the text of the piece ids in ``column``.

    Null ids give a null, an empty list an empty text; an id that the vocabulary lacks is an error. An empty table gives no rows,
    repeated rows are decoded each, other columns pass through; a column ``decoded`` is replaced. No shuffle.
    """
    rows = rows.select(*[quoted(c) for c in rows.columns if c.lower() != "decoded"])
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return map_arrow(rows, partial(_texts, path=vocabulary or public_vocabulary("piece_bpe_32k.model"), column=column), schema)
