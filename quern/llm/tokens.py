"""Token ids of whole texts by the tokenizers library, with repeated units encoded once.

Both public vocabularies cut a text into pre-tokens before any merge, and no pre-token reaches across the places
used here: white space for the word vocabulary, a space between two other characters for the byte vocabulary. So the
ids of a text are the ids of its units in order, and a task encodes each distinct unit once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters that the tokenizers' patterns take for white space (Unicode White_Space).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RE2_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A run of letters up to white space or one of some marks is a pre-token of its own; taking it apart from the mark
#: makes units repeat more often.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]+"
_UNIT = {
    "word": re.compile(f"{_LETTERS}(?=[,.!?;:|#$%&*\t-\r ]|\\Z)|[^\t-\r ]+"),
    "byte": re.compile(f" ?{_LETTERS}(?=[,.!?;:|#$%&*{_WS}]|\\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"),
}
#: The same in the syntax of Arrow's regular expressions, which mark an edge between units by its two sides.
_EDGE = f"({_LETTERS[:-1]})([,.!?;:|#$%&*])"
_ODD = "[ \\n][" + _RE2_WS + "]|[" + _RE2_WS + "][ \\n]"
_PLAIN = {"word": re.compile(_LETTERS).fullmatch, "byte": re.compile(" " + _LETTERS).fullmatch}
_SAFE = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True  # their strings in a text are ordinary text
        _loaded[path] = made
    return _loaded[path]


_encoders: dict[tuple, "Encoder"] = {}


def encoder(path: str, mode: str, **bounds: int) -> "Encoder":
    """The encoder of this worker process, which keeps the units of earlier tasks, up to its bound."""
    key = path, mode, *bounds.items()
    if key not in _encoders:
        _encoders[key] = Encoder(path, mode, **bounds)
    return _encoders[key]


def public_vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine; every executor has its own copy of that package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    return _tokenizer(path).get_vocab_size()


class Encoder:
    """Encodes texts with one vocabulary file. mode: ``word`` if white space never reaches a token, else ``byte``."""

    def __init__(self, path: str, mode: str, most_units: int = 200_000, span: int = 1 << 22) -> None:
        self.tokenizer, self.unit, self.most_units, self.span = _tokenizer(path), _UNIT[mode], most_units, span
        self.plain, self.glue = _PLAIN[mode], " " if mode == "word" else ""
        self.mode = mode
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, or that begin one with its space
        self.edge[[i for token, i in vocabulary.items() if (token.endswith("</w>") if mode == "word" else token.startswith("Ġ"))]] = True
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.ends, self.uses = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _thin(self) -> None:
        """Forget the units that one batch of texts alone had, and of the others the rarer ones if they fill over half of the cache."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.most_units // 2:
            keep = np.sort(keep[np.argpartition(-self.uses[keep], self.most_units // 2)[:self.most_units // 2]])
        units = list(self.at)
        self.at = {units[i]: k for k, i in enumerate(keep.tolist())}
        begin, size = self.ends[keep], self.ends[keep + 1] - self.ends[keep]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.ends, self.uses = np.concatenate((np.zeros(1, np.int64), ends)), self.uses[keep] // 2

    def _parts(self, text: str) -> Iterator[str]:
        """A very long text in parts, cut where a cut changes no id."""
        start = 0
        while len(text) - start > self.span:
            cut = _SAFE.search(text, start + self.span)
            if not cut:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def _learn(self, new: list[str]) -> None:
        """Encode units that aren't known yet."""
        plain = [u for u in new if self.plain(u)]
        # Words of letters alone are pre-tokens of their own, and in a row of them the ids at their edges tell them apart.
        rows = [self.glue.join(plain[k:k + 1000]) for k in range(0, len(plain), 1000)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]  # fast: without offsets
        ids = np.concatenate(ids or [np.zeros(0, np.uint32)])
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) == len(plain):
            self._add(plain, ids, edges + 1 if self.mode == "word" else np.append(edges[1:], len(ids)) if len(ids) else edges)
            new = [u for u in new if u not in self.at]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        self._add(new, np.array([i for g in got for i in g], np.uint32), np.cumsum([len(g) for g in got], dtype=np.int64))

    def _add(self, new: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(self.at)
        self.at.update(zip(new, range(n, n + len(new))))
        self.ends = np.concatenate((self.ends, self.ends[-1] + ends))
        self.flat = np.concatenate((self.flat, ids))
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int32)))

    def _marked(self, texts: pa.Array) -> pa.Array:
        """The texts with a NUL between units."""
        if self.mode == "word":
            plain = pc.replace_substring(pc.replace_substring(texts, " ", "\0"), "\n", "\0")  # between two of them is an empty unit, of no ids
            if pc.any(pc.match_substring_regex(plain, "[\\t-\\r]")).as_py():
                plain = pc.replace_substring_regex(plain, "[\\t-\\r]+", "\0")
            return pc.replace_substring_regex(plain, _EDGE, "\\1\0\\2")
        plain = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        plain = pc.replace_substring_regex(plain, _EDGE, "\\1\0\\2")
        odd = pc.match_substring_regex(texts, _ODD)
        if pc.any(odd).as_py():  # white space beside white space: cut as the tokenizer's own pattern would
            cut = ["\0".join(self.unit.findall(t)) for t in texts.filter(odd).to_pylist()]
            plain = pc.replace_with_mask(plain, odd, pa.array(cut, plain.type))
        return plain

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text ends among them. No text has a NUL."""
        if len(self.at) > self.most_units:
            self._thin()
        parts = pc.split_pattern(self._marked(texts), "\0")
        code = pc.dictionary_encode(parts.flatten())
        distinct = code.dictionary.to_pylist()
        known = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            self._learn(new)
            known[missing] = np.fromiter(map(self.at.__getitem__, new), np.int64, len(new))
        self.uses[known] += 1
        which = known[code.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
        begin, size = self.ends[which], self.ends[which + 1] - self.ends[which]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()]

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text as uint32, without an end id. Texts are worked on together up to a bounded length."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "").cast(pa.large_string())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        alone = (sizes > self.span) | pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        k = 0
        while k < len(texts):
            if alone[k]:
                yield self._alone(texts[k].as_py())
                k += 1
                continue
            upto, held = k, 0
            while upto < len(texts) and not alone[upto] and (upto == k or held + sizes[upto] <= self.span):
                held += sizes[upto]
                upto += 1
            ids, ends = self._ids(texts[k:upto])
            at = 0
            for end in ends.tolist():
                yield ids[at:end]
                at = end
            k = upto

    def _alone(self, text: str) -> np.ndarray:
        """A text with a NUL as the library has it; a very long one in parts."""
        if "\0" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate([self._ids(pa.array([part], pa.large_string()))[0] for part in self._parts(text)])
