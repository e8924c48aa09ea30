"""Edit distances between texts, by words and by characters, of any length.

Bit-parallel: one sequence is the bits of a wide integer, the other is walked through, so a pair of n and m items takes n * m / 64 steps of a
machine word and memory for m bits. Spark's own distance takes n * m steps and knows characters only.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import WS


def distance(a: Sequence, b: Sequence) -> int:
    """Least number of insertions, deletions and substitutions of items."""
    n, head, tail = min(len(a), len(b)), 0, 0
    while head < n and a[head] == b[head]:
        head += 1
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    masks = {x: _bits(at, len(a)) for x, at in places.items()}
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)  # vertical differences of +1 and of -1
    for y in b:
        equal = masks.get(y, 0)
        met = equal | down
        diagonal = ((met & up) + up ^ up) | met
        across = down | full ^ (diagonal | up) & full
        back = up & diagonal
        if across & last:
            score += 1
        elif back & last:
            score -= 1
        across, back = (across << 1 | 1) & full, back << 1 & full
        up, down = back | full ^ (diagonal | across) & full, across & diagonal & full
    return score


def _bits(places: list[int], n: int) -> int:
    held = bytearray(n // 8 + 1)
    for i in places:
        held[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(held, "little")


@F.pandas_udf(T.LongType())
def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two columns of strings or of lists; null where either is."""
    return pd.Series([None if x is None or y is None else distance(x if isinstance(x, str) else list(x), y if isinstance(y, str) else list(y)) for x, y in zip(a, b)], dtype="Int64")


def char_errors(reference: Column, hypothesis: Column) -> Column:
    return _distances(reference, hypothesis)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Word edit distance of texts of any length."""
    return _distances(_words(reference), _words(hypothesis))


def reference_words(reference: Column) -> Column:
    return F.size(_words(reference)).cast("long")


def excessive_length(reference: Column, hypothesis: Column) -> Column:
    n = F.char_length(reference)
    return F.char_length(hypothesis) > F.greatest(2 * n, n + 40)
