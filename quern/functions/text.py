"""Text expressions. All are built-in functions but for Unicode composition and folding and BLAKE2, which are Arrow UDFs."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 29 code points that count as white space, control tokens, annotations, Latin tokens.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CONTROL_TOKEN = r"<\|[^<>\n]{1,128}\|>"
ANNOTATION = r"\[[^\]\n]{1,80}\]|<[^<>\n]{1,80}>"
LATIN = "[A-Za-z]"
LATIN_TOKEN = r"\b[A-Za-z][A-Za-z0-9_.+-]*\b"
TAMIL = (0x0B80, 0x0BFF)


def _ranges(codes: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, start = [], None
    for c, after in zip(codes, [*codes[1:], None]):
        start = c if start is None else start
        if after != c + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{c:x}}}")
            start = None
    return "".join(out)


def _composition() -> tuple[str, str]:
    """Two patterns from Unicode's tables, as this Python has them: a fast one that every text matches which may not be composed, and the one that
    decides.

    A text may change under NFC if it has a character that is never in composed text, two marks in a row (their order may change, and
    either may compose with what stands before), a mark of another class than 0 that composes with something, or a composing character of class 0
    (vowel signs, jamo) after one that it composes with. Characters that the JVM's older tables don't know count as such too.
    """
    never, marks, pairs = [], set(), {}
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if unicodedata.normalize("NFC", x) != x:
            never.append(c)
        whole = unicodedata.decomposition(x)
        if whole and whole[0] != "<" and " " in whole:
            first, second = whole.split()
            if unicodedata.normalize("NFC", chr(int(first, 16)) + chr(int(second, 16))) == x:
                if unicodedata.combining(chr(int(second, 16))):
                    marks.add(int(second, 16))
                else:
                    pairs.setdefault(int(second, 16), []).append(int(first, 16))
    for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)):
        pairs[c] = [*range(0x1100, 0x1113)] if c < 0x1176 else [*range(0xAC00, 0xD7A4, 28)]
    by_firsts: dict[str, list[int]] = {}
    for second, firsts in pairs.items():
        first = _ranges(sorted(firsts)) if not 0xAC00 <= firsts[0] <= 0xD7A3 else r"\x{ac00}-\x{d7a3}"
        by_firsts.setdefault(first, []).append(second)
    after = [f"[{first}][{_ranges(sorted(seconds))}]" for first, seconds in by_firsts.items()]
    return r"[^\x00-\x{2ff}]", "|".join([f"[{_ranges(never)}]", r"\p{Cn}|\p{M}\p{M}", f"[{_ranges(sorted(marks))}]", *after])


_BEYOND, _LOOSE = _composition()


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC of whole texts; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def may_compose(text: Column) -> Column:
    """Whether NFC may change a text; false only where it doesn't."""
    return text.rlike(_BEYOND) & text.rlike(_LOOSE)


def strip(text: Column) -> Column:
    """Without white space at either end, in the sense of WS."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def normalize(text: Column, compose: bool = True) -> Column:
    """Null to empty; NFC; zero-width marks go; control tokens become a space; white space is squeezed.

    Expressions of the JVM, but for the NFC of texts that a pattern over Unicode's tables finds not to be composed for certain: only those are sent
    to Python, all others pass as null. ``compose=False`` leaves NFC out.
    """
    value = text.cast("string")
    if compose:
        value = F.coalesce(composed(F.when(may_compose(value), value)), value)
    value = F.translate(F.coalesce(value, F.lit("")), "\u200b\ufeff", "")
    return squeeze(F.regexp_replace(value, CONTROL_TOKEN, " "))


class _Kept(dict):
    """str.translate table that keeps letters, numbers and marks, filled as characters turn up."""

    def __missing__(self, code: int) -> int | None:
        self[code] = code if unicodedata.category(chr(code))[0] in "LNM" else None
        return self[code]


_kept = _Kept()


def fold(text: str) -> str:
    return text.casefold().translate(_kept)


@F.pandas_udf(T.StringType())
def fingerprint(normalized: pd.Series) -> pd.Series:
    """SHA-1 of the letters, numbers and marks of normalised text, case-folded."""
    return normalized.map(lambda t: hashlib.sha1(fold(t or "").encode()).hexdigest())


def fingerprint_lower(normalized: Column) -> Column:
    """The same with lower case for case folding, in the JVM. Differs for letters like sharp s."""
    return F.sha1(F.regexp_replace(F.lower(normalized), r"[^\p{L}\p{N}\p{M}]", "").cast("binary"))


def letters_and_digits(text: Column) -> Column:
    """How many there are; runs of anything else are cut out, which is cheaper than counting matches one by one."""
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]+", ""))


def script_fraction(text: Column, low: int = TAMIL[0], high: int = TAMIL[1]) -> Column:
    """Share of code points low..high among letters and digits; 0.0 where there are none."""
    inside = F.regexp_count(text, F.lit(rf"[\x{{{low:x}}}-\x{{{high:x}}}&&[\p{{L}}\p{{Nd}}]]"))
    return F.coalesce(inside / F.nullif(letters_and_digits(text), F.lit(0)), F.lit(0.0))


def latin_fraction(text: Column) -> Column:
    """The same for A-Z and a-z."""
    rest = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "")
    return F.coalesce((F.char_length(text) - F.char_length(rest)) / F.nullif(letters_and_digits(text), F.lit(0)), F.lit(0.0))


def stable_bucket(value: Column, modulo: int = 10_000) -> Column:
    """BLAKE2b-64 of the text, big-endian, mod ``modulo``."""

    @F.pandas_udf(T.LongType())
    def bucket(values: pd.Series) -> pd.Series:
        return values.map(lambda v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big") % modulo)

    return bucket(value)


def sha_bucket(value: Column, modulo: int = 10_000) -> Column:
    """First eight bytes of SHA-256, big-endian, mod ``modulo``, in the JVM."""
    first = F.conv(F.substring(F.sha2(value.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (first % F.lit(modulo)).cast("long")


def finite_double(value: Column) -> Column:
    """A double, or null for what doesn't parse, NaN and infinities."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def first_value(*columns: Column) -> Column:
    """The first value that is neither null nor blank as a string; conversion comes later, so a bad value hides a later good one."""
    return F.coalesce(*[F.when(strip(c.cast("string")) != "", c) for c in columns])


def variants(compose: bool = True, **columns: Column) -> Column:
    """Map of the names and normalised texts of columns that aren't empty."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), normalize(c, compose))]), lambda _, v: v != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WS), lambda w: w != ""))


def chars_per_second(text: Column, duration: Column) -> Column:
    """Null where the duration is zero."""
    return F.char_length(text) / F.nullif(duration, F.lit(0.0))


def has_latin(text: Column) -> Column:
    return text.rlike(LATIN)


def has_annotation(text: Column) -> Column:
    return text.rlike(ANNOTATION)


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LATIN_TOKEN), F.lit(0))


def has_control_fragment(text: Column) -> Column:
    return text.rlike(r"<\||\|>")


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(F.lit(20.0), loss))


def ladder(value: Column, *steps: tuple[float, str], last: str, inclusive: bool = False) -> Column:
    """Label of the first bound over the value (or reached by it, if inclusive)."""
    below = (lambda b: value <= b) if inclusive else (lambda b: value < b)
    first, *rest = steps
    return reduce(lambda w, s: w.when(below(s[0]), s[1]), rest, F.when(below(first[0]), first[1])).otherwise(last)
