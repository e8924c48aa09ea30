"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text. A line weighs n / (n + HALF) for its n characters, so that it is the number of
lines that counts and not how long paragraphs are, times mild factors: inside the article INSIDE, beside it OUTSIDE (a third), in menus, footers and the
like FIRM, under a name that may mean such MILD; a line that is links for the most part weighs nothing. The weights are summed over windows of
WINDOW lines, and where the article or a container apart begins or ends, WINDOW empty lines stand. Where the sums rise from nothing a region begins, where they
dive to nothing it ends, and it is text if they surge over SURGE in between, beside the article also over a BESIDE-th of the highest sum of the page; if none
do, the region with the most weight is. So in the article a short line of its own stays, and a named box if it holds a sentence; beside it goes what isn't denser than the article.

The article is what ``<article>`` or ``<main>`` marks, if that holds a share of the text of the page; else the innermost section that holds nearly all
text and leaves a line or more out. What speaks against a container doesn't count where it can't be meant: on html, body, main and article, on containers that
the article lies in, and, if it is a name or a form, on containers that hold nearly all text of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_arrow, quoted, text_of

#: Lines of a window, the sum over it (in lines) that a text surges over, and the characters that make half a line.
WINDOW, SURGE, HALF = 3, 0.6, 3
#: Share of the page's highest sum that a region beside the article must surge over.
BESIDE = 0.35
#: Factors of weights.
INSIDE, OUTSIDE, FIRM, MILD = 3**0.5, 3**-0.5, 0.1, 0.4
#: Shares of the text: a container that is the page, a mark that is the article, a section that is taken for it.
BULK, MARKED, SECTION = 0.9, 0.3, 0.7
#: Characters that a section in another must leave out to be taken for the article.
LINE = 30

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|object|select|title)\b(?>[^>"']+|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']+|"[^"]*"|'[^']*')*+)>|<[/!?]?[a-zA-Z!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_WORDS = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TEXT_ONLY = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())
_APART = frozenset("nav footer aside form button dialog menu".split())
#: Names that say what is in a container, and names that may; a compound name says it if its other parts only say what kind of box it is.
_FIRM_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments commentlist disqus respond replies sidebar nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead newsletter subscribe subscription signup login pagination pager toolbar copyright contentinfo complementary".split()
)
_MILD_NAMES = frozenset("alert banner menu modal notice notices overlay popup promo promotion recommended related search share sharing social widget".split())
_BOX_NAMES = frozenset("area banner bar block body bottom box button buttons col column container content footer form group header holder inner items left list links main notice outer pane panel right row section site slot the thread top unit wrap wrapper page popup modal".split())
_SECTIONS = frozenset("div section td center body main article".split())
_MAIN_NAMES = frozenset("main articlebody".split())


def _names(attrs: str) -> list[str]:
    return [w for _, v in _WORDS.findall(attrs) for w in v.strip("\"'").lower().split()] if "=" in attrs else []


def _factor(tag: str, names: list[str]) -> float:
    """What a container's tag and names make of its lines."""
    factor = FIRM if tag in _APART else 1.0
    for name in names:
        parts = {p for p in re.split(r"[^a-z]+", name) if p}
        for known, f in ((_FIRM_NAMES, FIRM), (_MILD_NAMES, MILD)):
            if parts & known and parts <= known | _FIRM_NAMES | _MILD_NAMES | _BOX_NAMES:
                factor = min(factor, f)
    return factor


class Line(NamedTuple):
    """A block of text, its characters in links, and the number of the container that it is in."""

    text: str
    linked: int
    container: int


class Container(NamedTuple):
    """The container around (less than its own number), tag, factor of its tag and names, whether a mark of the article, whether a header."""

    parent: int
    tag: str
    factor: float
    mark: bool
    header: bool


_PLAIN = frozenset("html body main article".split())


def lines_of(page: str) -> tuple[list[Line], list[Container]]:
    """The lines of a page in order, and its containers; number 0 is the page.

    A line ends at the edges of block elements and at <br>. End tags close what they match; what is left open ends with its parent.
    """
    lines: list[Line] = []
    containers = [Container(0, "", 1.0, False, False)]
    stack: list[tuple[str, int]] = [("", 0)]
    depth: dict[str, list[int]] = {}  # places in the stack by tag, so that an end tag finds its own at once
    held: list[str] = []
    linked, in_link, at = 0, False, 0

    def close() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                lines.append(Line(text, linked, stack[-1][1]))
            held, linked = [], 0

    def pop(upto: int) -> None:
        while len(stack) > upto:
            depth[stack.pop()[0]].pop()

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            part = page[at:token.start()]
            held.append(part)
            linked += in_link * len(part.strip())
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = not token["end"]
            continue
        close()
        in_link = False
        if tag in _VOID:
            continue
        if token["end"]:
            if depth.get(tag):
                pop(depth[tag][-1])
            continue
        names = _names(token["attrs"])
        factor = 1.0 if tag in _PLAIN else _factor(tag, names)
        mark = tag in ("article", "main") or not _MAIN_NAMES.isdisjoint(names)
        if tag in _TEXT_ONLY and tag not in ("li", "td", "th", "dd", "dt") and factor == 1.0 and not mark:
            continue
        if token["attrs"].endswith("/"):
            continue
        if tag in _TEXT_ONLY and stack[-1][0] == tag:
            pop(len(stack) - 1)
        containers.append(Container(stack[-1][1], tag, factor, mark, tag == "header" or "header" in names))
        depth.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(containers) - 1))
    if at < len(page):
        held.append(page[at:])
    close()
    return lines, containers


def _sums(sizes: dict[int, int], containers: list[Container]) -> list[int]:
    """What each container holds, with all that lies in it; containers come after those around them."""
    held = [sizes.get(c, 0) for c in range(len(containers))]
    for c in range(len(containers) - 1, 0, -1):
        held[containers[c].parent] += held[c]
    return held


def article_of(lines: list[Line], containers: list[Container]) -> tuple[list[bool], list[float]]:
    """For each container, whether it lies in the article, and its factor with those around it."""
    n = len(containers)
    sizes: dict[int, int] = {}
    for x in lines:
        sizes[x.container] = sizes.get(x.container, 0) + max(len(x.text) - x.linked, 0)
    held = _sums(sizes, containers)
    in_mark = [False] * n
    for c in range(1, n):
        in_mark[c] = containers[c].mark or in_mark[containers[c].parent]

    def factors(main: set[int]) -> list[float]:
        around = set()  # what the article lies in
        for m in main:
            m = containers[m].parent
            while m and m not in around:
                around.add(m)
                m = containers[m].parent
        out = [1.0] * n
        for c in range(1, n):
            x, own = containers[c], 1.0
            if c not in around and (held[c] < BULK * held[0] or x.tag in _APART - {"form"}):
                own = min(x.factor, FIRM if x.header and not in_mark[c] else 1.0)
            out[c] = min(out[x.parent], own)
        return out

    main = {c for c in range(1, n) if containers[c].mark and held[c] and held[c] >= MARKED * held[0]}
    factor = factors(main)
    open_ = _sums({c: k for c, k in sizes.items() if factor[c] > FIRM}, containers)
    main = {c for c in main if open_[c] and open_[c] >= MARKED * open_[0]}
    if not main:
        around = 0  # sections that hold nearly all lie in one another; one is entered if it leaves out anything of the page, or a line of another section
        for c in range(1, n):
            least = 1 if containers[containers[c].parent].tag in ("", "html", "body") else LINE
            if containers[c].tag in _SECTIONS and factor[c] == 1.0 and open_[c] >= SECTION * open_[0] and open_[around] - open_[c] >= least:
                around = c
        main = {around} if around else set()
    inside = [False] * n
    for c in range(1, n):
        inside[c] = c in main or inside[containers[c].parent]
    return (inside if main else [True] * n), factors(main)


class Weights(NamedTuple):
    """The weights of lines with WINDOW empty ones where the article or a container apart begins or ends, the line of each (-1: empty), whether it may
    be all that a page says, and whether it stands in the article."""

    weight: list[float]
    line: list[int]
    fit: list[bool]
    inside: list[bool]


def weights(lines: list[Line], containers: list[Container]) -> Weights:
    """What the lines of a page weigh."""
    inside, factor = article_of(lines, containers)
    out, which, fit, within, last = [], [], [], [], None
    for k, x in enumerate(lines):
        state = inside[x.container], factor[x.container]
        if last is not None and state != last:
            out += [0.0] * WINDOW
            which += [-1] * WINDOW
            fit += [False] * WINDOW
            within += [False] * WINDOW
        last = state
        n = len(x.text)
        out.append(0.0 if 2 * x.linked >= n and not (state[0] and factor[x.container] == 1.0) else n / (n + HALF) * (INSIDE if state[0] else OUTSIDE) * state[1])
        which.append(k)
        fit.append(state[1] > FIRM)
        within.append(state[0])
    return Weights(out, which, fit, within)


def regions(weight: list[float], surge: float = SURGE, window: int = WINDOW, fit: list[bool] | None = None, inside: list[bool] | None = None) -> list[tuple[int, int]]:
    """(first, end) of the runs of lines where the window sums are over nothing and surge over ``surge``, and without a line ``inside`` the article also
    over BESIDE times the highest sum.

    If no sum surges, the run with the most weight is the only one, by the lines that are ``fit``.
    """
    n = len(weight)
    sums = [sum(weight[i:i + window]) for i in range(n)]
    runs, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        end = i
        while end < n and sums[end]:
            end += 1
        runs.append((i, end))
        i = end
    high = BESIDE * max(sums, default=0.0)
    strong = [(a, b) for a, b in runs if max(sums[a:b]) > (surge if inside is None or any(inside[a:b]) else max(surge, high))]
    own = [w if fit is None or fit[k] else 0.0 for k, w in enumerate(weight)]
    return strong or sorted((r for r in runs if any(own[r[0]:r[1]])), key=lambda r: (-sum(own[r[0]:r[1]]), r))[:1]


def main_text(page: str | None) -> str:
    """The article of a page, one line for each block. Empty for null and for pages without text."""
    lines, containers = lines_of(page or "")
    w = weights(lines, containers)
    return "\n".join(lines[w.line[k]].text for a, b in regions(w.weight, fit=w.fit, inside=w.inside) for k in range(a, b) if w.weight[k])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text. Character references are decoded, white space in a block becomes one
    space. Repeated rows come back each; an empty table gives no rows; other columns are ignored. No shuffle.
    """
    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).cast("string").alias("url"), text_of(html_col).alias("html"))
    return map_arrow(rows, _extract, "page_id long, url string, text string, n_chars long")
