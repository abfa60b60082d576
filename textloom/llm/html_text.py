"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one a block element), the weights of lines are summed over sliding windows of lines, the sums
surge where a body of text begins and dive where it ends, and the text between surge and dive is kept. A line weighs its
characters outside of links, so a list of links makes the sums dive. Marks and names change weights, and nothing else:

- lines of menus, adverts, comments and so on weigh nothing, neither do they stand between surge and dive;
- where no text surges, those that only a class name, an id or a form speaks against weigh a quarter;
- lines of an article, main element or element named so each weigh ``SURGE`` more, so short bodies surge too.

The distribution is taken over all lines, and over those of each kind of marked elements. Of the kinds, the best-ranked
counts whose kept text is at least half of what any kind keeps, if it isn't less than a quarter of what the page keeps.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, table

#: Lines in a window; a surge is a window of at least SURGE characters, a dive one without any.
LINES, SURGE = 3, 60

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "xmp", "svg", "math", "object", "canvas"}
#: Elements that are never main text.
_NEVER = {"nav", "footer", "aside", "menu", "dialog", "button", "select", "datalist", "head", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby", "rb", "rt", "rp"}
#: Words that speak against an element as its name, or as the first or last part of one; a first part of the state words says nothing of the element itself.
_AGAINST = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar toolbar banner header footer contentinfo sidebar complementary aside rail widget "
    "ad ads advert adverts advertisement advertising adsense promo promos promotion sponsor sponsored cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay "
    "share sharing social newsletter subscribe subscription signup login search related recommended recommendations pagination pager skip tags taglist copyright".split()
)
_COMMENTS = set("comment comments commentlist respond replies reply disqus discussion".split())
_STATES = set("has have with without no not is show hide enable".split())
_BODY = set("article main content post entry story articlebody".split())
_RANKS = {"article": 3, "main": 2}
#: Elements that show that the named element or form around them is more than what its name says.
_WRAPPED = {"article", "main", "h1"}


class Line(NamedTuple):
    text: str
    weight: int  # characters outside of links
    marks: int  # bits: ranks of the marked elements around
    never: bool  # in an element that is never main text
    named: int  # number of the innermost element that a name speaks against, or 0


def names_of(attributes: str) -> tuple[set[str], bool]:
    """The names (class, id, role, itemprop) of an element, in lower case, and whether it is hidden."""
    names, hidden = set(), False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id", "role", "itemprop"):
            names.update(value.split())
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return names, hidden


def speaks(names: set[str]) -> tuple[bool, bool, bool]:
    """Whether names say that an element holds comments, isn't main text, is the body."""
    comments = against = body = False
    for name in names:
        parts = re.split("[-_]+", name)
        if parts[0] in _STATES:
            continue
        ends = {parts[0], parts[-1]}
        comments |= not ends.isdisjoint(_COMMENTS)
        against |= not ends.isdisjoint(_AGAINST)
        body |= parts[-1] in _BODY or parts[-1] == "body" and parts[0] in _BODY
    return comments, against and not body, body


def lines_of(page: str) -> tuple[list[Line], list[bool]]:
    """The lines of text, and for each number of a named element whether its name counts. Linear in the page, whatever its depth."""
    lines: list[Line] = []
    runs: list[str] = []
    in_link, links, total = False, 0, 0
    stack: list[tuple[str, int, bool, int]] = []  # element, marks, never main text, innermost named element
    open_ = Counter()
    parents, counts, undecided = [0], [False], []
    marks, never, named = 0, False, 0

    def add(raw: str) -> None:
        nonlocal links, total
        text = html.unescape(raw)
        runs.append(text)
        n = sum(map(len, text.split()))
        total += n
        links += n * in_link

    def end_line() -> None:
        nonlocal links, total
        text = " ".join("".join(runs).split())
        runs.clear()
        if text:
            lines.append(Line(text, len(text) * (total - links) // total if links else len(text), marks, never, named))
        links = total = 0

    def pop() -> str:
        nonlocal marks, never, named
        name, _, _, own = stack.pop()
        open_[name] -= 1
        _, marks, never, named = stack[-1] if stack else ("", 0, False, 0)
        if own != named and undecided and undecided[-1] == own:
            undecided.pop()
        return name

    at, n = 0, len(page)
    while at < n:
        found = _TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = not closing and "href" in attributes.lower()
        if name == "br":
            runs.append(" ")
        elif name == "hr":
            end_line()
        if name in _VOID:
            continue
        if name in _RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{name}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else n
            continue
        names, hidden = names_of(attributes) if attributes and not closing else (set(), False)
        comments, against, body = speaks(names) if names else (False, False, False)
        if name in _INLINE and not (open_[name] if closing else comments or against or hidden):
            continue
        end_line()
        if closing:
            if open_[name]:
                while pop() != name:
                    pass
            continue
        if attributes.endswith("/"):
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:  # neither needs a closing tag
            pop()
        if name in ("html", "body"):
            comments = against = body = False
        if name in _WRAPPED and not comments:
            while undecided:
                counts[undecided.pop()] = False
        rank = _RANKS.get(name, 1 if body and name not in ("p", "li") else 0)
        if comments or hidden or name in _NEVER or name == "header" and not marks >> 2:
            never = True
        elif name == "form" or against and name not in _RANKS:
            parents.append(named)
            counts.append(True)
            named = len(counts) - 1
            undecided.append(named)
        elif rank and not never:
            marks |= 1 << rank
        stack.append((name, marks, never, named))
        open_[name] += 1
    end_line()
    for k in range(1, len(counts)):
        counts[k] |= counts[parents[k]]
    return lines, counts


def surges(weights: list[int], window: int = LINES, least: int = SURGE) -> list[tuple[int, int]]:
    """Half-open line ranges between a surge and the next dive of the window sums, from the first line of any weight on."""
    n = len(weights)
    sums = [sum(weights[k : k + window]) for k in range(n)]
    out, k = [], 0
    while k < n:
        if sums[k] >= least:
            start = k
            while not weights[start]:
                start += 1
            end = start
            while end < n and sums[end] > 0:
                end += 1
            out.append((start, end))
            k = end
        else:
            k += 1
    return out


def kept_lines(weights: list[int | None]) -> list[int]:
    """The lines between surges and dives; None: a line that never stands there."""
    return [k for a, b in surges([w or 0 for w in weights]) for k in range(a, b) if weights[k] is not None]


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by one space; empty for a null or empty page."""
    lines, counts = lines_of(page or "")
    out = [x.never or counts[x.named] for x in lines]
    best = kept_lines([None if o else x.weight for o, x in zip(out, lines)])
    size = lambda kept: sum(len(lines[k].text) for k in kept)
    kinds = [kept_lines([None if o or not x.marks >> r & 1 else x.weight and x.weight + SURGE for o, x in zip(out, lines)]) for r in (3, 2, 1)]
    most = max(map(size, kinds))
    if most and 4 * most >= size(best):
        best = next(kept for kept in kinds if 2 * size(kept) >= most)
    if not best:
        best = kept_lines([None if x.never else x.weight // 4 if o else x.weight for o, x in zip(out, lines)])
    return " ".join(lines[k].text for k in best)


PAGE = "page_id long, url string, text string, n_chars long"
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    A null or empty html gives an empty text; null ids and urls are kept; repeated rows are kept; an empty table gives
    an empty table; other columns are left out. The whole html is read, whatever its length.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_PAGE)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, PAGE)


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
