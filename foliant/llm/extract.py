"""Main-text extraction from HTML by the line-block distribution.

The markup is stripped in one pass that starts a new line at every block-level
tag.  A line's weight is the length of its text outside links, and nothing for
lines in navigation, headers, footers, sidebars, forms, notices, adverts and
reader comments, which count as absent.  The page, body, main and article elements are never such
furniture, nor is a class for what a block has or lacks (``no-sidebar``); a form
or named block with most of the page's text and a heading, article or furniture
of its own is a wrapper if too little text is left outside.  The weights are summed over sliding windows of lines, where an
empty line stands for an element without text and not for the space between two
tags; a stretch of text ends at the dive to a window of nothing and is kept if
its sum surges above the threshold, however short its lines are.  That holds on
every page: lines that the page marks as its article (``article`` or ``main``)
get a bonus, so few characters of them make a surge, but a stretch of less, far
from other text, makes none there either; text outside has to surge by its own
length, and a stretch also ends where a marked article begins or ends.  Where
nothing on a page surges, the heaviest stretch of its marked article is kept.

All of it is linear in the page's length; nothing is cut or capped.

Defined results
* null and empty pages, and pages without main text, give the empty string;
  whole pages are read, however long; repeated rows each get their row, an empty
  table gives no rows; other columns are not read and may have any name;
* character references are decoded, white space within a line becomes one
  space, lines are trimmed and joined in page order by one space;
* comments, scripts, styles and other unrendered elements are no text; an
  unclosed one of them runs to the end of the page; unclosed block or inline
  tags are tolerated; a ``<`` that starts no tag is text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, with_text_batches

#: Lines in a window, weight a stretch needs for a surge, and bonus of a line in a marked article.
WINDOW = 3
SURGE = 60
BONUS = 50

# HTML element names.
UNRENDERED = frozenset("script style noscript template svg math head iframe object canvas audio video select textarea button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
MARKED = frozenset(("article", "main"))
#: Never furniture, whatever their names; and what a block holds that wraps a page.
PAGE = frozenset(("html", "body", "main", "article"))
WRAPPED = BOILERPLATE | frozenset(("article", "main", "h1", "h2"))
RAW = frozenset("script style noscript template iframe textarea svg math".split())
# Words of class, id and role that name page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|notices?|popup|modal|"
    r"newsletter|subscribe|signup|login|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|widget|related|recommend(?:ed|ations)?|"
    r"share|sharing|social|comments?|disqus|replies|reply|footer|header|masthead|toolbar|pagination|search|form|"
    r"contentinfo|complementary|alert|disclaimer|copyright|skip)(?:$|[\s_-])",
    re.I,
)

# What a class says about a block that has or lacks furniture: no-sidebar, layout_with-nav.
_ABOUT = re.compile(r"(?:(?<=[\s_-])|^)(?:no|not|non|has|have|with|without)[_-]\S*", re.I)

_MARKUP = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|([!?]))")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_END = re.compile(r"""[>"']""")


def _tag_end(page: str, at: int) -> int:
    """Where the tag that is open at ``at`` ends (its ``>``), or -1."""
    while m := _END.search(page, at):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        if close < 0:
            return page.find(">", m.end())
        at = close + 1
    return -1


class _Block:
    """A furniture block: whether it may turn out to be the page's wrapper, what it wraps, its texts' lengths."""

    __slots__ = ("above", "may_wrap", "wraps", "own", "whole", "undone")

    def __init__(self, above: _Block | None, may_wrap: bool, wraps: bool):
        self.above, self.may_wrap, self.wraps = above, may_wrap, wraps
        self.own = self.whole = 0
        self.undone = False


def lines(page: str, surge: int) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, is furniture, is in a marked article) of each line of the page."""
    blocks: list[_Block] = []
    found = list(_lines(page, blocks))
    outside = every = 0
    for text, in_links, block, _ in found:
        size = max(0, len(text) - in_links)
        every += size
        if block:
            block.own += size
        else:
            outside += size
    for block in reversed(blocks):  # inner blocks come after outer ones
        block.whole += block.own
        if block.above:
            block.above.whole += block.whole
            block.above.wraps |= block.wraps
    for block in blocks:
        if outside >= surge:
            break
        if block.may_wrap and block.wraps and block.whole * 2 > every and (not block.above or block.above.undone):
            block.undone = True
            outside += block.own
    return [(text, in_links, bool(block) and not block.undone, inside) for text, in_links, block, inside in found]


def _lines(page: str, blocks: list[_Block]) -> Iterator[tuple[str, int, _Block | None, bool]]:
    """The lines with the innermost furniture block around each; furniture blocks are added in page order."""
    entered = ""  # the block element that the last tag opened
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, _Block | None]] = []  # open block elements: name, furniture block outside
    furniture: _Block | None = None
    marked = links = 0
    opened: Counter[str] = Counter()
    at, size, low, last = 0, len(page), None, page.rfind(">")

    def taken() -> tuple[str, int, _Block | None, bool]:
        text = " ".join(html.unescape("".join(parts)).split())
        in_links = len(" ".join(html.unescape(" ".join(linked)).split())) if linked else 0
        parts.clear()
        linked.clear()
        return text, in_links, furniture, marked > 0

    def add(text: str) -> None:
        parts.append(text)
        if links:
            linked.append(text)

    while at < size:
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        if m[1]:
            end = page.find("-->", m.end())
            at = size if end < 0 else end + 3
            continue
        end = _tag_end(page, m.end()) if m.end() <= last else -1
        if end < 0:  # no tag ends behind this place
            add(page[m.start() :])
            break
        at = end + 1
        if m[4]:
            continue
        name, closing, inside = m[3].lower(), bool(m[2]), page[m.end() : end]
        if name in RAW and not closing:
            if not inside.endswith("/"):
                low = low or page.lower()
                stop = low.find(f"</{name}", at) if len(low) == size else page.find(f"</{name}", at)
                at = size if stop < 0 else stop
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in INLINE:
            continue
        line = taken()
        if line[0] or (closing and name == entered):
            yield line
        entered = "" if closing or name in VOID else name
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                while stack:
                    open_name, furniture = stack.pop()
                    opened[open_name] -= 1
                    marked -= open_name in MARKED
                    if open_name == name:
                        break
            if name not in ("p", "li"):
                links = 0
        elif name not in ("p", "li", "td", "tr", "th", "dt", "dd", "option") and not inside.endswith("/"):
            names = " ".join(x or y or z for x, y, z in _NAMES.findall(inside))
            fixed = name in BOILERPLATE or name in UNRENDERED
            stack.append((name, furniture))
            opened[name] += 1
            if furniture and name in WRAPPED:
                furniture.wraps = True
            if name not in PAGE and (fixed or (names and FURNITURE.search(_ABOUT.sub(" ", names)))):
                furniture = _Block(furniture, name == "form" or not fixed, name == "form")
                blocks.append(furniture)
            marked += name in MARKED
    yield taken()


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, bonus: int = BONUS) -> str:
    """The text between the surge and dive points of the page's line-block distribution."""
    if not page:
        return ""
    found = [line for line in lines(page, surge) if not line[2]]
    # In a marked article text that is all link is the article's as well.
    weight = np.array([len(text) + bonus * bool(text) if inside else max(0, len(text) - in_links) for text, in_links, _, inside in found], dtype=np.int64)
    marked = np.array([inside for _, _, _, inside in found], dtype=bool)
    stretches = list(_stretches(weight, marked, window))
    sums = [int(weight[begin:end].sum()) for begin, end in stretches]
    kept = [s for s, total in zip(stretches, sums, strict=True) if total >= surge]
    if not kept:
        own = [(total, -s[0], s) for s, total in zip(stretches, sums, strict=True) if marked[s[0]]]
        kept = [max(own)[2]] if own else []
    return " ".join(found[i][0] for begin, end in kept for i in range(begin, end) if weight[i])


def _stretches(weight: np.ndarray, marked: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the lines between dives, that is windows without weight, or ends of a marked article."""
    held = np.flatnonzero(weight)
    if len(held):
        cuts = np.flatnonzero((np.diff(held) > window) | np.diff(marked[held]))
        yield from zip(held[np.append(0, cuts + 1)].tolist(), (held[np.append(cuts, len(held) - 1)] + 1).tolist(), strict=True)


def extract_text(pages: DataFrame, html_col: str, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars`` of each page."""

    @F.pandas_udf("string")
    def extracted(pages_html: pd.Series) -> pd.Series:
        return pages_html.map(lambda x: main_text(x if isinstance(x, str) else None))

    return with_text_batches(pages).select(*keep, extracted(F.col(html_col)).alias("text")).select(
        *keep, "text", F.length("text").cast("long").alias("n_chars")
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), "html", "page_id", "url")


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLES: dict = {}
