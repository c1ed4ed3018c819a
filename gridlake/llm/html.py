"""Main text of web pages from flat text blocks.

A page is cut into blocks of text between block-level tags.  Each block has its word count and
link density and those of its neighbours, and what its surroundings say (an article or a
navigation element around it, a heading, a telling class name).  A decision tree, trained on
the small labelled table below, tells main text from the rest.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.session import bounded_batches

# Elements by role, as HTML defines them.
HIDDEN = ("script style noscript template svg math iframe object canvas head textarea select option button audio video "
          "title").split()
RAW = "script style textarea title iframe noscript template".split()
MAIN = {"article", "main"}
ASIDE = {"nav", "header", "footer", "aside", "menu", "dialog"}
MARKED_TAGS = {"form"}  # around a whole page it is a layout, as some site kits write it
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = ("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
          "small span strike strong sub sup time tt u var wbr br").split()
METADATA = set("base basefont bgsound head link meta noscript script style template title".split())  # all a head may hold
VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Words of class names and ids that mark what is not the article.
MARKS = ("ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
         "breadcrumbs sidebar widget footer header masthead comment comments disqus respond reply replies notice notices cookie "
         "cookies consent gdpr popup modal alert newsletter subscribe signup login share sharing social related recommended "
         "pagination pager copyright legal skip toolbar search adbox feedback responses").split()

# A name that begins or ends so tells what a page or its layout has or lacks, or how a post is filed: no mark.
BEGINS = set("with without no not has have hide category tag type format status".split())
ENDS = {"page", "layout"}
LAYOUT_WORDS = 25  # a marked element with fewer words outside links is no layout

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_aside",
            "marked", "heading")

# Labelled blocks: the ten features, then 1 for main text.
LABELLED = [
    (120, 0.00, 80, 0.00, 95, 0.00, 1, 0, 0, 0, 1), (64, 0.05, 120, 0.00, 30, 0.00, 1, 0, 0, 0, 1),
    (1, 0.00, 40, 0.00, 60, 0.00, 1, 0, 0, 0, 1), (3, 0.00, 0, 0.00, 75, 0.00, 1, 0, 0, 1, 1),
    (9, 0.00, 12, 0.00, 110, 0.00, 1, 0, 0, 1, 1), (14, 0.30, 50, 0.02, 40, 0.00, 1, 0, 0, 0, 1),
    (2, 0.00, 1, 0.00, 2, 0.00, 1, 0, 0, 0, 1), (5, 1.00, 90, 0.00, 88, 0.00, 1, 0, 0, 0, 1),
    (300, 0.01, 9, 0.00, 11, 0.00, 1, 0, 0, 0, 1), (22, 0.10, 2, 1.00, 18, 0.00, 1, 0, 0, 0, 1),
    (40, 0.00, 12, 0.00, 9, 0.10, 1, 0, 0, 0, 1), (7, 0.00, 0, 0.00, 0, 0.00, 1, 0, 0, 0, 1),
    (1, 1.00, 30, 0.00, 45, 0.00, 1, 0, 0, 0, 1), (18, 0.90, 25, 0.50, 31, 0.40, 1, 0, 0, 0, 0),
    (2, 0.00, 1, 1.00, 4, 0.00, 1, 0, 0, 0, 1), (30, 0.00, 2, 1.00, 1, 0.00, 1, 0, 0, 0, 1),
    (5, 0.00, 2, 1.00, 3, 0.00, 1, 0, 0, 1, 1), (4, 0.00, 1, 1.00, 200, 0.00, 1, 0, 0, 0, 1),
    (3, 0.00, 3, 1.00, 2, 1.00, 1, 0, 0, 0, 0), (1, 0.00, 2, 0.90, 1, 0.80, 1, 0, 0, 0, 0),
    (4, 0.50, 6, 0.70, 5, 1.00, 1, 0, 0, 0, 0), (2, 1.00, 2, 1.00, 2, 1.00, 1, 0, 0, 0, 0),
    (8, 0.70, 3, 0.90, 4, 1.00, 1, 0, 0, 0, 0), (15, 0.60, 8, 0.80, 2, 1.00, 1, 0, 0, 0, 0),
    (30, 0.50, 5, 0.90, 7, 0.90, 1, 0, 0, 0, 0), (4, 1.00, 60, 0.00, 3, 1.00, 1, 0, 0, 0, 0),
    (3, 1.00, 4, 1.00, 70, 0.00, 1, 0, 0, 0, 0), (9, 1.00, 0, 0.00, 6, 1.00, 1, 0, 0, 0, 0),
    (7, 1.00, 8, 1.00, 0, 0.00, 1, 0, 0, 0, 0), (5, 1.00, 80, 0.00, 9, 0.00, 1, 0, 0, 1, 0),
    (6, 1.00, 2, 1.00, 110, 0.00, 1, 0, 0, 1, 1), (6, 1.00, 75, 0.00, 90, 0.00, 1, 0, 0, 1, 1),
    (10, 0.00, 3, 1.00, 2, 1.00, 1, 0, 0, 0, 1), (6, 0.00, 2, 1.00, 4, 0.00, 1, 0, 0, 1, 1),
    (85, 0.02, 70, 0.01, 0, 0.00, 1, 0, 0, 0, 1), (11, 0.00, 90, 0.00, 15, 0.10, 1, 0, 0, 1, 1),
    (6, 0.00, 5, 1.00, 80, 0.00, 1, 1, 0, 1, 0), (12, 0.10, 40, 0.00, 3, 1.00, 1, 1, 0, 0, 0),
    (25, 0.00, 60, 0.00, 70, 0.00, 1, 0, 1, 0, 0), (90, 0.00, 60, 0.00, 70, 0.00, 1, 0, 1, 0, 0),
    (4, 0.00, 60, 0.00, 30, 0.00, 1, 0, 1, 1, 0), (2, 1.00, 1, 1.00, 1, 1.00, 1, 1, 0, 0, 0),
    (45, 0.05, 100, 0.00, 20, 0.20, 1, 1, 1, 0, 0), (150, 0.00, 90, 0.00, 60, 0.00, 1, 1, 0, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 0, 0, 0), (2, 1.00, 3, 1.00, 1, 1.00, 0, 1, 1, 0, 0),
    (20, 0.00, 1, 1.00, 9, 0.00, 0, 0, 1, 0, 0), (130, 0.00, 80, 0.00, 100, 0.00, 0, 0, 1, 0, 0),
    (13, 0.00, 90, 0.00, 0, 0.00, 0, 1, 0, 0, 0), (3, 0.00, 0, 0.00, 2, 1.00, 0, 1, 0, 1, 0),
    (70, 0.10, 40, 0.00, 30, 0.00, 0, 1, 0, 0, 0), (240, 0.00, 10, 0.00, 12, 0.00, 0, 1, 0, 0, 0),
    (4, 1.00, 5, 1.00, 6, 1.00, 0, 0, 0, 0, 0), (8, 0.70, 3, 0.90, 4, 1.00, 0, 0, 0, 0, 0),
    (2, 0.00, 1, 1.00, 3, 1.00, 0, 0, 0, 0, 0), (15, 0.60, 8, 0.80, 2, 1.00, 0, 0, 0, 0, 0),
    (30, 0.50, 5, 0.90, 7, 0.90, 0, 0, 0, 0, 0), (6, 0.00, 2, 1.00, 4, 0.00, 0, 0, 0, 0, 0),
    (95, 0.00, 70, 0.00, 60, 0.00, 0, 0, 0, 0, 1), (60, 0.05, 6, 0.00, 80, 0.00, 0, 0, 0, 0, 1),
    (35, 0.10, 90, 0.00, 2, 1.00, 0, 0, 0, 0, 1), (180, 0.02, 4, 1.00, 50, 0.00, 0, 0, 0, 0, 1),
    (12, 0.00, 80, 0.00, 90, 0.00, 0, 0, 0, 0, 1), (8, 0.00, 12, 0.00, 120, 0.00, 0, 0, 0, 1, 1),
    (16, 0.00, 40, 0.00, 45, 0.00, 0, 0, 0, 0, 1), (5, 0.00, 60, 0.00, 75, 0.00, 0, 0, 0, 1, 1),
    (10, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0, 0, 0), (3, 0.00, 4, 0.00, 2, 0.00, 0, 0, 0, 1, 0),
]

# Labelled blocks that are the same in and out of main: words, links, those before and after, heading, label.
EITHER = [
    (70, 0.00, 4, 1.00, 3, 1.00, 0, 1), (70, 0.00, 0, 0.00, 0, 0.00, 0, 1), (50, 0.05, 80, 0.00, 3, 1.00, 0, 1),
    (120, 0.00, 2, 1.00, 5, 0.00, 0, 1), (45, 0.00, 6, 0.00, 6, 0.00, 0, 1), (200, 0.10, 3, 1.00, 2, 1.00, 0, 1),
    (80, 0.30, 60, 0.00, 50, 0.10, 0, 1), (40, 0.25, 50, 0.30, 4, 1.00, 0, 1), (35, 0.00, 1, 0.00, 1, 1.00, 0, 1),
    (18, 0.00, 60, 0.00, 4, 1.00, 0, 1), (15, 0.00, 2, 1.00, 70, 0.00, 0, 1), (20, 0.20, 45, 0.10, 30, 0.00, 0, 1),
    (25, 0.00, 40, 0.00, 0, 0.00, 0, 1), (60, 0.00, 8, 1.00, 0, 0.00, 0, 1), (3, 0.00, 60, 0.00, 70, 0.00, 0, 1),
    (6, 0.00, 2, 1.00, 90, 0.00, 1, 1), (4, 0.00, 70, 0.00, 60, 0.00, 1, 1), (9, 0.00, 0, 0.00, 50, 0.00, 1, 1),
    (7, 1.00, 2, 1.00, 100, 0.00, 1, 1), (5, 1.00, 70, 0.00, 80, 0.00, 0, 1), (30, 0.40, 70, 0.00, 60, 0.00, 0, 1),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0), (3, 1.00, 60, 0.00, 2, 1.00, 0, 0), (2, 1.00, 2, 1.00, 60, 0.00, 0, 0),
    (2, 1.00, 0, 0.00, 2, 1.00, 0, 0), (2, 1.00, 2, 1.00, 0, 0.00, 0, 0), (3, 1.00, 3, 1.00, 5, 0.00, 0, 0),
    (1, 1.00, 5, 0.00, 1, 1.00, 0, 0), (6, 1.00, 8, 1.00, 7, 1.00, 0, 0), (9, 0.80, 60, 0.00, 9, 0.80, 0, 0),
    (9, 0.80, 9, 0.80, 60, 0.00, 0, 0), (12, 0.90, 12, 0.90, 0, 0.00, 0, 0), (25, 0.80, 20, 0.90, 22, 0.90, 0, 0),
    (5, 1.00, 5, 1.00, 12, 0.00, 1, 0), (4, 1.00, 50, 0.00, 4, 1.00, 1, 0), (14, 1.00, 40, 0.00, 0, 0.00, 0, 0),
    (12, 1.00, 0, 0.00, 80, 0.00, 0, 0), (40, 0.90, 4, 1.00, 6, 1.00, 0, 0), (2, 0.00, 3, 1.00, 3, 1.00, 1, 0),
    (8, 0.00, 60, 0.00, 70, 0.00, 0, 1), (6, 0.00, 50, 0.00, 40, 0.00, 0, 1), (3, 1.00, 40, 0.00, 45, 0.00, 0, 1),
    (3, 1.00, 70, 0.00, 2, 1.00, 0, 0), (4, 1.00, 72, 0.00, 0, 0.00, 0, 0), (8, 1.00, 120, 0.00, 3, 1.00, 0, 0),
    (3, 1.00, 2, 1.00, 120, 0.00, 0, 0), (2, 1.00, 3, 1.00, 100, 0.00, 0, 0), (1, 1.00, 1, 1.00, 90, 0.00, 0, 0),
    (5, 1.00, 90, 0.00, 4, 1.00, 0, 0), (1, 1.00, 95, 0.00, 1, 1.00, 0, 0), (6, 1.00, 6, 1.00, 130, 0.00, 0, 0),
]
# Short lines, which count in main only: words, those before and after, heading.
SHORT = [
    (2, 2, 2, 0), (2, 2, 3, 0), (3, 3, 1, 0), (1, 2, 1, 0), (2, 9, 2, 0), (3, 6, 3, 1), (1, 4, 2, 1), (2, 3, 0, 0), (3, 2, 12, 0),
    (6, 3, 4, 0), (8, 2, 3, 0),
]
for _row in EITHER:
    for _main in (0, 1):
        LABELLED.append((*_row[:6], _main, 0, 0, *_row[6:]))
        LABELLED.append((*_row[:6], _main, 1, 0, _row[6], 0))
        # a mark around nearly all the text of a page is a layout
        LABELLED += [(*_row[:6], _main, 0, marked, _row[6], _row[7] * (marked <= 0.2)) for marked in (0.1, 0.2, 0.4, 1)]
for _words, _before, _after, _heading in SHORT:
    LABELLED += [(_words, 0.00, _before, 0.00, _after, 0.00, _main, 0, 0, _heading, _main) for _main in (0, 1)]
LABELLED += [(w, 0.00, before, 0.00, 2, 0.00, 1, 0, 0, 0, 1) for w, before in ((2, 60), (3, 25), (1, 45), (3, 100), (2, 280))]


class Tree:
    """A binary decision tree grown by Gini impurity, kept as node arrays."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 1):
        self.feature, self.limit, self.low, self.high, self.value = [], [], [], [], []
        self._grow(rows, labels.astype(float), depth, least)
        for name in ("feature", "limit", "low", "high", "value"):
            setattr(self, name, np.array(getattr(self, name)))

    def _grow(self, rows, labels, depth, least) -> int:
        node = len(self.feature)
        for part, value in zip((self.feature, self.limit, self.low, self.high, self.value), (-1, 0.0, -1, -1, labels.mean())):
            part.append(value)
        if depth == 0 or len(set(labels)) == 1:
            return node
        best = None
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for limit in (values[1:] + values[:-1]) / 2:
                left = rows[:, f] <= limit
                n = int(left.sum())
                if least <= n <= len(rows) - least:
                    p, q = labels[left].mean(), labels[~left].mean()
                    cost = n * p * (1 - p) + (len(rows) - n) * q * (1 - q)
                    if best is None or cost < best[0] - 1e-12:
                        best = cost, f, limit, left
        if best is not None:
            _, f, limit, left = best
            self.feature[node], self.limit[node] = f, limit
            self.low[node] = self._grow(rows[left], labels[left], depth - 1, least)
            self.high[node] = self._grow(rows[~left], labels[~left], depth - 1, least)
        return node

    def predict(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=int)
        while (inner := self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            lower = rows[np.arange(len(rows)), f] <= self.limit[at]
            at = np.where(inner, np.where(lower, self.low[at], self.high[at]), at)
        return self.value[at]


@functools.cache
def block_tree() -> Tree:
    table = np.array(LABELLED, dtype=float)
    return Tree(table[:, :-1], table[:, -1])


_NAME = r"[a-zA-Z][^\s/>]*"
# quotes delimit a value only at its beginning; every part is taken whole, so a page is read once
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>))"""
_LEX = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>{_NAME})"""
    rf"""(?P<rest>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+)>|(?P<open></?[a-zA-Z])|(?P<text>[^<]+|<)""", re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PAIR = re.compile(r"""([^\s/>=]+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
_NO_DISPLAY = re.compile(r"\bdisplay\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


def _unseen(rest: str) -> bool:
    """Whether attributes hide the element."""
    low = rest.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for name, value in _PAIR.findall(low):
        if name == "hidden" and value.strip("\"'") != "until-found" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def _marked(rest: str) -> bool:
    for _, value in _ATTRIBUTE.findall(rest):
        for name in value.lower().split():
            words = _WORD.findall(name)
            if not _MARKED.isdisjoint(words) and words[0] not in BEGINS and words[-1] not in ENDS:
                return True
    return False


_MARKED, _INLINE, _VOID, _HIDDEN = set(MARKS), set(INLINE), set(VOID), set(HIDDEN)


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, float, bool]]:
    """(text, words, words in links, in main, in aside, marked, heading) of each text block.

    ``marked`` is the share of the page's text outside the innermost marked element, or 0: near
    0 where the element holds nearly all of it, as a layout does.  If there is text in a main
    element, only that counts.  A page without a main element, an aside, a mark or a block of links
    is all main.  Time is in proportion to the page.
    """
    out, parts, link_words, links = [], [], 0, 0
    stack: list[tuple[str, int]] = []  # open block elements: 1 if marked, 2 if not shown
    named: dict[str, int] = {}  # how many of a name are open
    marks: list[int] = []  # open marked elements by number; -1 for a main element, which ends the marks around it
    around: list[int] = []  # open marked elements
    holds: list[list[int]] = []  # words outside links in each marked element: all, in a main element
    page_holds = [0, 0]
    depth = {"main": 0, "aside": 0, "heading": 0, "hidden": 0, "mains": 0}

    def leave_mark() -> None:
        """What the innermost marked element holds counts for the one around it."""
        held = holds[around.pop()]
        if around:
            outer = holds[around[-1]]
            outer[0] += held[0]
            outer[1] += held[1]

    def count(tag: str, kind: int, step: int) -> None:
        depth["main"] += step * (tag in MAIN)
        depth["aside"] += step * (tag in ASIDE)
        depth["heading"] += step * (tag in HEADINGS)
        depth["hidden"] += step * (tag in _HIDDEN or kind > 1)
        named[tag] = named.get(tag, 0) + step
        if tag == "main":
            depth["mains"] += step
        if step < 0 and (kind & 1 or tag == "main"):
            if marks.pop() >= 0:
                leave_mark()
        elif kind & 1:
            marks.append(len(holds))
            around.append(len(holds))
            holds.append([0, 0])
        elif tag == "main":
            marks.append(-1)

    def close_block() -> None:
        nonlocal parts, link_words
        if parts:
            text = _SPACES.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                words = text.count(" ") + 1
                if not depth["aside"]:
                    for held in (page_holds, *([holds[around[-1]]] if around else [])):
                        held[0] += max(0, words - link_words)
                        held[1] += max(0, words - link_words) * (depth["mains"] > 0)
                out.append((
                    text, words, link_words, depth["main"] > 0, depth["aside"] > 0, marks[-1] if marks else -1,
                    depth["heading"] > 0,
                ))
        parts, link_words = [], 0

    def end_head() -> None:
        """A head without end tag stops where anything else than its metadata begins."""
        if stack and stack[-1][0] == "head":
            count(*stack.pop(), -1)

    at = 0
    while at < len(page):
        found = _LEX.match(page, at)
        if found is None or found["open"]:  # a tag that never ends
            break
        at = found.end()
        text = found["text"] or found["cdata"]
        if text is not None:
            if depth["hidden"] and not text.isspace():
                end_head()
            if not depth["hidden"]:
                parts.append(text)
                if links:
                    link_words += len(text.split())
            continue
        if found["tag"] is None:
            continue
        tag, ends = found["tag"].lower(), bool(found["end"])
        if tag not in METADATA and (not ends or tag in ("body", "html", "br")):
            end_head()
        if tag == "a":
            links = 0 if ends else 1
            continue
        if tag in _INLINE:
            if tag == "br" and not depth["hidden"]:
                parts.append(" ")
            continue
        close_block()
        links = 0
        if ends:
            if named.get(tag):
                while stack:
                    name, kind = stack.pop()
                    count(name, kind, -1)
                    if name == tag:
                        break
        elif tag in RAW and tag != "template":
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif tag not in _VOID and not found["rest"].endswith("/"):
            if tag in ("p", "li", *HEADINGS) and stack and stack[-1][0] in ("p", *HEADINGS, *(["li"] if tag == "li" else [])):
                name, kind = stack.pop()  # these end where the next begins
                count(name, kind, -1)
            kind = int((_marked(found["rest"]) or tag in MARKED_TAGS) and tag not in ("html", "body", "main"))
            kind += 2 * (tag not in ("html", "body") and _unseen(found["rest"]))
            stack.append((tag, kind))
            count(tag, kind, 1)
    close_block()
    while around:
        leave_mark()
    bare = not any(b[3] or b[4] or b[5] >= 0 or 2 * b[2] >= b[1] for b in out)
    inside = int(page_holds[1] > 0)
    outside = [1 - h[inside] / page_holds[inside] if h[inside] >= LAYOUT_WORDS else 1.0 for h in holds]
    return [(*b[:3], b[3] or bare, b[4], outside[b[5]] if b[5] >= 0 else 0.0, b[6]) for b in out]


def main_text(page: str) -> str:
    """Main blocks in page order, one line each; empty if there are none."""
    found = blocks(page)
    if not found:
        return ""
    rows = np.zeros((len(found), len(FEATURES)))
    words = np.array([b[1] for b in found], dtype=float)
    density = np.minimum(1.0, np.array([b[2] for b in found]) / words)
    rows[:, 0], rows[:, 1] = words, density
    rows[1:, 2], rows[1:, 3] = words[:-1], density[:-1]
    rows[:-1, 4], rows[:-1, 5] = words[1:], density[1:]
    rows[:, 6:] = [b[3:] for b in found]
    chosen = block_tree().predict(rows) > 0.5
    return "\n".join(b[0] for b, keep in zip(found, chosen) if keep)


def extract_text(
    pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
) -> DataFrame:
    """The kept columns with ``text`` and ``n_chars`` of every page, from its whole html.

    Null and empty pages give an empty text; repeated rows stay; no page is dropped.  Long and broken
    pages take time in proportion to their length; a tag that never ends is the end of its page.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(*keep, F.coalesce(F.col(html_column), F.lit("")).alias("_html"))
    kept = pages.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def extract(batches):
        from gridlake.llm import html

        for batch in batches:
            texts = [html.main_text(page) for page in batch["_html"].to_pylist()]
            columns = [batch[name] for name in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    return rows.mapInArrow(extract, f"{schema}, text string, n_chars long")
