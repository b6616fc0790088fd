"""Main text of web pages from flat text blocks.

A page is read as a flat row of text blocks: block-level tags separate them, inline tags don't. Each block has its
word count, its link density, those of its neighbours, and where it stands (in an article; in navigation, header,
footer, aside or form, but not in one around the whole article; in an element whose class or id names such a thing; a heading). A decision tree, fitted to the
small labelled table LAYOUTS, says which blocks are main text. Scripts, styles, comments and heads are no blocks.

Null and empty html give an empty text. Unclosed tags, broken attributes and unfinished character references are read
as far as they go: of what isn't read, only a script, style or textarea without an end tag lasts to the end of the page; a head
ends at the first tag of a body, an option at a tag that isn't inline, and a nav, footer, aside or form without an end tag is no place
at all. Repeated rows are read each; other columns are not read. An empty table has an empty result; pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import in_small_batches

_markup = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^<>]*)>"
    r"|<[!?/][^<>]*>",
    re.I | re.S,
)
_named = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_hidden = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
#: What a class, id or role says an element is for: alone (sidebar), last (site-footer, article-comments), or first before one of PARTS
#: (cookie-banner, commentSection). Behind one of DENIED it says nothing (has-sidebar), and neither does a header of one of TEXTS (post-header).
PURPOSES = set("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies contentinfo disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related reply replies share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split())
PARTS = set("area articles bar block blocks bottom box button buttons center column container content form group icons inner item items left line links list main menu message notice outer overlay panel posts right section signup slot stories thread top unit widget wrap wrapper".split())
DENIED = set("has is no non not with without".split())
TEXTS = set("article blog content entry main news page post section story text".split())

INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
#: Of these an article within is an article nevertheless: some pages are one form, some navigation is not ended where it ends.
AROUND = {"nav", "form", "header"}
MAIN = {"article", "main"}
#: No text of a page: RAW up to its end tag or that of the page; UNREAD only with an end tag of its own (those of NESTED pair up).
RAW = {"script", "style", "textarea"}
UNREAD = {"noscript", "template", "svg", "iframe", "select", "button", "option", "title"}
NESTED = {"svg", "template"} | CHROME
#: Tags that leave a head open.
IN_HEAD = {"head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
#: What holds a page as a whole; a class there says nothing of its text.
WHOLE = {"html", "body"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_tags = {t: re.compile(rf"<(/?){t}(?![a-z0-9:-])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^<>]*)>", re.I) for t in UNREAD | {"head"} | CHROME}
_raw_ends = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: An option without an end tag: text and inline tags.
_option = re.compile(rf"(?:[^<]|<(?![a-z/!?])|<(?=/?(?:{'|'.join(sorted(INLINE))})(?![a-z0-9:-])))*+", re.I)
#: Elements whose place counts for the blocks within; of the others only those with a telling class or id.
PLACES = CHROME | MAIN

#: The labelled table: a page is a paragraph, a block is a line: where it stands (any of main, chrome, named, or -), tag, words,
#: words (of several such blocks, if several), words in links, label (1: main text).
LAYOUTS = """
chrome li 1 1 0
chrome li 2 2 0
chrome li 1 1 0
named div 9 0 0
main h1 8 0 1
main p 64 0 1
main p 12 0 1
main p 3 0 1
main p 1 0 1
chrome p 14 0 0

chrome li 1 1 0
named div 30 0 0
main h1 6 0 1
main p 25 0 1
main h2 3 0 1
main li 7 1 1
main li 5 5 1
main p 40 2 1
main,named p 22 0 0
main,named li 3 3 0
main,chrome p 18 0 0
main,chrome p 3 0 0
chrome p 9 3 0

chrome li 2 2 0
chrome li 1 1 0
named p 17 0 0
main h1 5 0 1
main p 2 0 1
main p 150 3 1
main p 80 0 1
chrome p 26 0 0
named p 44 0 0
named p 12 0 0

chrome p 8 0 0
chrome li 1 1 0
named div 2 0 0
main p 1 0 1
chrome p 11 0 0

- li 1 1 0
- li 2 2 0
- li 1 1 0
- div 3 2 0
- h1 9 0 1
- p 55 1 1
- p 70 0 1
- p 18 0 1
- p 90 4 1
- h2 4 0 1
- p 33 0 1
- div 6 5 0
- div 2 2 0
- div 3 0 0

- div 2 2 0
- div 2 2 0
- h1 7 0 1
- p 120 0 1
- p 45 3 1
- p 60 0 1
named p 50 0 0
named p 35 0 0
- div 4 3 0
- div 5 5 0
- div 1 1 0

chrome li 1,2,1,1,3,1 1 0
named p 6,25 0 0
main h1 9 0 1
main p 70,4,12,90,1,33,8,120,15,3,55,7,22,41,2,9,64 0 1
chrome p 10,31,4 0 0

chrome li 1,1,1 1 0
chrome p 45 0 0
named div 70 0 0
main h1 4 0 1
main p 5,8,3,10,6,1,12,4,9,2,7,20,11 0 1
main p 35,9,60 8 1
chrome p 70,12 0 0

named li 2,1,4,2 1 0
named p 90,3,15 0 0
main p 14,2,100,30,6,18,1,80,5,26,11,3,48 0 1
main,named p 5,40,12,1,33 0 0
main p 7,85 0 1
main,chrome li 3,9,2,30 1 0
named p 28,4,60,7 0 0

- div 4 4 0
- div 9 9 0
- li 3,2,6 3 0
- h1 5 0 1
- p 6 0 1
- p 40 2 1
- p 3,8 0 1
- p 22 1 1
- p 5 1 1
- p 31 0 1
- div 25 22 0
- div 14,3,8 14 0

- p 30 28 0
- div 18,6,2 18 0
- h1 7 0 1
- p 4,50,2,9,70,5 0 1
- p 28 6 1
- p 7,3,33 1 1
- li 12,20,15 12 0
- p 45 40 0
- div 11,2,7 11 0

- li 2,5,3,1 5 0
- p 60 5 1
- p 2,4,6,3 0 1
- p 90 8 1
- p 8 0 1
- p 35 3 1
- li 16,24,9,30 30 0
- p 40 37 0

- h1 4 0 1
- p 12,50,7 0 1

- p 9 0 1

- p 4 0 1

- p 2 0 1

- h1 6 0 1
- p 20 0 1
- h3 5 0 1
- p 24 0 1
- div 22 21 0
- h3 4 0 0
- div 26 26 0
- h3 6 0 0
- div 21 20 0

- li 3,2,3 3 0
- h1 5 0 1
- p 64 8 1
- p 3 0 1
- p 50 0 1
- div 25 25 0

- h1 7 0 1
- p 22 0 1
- h3 4 0 1
- p 26 1 1
- h3 6 0 1
- p 21 0 1

- li 4,4,3 4 0
- p 30,2 1 1

main h1 5 0 1
main p 3,40,8,66 0 1
main li 6,3,9,4,25,31,2 31 1
main p 12,1,44 44 1
main p 1,20 0 1

main p 2,7,1 0 1
main li 4,4,40,8,2,12,6,3 40 1
main h2 3 3 1
main li 10,2,5,5,18,7 18 1
main div 6,33,2 33 1

chrome li 3,1 3 0
main li 5,22,9,4,30,2,2,6 30 1
main p 15,3,70 2 1
main li 1,4,8 8 1

chrome h1 4 0 0
chrome p 12 0 0
- h1 6 0 1
- p 38 0 1
- p 29 1 1
chrome h3 2 0 0
chrome li 4 4 0
chrome p 40 2 0
named h3 2 0 0
named p 61 0 0
- div 3 3 0
"""


class Tree:
    """A binary decision tree by Gini impurity, as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.nodes: list[tuple[int, float, int, int, float]] = []  # feature (-1: a leaf), threshold, left, right, share of 1
        self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        best = (1e-9, -1, 0.0)
        gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v)
        for f in range(x.shape[1]) if depth and 0 < y.mean() < 1 else ():
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                if (gain := gini(y) - gini(y[left]) - gini(y[~left])) > best[0]:
                    best = (gain, f, float(cut))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            self.nodes[me] = (best[1], best[2], self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1), float(y.mean()))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, share = (np.array(c) for c in zip(*self.nodes, strict=True))
        at = np.zeros(len(x), int)
        while (live := feature[at] >= 0).any():
            f = feature[at]
            at = np.where(live, np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at]), at)
        return share[at] >= 0.5


def features(blocks: list[tuple[int, int, bool, bool, bool, bool]]) -> np.ndarray:
    """Of one page's blocks (words, words in links, in main, in chrome, named so, heading)."""
    x = np.zeros((len(blocks), 10))
    if blocks:
        b = np.array(blocks, float)
        words, dense = b[:, 0], b[:, 1] / np.maximum(b[:, 0], 1)
        x[:, 0], x[:, 1] = words, dense
        x[1:, 2], x[1:, 3], x[:-1, 4], x[:-1, 5] = words[:-1], dense[:-1], words[1:], dense[1:]
        x[:, 6:] = b[:, 2:]
    return x


def fitted() -> Tree:
    xs, ys = [], []
    for page in LAYOUTS.strip().split("\n\n"):
        rows = [[place, tag, n, k, y] for place, tag, ns, k, y in map(str.split, page.splitlines()) for n in ns.split(",")]
        xs.append(features([(int(n), min(int(n), int(k)), "main" in place, "chrome" in place, "named" in place, tag in HEADING) for place, tag, n, k, _ in rows]))
        ys += [int(r[-1]) for r in rows]
    return Tree(np.vstack(xs), np.array(ys))


def for_chrome(attributes: str) -> bool:
    """Whether an element's class, id or role says that it is no main text."""
    for names in _named.findall(attributes):
        for name in names.strip("\"'").split():
            words = [w for w in re.split("[-_]+", _camel.sub("-", name).lower()) if w]
            if not words or words[0] in DENIED or len(words) > 1 and words[-1] == "header" and words[-2] in TEXTS:
                continue
            if words[-1] in PURPOSES or words[0] in PURPOSES and words[-1] in PARTS:
                return True
    return False


def ends_of(page: str, tag: str) -> dict[int, int]:
    """Where the elements of a tag end, by where their start tags end; those without an end tag are left out."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in _tags[tag].finditer(page):
        if m[1]:
            if opened:
                ends[opened.pop()] = m.end()
        elif not (tag == "svg" and m[2].endswith("/")):
            if tag not in NESTED:
                opened.clear()
            opened.append(m.end())
    return ends


def blocks_of(page: str) -> tuple[list[str], list[tuple[int, int, bool, bool, bool, bool]]]:
    """The texts of a page's blocks, and what is known of each."""
    texts: list[str] = []
    known: list[tuple[int, int, bool, bool, bool, bool]] = []
    parts: list[str] = []
    linked, link, heading = 0, False, False
    places: list[tuple[str, str]] = []  # open elements that count: tag, what for
    depth: dict[str, int] = {"main": 0, "chrome": 0, "around": 0, "named": 0}
    out: list[int] = []  # for each open article, what was open around it

    def end() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                n = text.count(" ") + 1
                texts.append(text)
                known.append((n, min(n, linked), depth["main"] > 0, depth["chrome"] + depth["around"] - (out[-1] if out else 0) > 0, depth["named"] > 0, heading))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link:
            linked += len(text.split())

    at, head = 0, 0  # head: where an open head that has an end tag ends; its text is not read
    found: dict[str, dict[int, int]] = {}
    while m := _markup.search(page, at):
        if m.start() > at and m.start() >= head:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag not in IN_HEAD:
            head = 0
        if not closing and tag in RAW:
            last = _raw_ends[tag].search(page, at)
            at = last.end() if last else len(page)
            end()
            continue
        if not closing and (tag in UNREAD or tag == "head"):
            if tag not in found:
                found[tag] = ends_of(page, tag)
            past = found[tag].get(at)
            if tag == "head":
                head = past or 0
            elif past or tag in ("button", "svg", "option"):
                if past:
                    at = past
                elif tag == "option":
                    at = _option.match(page, at).end()
                if tag not in ("button", "svg", "option"):
                    end()
                continue
        if tag == "a":
            link = not closing
            continue
        if tag == "br" or tag == "img":
            parts.append(" ")
        if tag in INLINE:
            continue
        end()
        heading = tag in HEADING and not closing
        if closing:
            if any(p[0] == tag for p in places):
                while True:
                    was, what = places.pop()
                    if what:
                        depth[what] -= 1
                    if what == "main":
                        out.pop()
                    if was == tag:
                        break
            link = link and tag not in PLACES
        elif tag not in VOID:
            what = ""
            if tag in CHROME and not (tag == "header" and depth["main"]):
                if tag not in found:
                    found[tag] = ends_of(page, tag)
                if at in found[tag]:  # one without an end has no known extent
                    what = "around" if tag in AROUND else "chrome"
            elif tag in MAIN:
                what = "main"
            elif m[3] and tag not in WHOLE and (_hidden.search(m[3]) or for_chrome(m[3])):
                what = "named"
            if what or any(p[0] == tag for p in places):
                places.append((tag, what))
                if what:
                    depth[what] += 1
                if what == "main":
                    out.append(depth["around"])
    if at < len(page):
        say(page[at:])
    end()
    return texts, known


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    tree = fitted()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [blocks_of(h or "") for h in part.column(2).to_pylist()]
                keep = iter(tree.predict(np.vstack([np.zeros((0, 10)), *(features(k) for _, k in found)])).tolist())
                texts = ["\n\n".join([t for t in ts if next(keep)]) for ts, _ in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return in_small_batches(pages).select("page_id", "url", "html").mapInArrow(apply, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
