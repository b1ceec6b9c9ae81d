"""Main text of web pages by minimum cut.

A page becomes a sequence of text blocks. A fixed linear score over each
block's markup and text gives two terminal capacities, the cost of calling it
boilerplate and the cost of calling it content. Smoothness edges join
neighbouring blocks, stronger the deeper the branch of the document tree they
share. The maximum flow between the terminals separates content from the
rest. Pages are independent, so nothing is shuffled.

Cases: a null or empty page has no text; unclosed, stray and nested tags are
read leniently; scripts, styles and comments are skipped even if never
closed; character references are decoded after the markup is read; repeated
rows are read each; reading takes time in proportion to the page, however
deep or full of scripts. Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
SPACE = re.compile(r"\s+")
HINT = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Elements whose text is never page text.
SILENT = {"script", "style", "noscript", "template", "head", "textarea", "select", "button", "svg", "iframe", "object", "title", "option"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu",
         "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Elements whose content is text up to their end tag, whatever it looks like.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
# Elements and name parts that mark boilerplate, and those that mark the article.
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
INSIDE = {"article", "main"}
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|login|masthead|menu|modal|nav\w*"
    r"|newsletter|notices?|pagination|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar|signup|sponsor\w*|subscribe"
    r"|widget)(?:$|[\s_-])", re.I)
# Names that boilerplate has, but topics and wrappers of the article too: the text itself must speak against them.
WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:form|social|tags|toolbar)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|(?<=[\s_-]))header(?=$|[\s_-])", re.I)  # an article has one too
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
WEAK = 0.25
TEXT_TAGS = {"p": 1.5, "h1": 2.0, "h2": 1.5, "h3": 1.5, "h4": 1.0, "blockquote": 1.5, "pre": 1.5, "li": 0.5, "td": 1.0, "th": 1.0,
             "figcaption": 0.5, "dd": 0.5, "dt": 0.5}


class Block:
    """``depth``: open block elements around it; ``shared``: how many of them were open since the block before."""

    __slots__ = ("parts", "linked", "tag", "depth", "shared", "outside", "inside")

    def __init__(self, tag: str, depth: int, shared: int, outside: float, inside: float):
        self.parts, self.linked, self.tag, self.depth, self.shared, self.outside, self.inside = [], 0, tag, depth, shared, outside, inside


class Open:
    """An open element, with what holds for it and all elements around it."""

    __slots__ = ("tag", "block", "depth", "outside", "inside", "article")

    def __init__(self, tag: str, around: Open | None, outside: float, inside: float):
        self.tag, block = tag, tag in BLOCK
        self.block = tag if block else around.block if around else "body"
        self.depth = (around.depth if around else 0) + block
        self.outside, self.inside = max(outside, around.outside if around else 0.0), max(inside, around.inside if around else 0.0)
        self.article = tag in INSIDE or around is not None and around.article


def blocks_of(page: str) -> list[tuple[Block, str]]:
    """Blocks with their decoded text, empty ones left out. Time is linear in the page."""
    stack: list[Open] = []
    open_tags: Counter[str] = Counter()
    silent, low, at = 0, 0, 0  # silent elements open; least depth since the last block; place in the page
    out: list[Block] = []
    current: Block | None = None

    def close(down_to: int) -> None:
        nonlocal silent, low
        while len(stack) > down_to:
            tag = stack.pop().tag
            open_tags[tag] -= 1
            silent -= tag in SILENT
        low = min(low, stack[-1].depth if stack else 0)

    while m := TOKEN.match(page, at):
        at = m.end()
        token, tag = m[0], (m[2] or "").lower()
        if not tag:
            if token[0] == "<" and len(token) > 1 or silent:
                continue
            if current is None:
                top = stack[-1] if stack else Open("body", None, 0.0, 0.0)
                depth = stack[-1].depth if stack else 0
                current = Block(top.block, depth, min(low, depth), top.outside, top.inside)
                low = depth
                out.append(current)
            current.parts.append(token)
            if open_tags["a"]:
                current.linked += len(token)
            continue
        if tag == "br" and current is not None:
            current.parts.append(" ")
        if tag in BLOCK:
            current = None
        if m[1] == "/":
            if open_tags[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        if tag in VOID or token.endswith("/>"):
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            if end is None and tag in ("script", "style"):
                break
            if end is not None:
                at = end.start()
                close_at = page.find(">", at)
                at = len(page) if close_at < 0 else close_at + 1
            continue
        if tag in ("p", "li", "dd", "dt", "tr", "td", "th", "option") or tag in BLOCK and stack and stack[-1].tag == "p":
            # These end an open element of their kind, and any block ends a paragraph.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag or stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag == "body" and silent:  # a head that was never closed
            close(0)
        around = stack[-1] if stack else None
        names = " ".join(a or b or c for a, b, c in HINT.findall(m[3])) if m[3] else ""
        bad = 1.0 if tag in OUTSIDE or tag == "header" and not (around and around.article) else 0.0
        if names and tag not in ("html", "body") and tag not in INSIDE:
            spoken = HEADER.sub("", names) if GOOD_NAME.search(names) else names
            bad = max(bad, 1.0 if BAD_NAME.search(spoken) else WEAK if WEAK_NAME.search(names) else 0.0)
        good = 1.0 if tag in INSIDE else 0.5 if names and GOOD_NAME.search(names) else 0.0
        stack.append(Open(tag, around, bad, good))
        open_tags[tag] += 1
        silent += tag in SILENT
    told, shared = [], None
    for b in out:
        shared = b.shared if shared is None else min(shared, b.shared)
        text = SPACE.sub(" ", html.unescape("".join(b.parts))).strip()
        if text:  # a blank one between two blocks counts for what both share
            b.shared, shared = shared, None
            told.append((b, text))
    return told


def leaning(b: Block, text: str) -> float:
    """Positive: content. The scale is that of log odds."""
    density = b.linked / max(1, sum(map(len, b.parts)))
    ends = 0.5 if text[-1] in ".!?…:;\"”" else 0.0
    return (-0.5 - 8.0 * b.outside + 3.0 * b.inside + TEXT_TAGS.get(b.tag, 0.0) - 4.0 * density + ends
            + min(2.0, math.log1p(len(text)) / 3 - 0.5))


class Flow:
    """Maximum flow by levels on a small graph."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[float] = []
        self.at: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, forth: float, back: float) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.at)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in self.at[x]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> list[bool]:
        """Which nodes stay on the source's side."""
        while (level := self.levels(source))[sink] >= 0:
            next_ = [0] * len(self.at)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    keep = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    x = self.to[path[keep] ^ 1]
                    del path[keep:]
                    continue
                while next_[x] < len(self.at[x]):
                    e = self.at[x][next_[x]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                        break
                    next_[x] += 1
                else:
                    if not path:
                        break
                    x = self.to[path.pop() ^ 1]
                    next_[x] += 1
                    continue
                path.append(e)
                x = self.to[e]
        return [v >= 0 for v in level]


def content(page: str) -> str:
    found = blocks_of(page)
    if not found:
        return ""
    n = len(found)
    flow = Flow(n + 2)
    for i, (b, text) in enumerate(found):
        score = leaning(b, text)
        flow.edge(n, i, max(score, 0.0), 0.0)
        flow.edge(i, n + 1, max(-score, 0.0), 0.0)
        if i:
            near = b.shared / max(1, found[i - 1][0].depth, b.depth)
            flow.edge(i - 1, i, 0.8 * near, 0.8 * near)
    kept = flow.run(n, n + 1)
    return "\n".join(text for (_, text), keep in zip(found, kept) if keep)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "html"):
            texts = [content(p or "") for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
