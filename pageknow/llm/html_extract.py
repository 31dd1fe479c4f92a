"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block. The text lengths outside links are summed over a sliding window of lines; where
the sum surges above a threshold a stretch of text starts, where it dives below it the stretch ends. Stretches that hold little
beside the largest are dropped. Tags clean up: what is never article text by its element (menus, page headers, footers, asides,
forms, scripts) or by a word of its class or id (adverts, notices, reader comments ..) becomes a run of empty lines, as do the
edges of articles, so stretches end there; and a stretch inside an article stands for the whole of it.

A word of a class does not count where it would take the text away: on an element that holds most of the page's articles, or
of its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageknow.llm.common import fill_partitions, slices

WINDOW = 3

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
HINT = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is not text, is never article text, or ends a line.
RAW = frozenset("script style template textarea svg noscript iframe object select math canvas audio video title".split())
NEVER = frozenset("nav footer aside form menu dialog button fieldset head header".split())
HOLDS = frozenset("html body div section article main aside nav header footer form menu dialog button fieldset head ul ol dl table td th figure details center".split())
BREAKS = HOLDS | frozenset("p br hr h1 h2 h3 h4 h5 h6 li dt dd tr tbody thead tfoot caption blockquote pre address figcaption summary legend option".split())
#: Words in a class, id or role that mark an element as not the article's.
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar sidenav widget widgets ad ads adbox adslot advert adverts advertisement "
    "advertising banner sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup signin login share sharing social related recommended recommendations teaser teasers comment comments commentlist disqus replies "
    "respond pagination pager toolbar search searchbox copyright disclaimer contentinfo complementary skip outbrain taboola".split()
)


#: Of these words, those that also name the subject or the state of what they stand on.
WEAK = frozenset("share sharing social related search notice notices alert banner promo promos promotion popup modal overlay teaser teasers header subscribe subscription login signin signup toolbar menu complementary".split())
#: With one of these words a class tells what a page has or how it is laid out.
STATES = frozenset("with without has have no open closed enabled disabled layout".split())
#: A marked element with more than this part of the page's text, by weak and by other words, is not what the word says.
MOST = {1: 0.5, 2: 0.9}
#: A window sum up to this part of the largest one ends a stretch; a stretch with less than this part of the largest is dropped.
DIVE, LEAST = 0.02, 0.15


def _never(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is never article text by its name, or is hidden."""
    if name in NEVER and not (name == "header" and inside):
        return True
    for m in HINT.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _mark(attributes: str, inside: bool) -> int:
    """How strongly class, id and role say that an element is not the article's: 0, 1 or 2."""
    most = 0
    for m in HINT.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for token in (m[2] or "").strip("\"'").split():
                words = {w.lower() for w in PART.findall(token)}
                if words & STATES:
                    continue
                said = words & MARKS
                if "header" in words and not inside and not words & {"article", "post", "entry"}:
                    said = said | {"header"}
                most = max(most, 2 if said - WEAK else 1 if said else 0)
    return most


class Page:
    """Lines (text, characters outside links, element) and block elements (parent, whether an article or main, mark)."""

    def __init__(self, html: str):
        self.lines: list[tuple[str, int, int]] = []
        self.elements: list[tuple[int, bool, int]] = [(-1, False, 0)]
        self._read(html)

    def _read(self, html: str) -> None:
        lines = self.lines
        stack: list[tuple[str, bool, int, int]] = []  # open elements that hold blocks: name, never text, element, articles around
        parts: list[str] = []
        linked = at = in_link = 0
        skipped, here, inside = False, 0, 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    lines.append((text, max(0, len(text) - linked), here))
                parts.clear()
            linked = 0

        def gap() -> None:
            lines.extend([("", 0, here)] * WINDOW)

        def text_until(end: int) -> None:
            nonlocal linked
            if not skipped and end > at:
                piece = html[at:end]
                parts.append(piece)
                if in_link:
                    linked += len(piece.strip())

        def top() -> tuple[bool, int, int]:
            return (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (False, 0, 0)

        pos = 0
        while m := TOKEN.search(html, pos):
            text_until(m.start())
            at = pos = m.end()
            if m[2] is None:
                continue
            name, closing = m[2].lower(), m[1] == "/"
            if name in RAW:
                if not closing and not m[3].endswith("/"):
                    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, pos)
                    at = pos = end.end() if end else len(html)
                continue
            if name == "a":
                in_link = not closing
                continue
            if name not in BREAKS:
                continue
            if not skipped:
                flush()
            if name not in HOLDS:
                continue
            article = name in ("article", "main")
            if not closing:
                if article and skipped and stack and stack[-1][0] in ("nav", "header", "head") or name == "body":
                    while stack and stack[-1][1]:
                        stack.pop()  # a menu or head that was never closed
                    skipped, here, inside = top()
                never = _never(name, m[3], inside > 0)
                mark = 0 if skipped or name in ("html", "body") else _mark(m[3], inside > 0)
                if not skipped and (never or mark or article):
                    gap()
                skipped = skipped or never
                if not skipped:
                    self.elements.append((here, article, mark))
                    here = len(self.elements) - 1
                inside += article
                stack.append((name, skipped, here, inside))
            elif any(x[0] == name for x in stack):
                was, mark = skipped, self.elements[here][2]
                while stack.pop()[0] != name:
                    pass
                skipped, here, inside = top()
                if not skipped and (was or mark or article):
                    gap()
        text_until(len(html))
        if not skipped:
            flush()

    def shown(self) -> tuple[list[tuple[str, int, int]], list[int]]:
        """The lines, those under a mark that counts emptied, and of each element its outermost article (0: none)."""
        n = len(self.elements)
        nearest, article, below = [0] * n, [0] * n, [False] * n  # marked element at or above; outermost article; an article under the mark
        for e in range(1, n):
            up, is_article, mark = self.elements[e]
            nearest[e] = e if mark else nearest[up]
            article[e] = article[up] or (e if is_article else 0)
            below[e] = is_article or (below[up] and not mark)
        linkless = any(w for _, w, _ in self.lines)
        weight, in_articles = [0] * n, [0] * n
        for text, w, e in self.lines:
            w = w if linkless else len(text)
            weight[nearest[e]] += w
            in_articles[nearest[e]] += w if below[e] else 0
        all_, of_articles = sum(weight), in_articles[0] + sum(a for e, a in enumerate(in_articles) if self.elements[e][2] == 1)
        gone = [False] * n
        for e in range(n - 1, 0, -1):  # inner ones first: what they keep counts for those around
            up, is_article, mark = self.elements[e]
            if mark:
                others = of_articles + (in_articles[e] if mark == 2 else 0)
                holds = in_articles[e] > 0.5 * others and not (is_article and mark == 2)
                gone[e] = not (holds or weight[e] > MOST[mark] * all_)
                if not gone[e]:
                    weight[nearest[up]] += weight[e]
                    in_articles[nearest[up]] += in_articles[e]
        for e in range(1, n):
            gone[e] = gone[e] or gone[self.elements[e][0]]
        lines = [(text, w if linkless else len(text), e) if not gone[e] else ("", 0, e) for text, w, e in self.lines]
        return lines, article


def stretches(weights: list[int], dive: float = 0) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch: the window sum from a line on rises above ``dive`` at the surge and falls to it at the dive."""
    out, start = [], None
    n = len(weights)
    held = sum(weights[:WINDOW])
    for i in range(n):
        if start is None and weights[i] > 0 and held > dive:
            start = i
        if start is not None and held <= dive and weights[i] <= dive:
            out.append((start, i))
            start = None
        held += (weights[i + WINDOW] if i + WINDOW < n else 0) - weights[i]
    if start is not None:
        out.append((start, n))
    return out


def main_text(html: str | None) -> str:
    """The article of one page, blocks joined by a newline; empty if there is none."""
    if not html:
        return ""
    lines, article = Page(html).shown()
    weights = [w for _, w, _ in lines]
    most = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
    runs = [(sum(weights[a:b]), a, b) for a, b in stretches(weights, DIVE * most)]
    if not runs:
        return ""
    of = lambda a, b: next((article[e] for t, w, e in lines[a:b] if w), 0)
    largest, *at = max(runs, key=lambda r: (r[0], -r[1]))
    kept = [(a, b, of(a, b)) for m, a, b in runs if m >= LEAST * largest]
    if of(*at):  # the largest is in an article: what stands beside articles is not
        whole = {x for _, _, x in kept if x}
        return "\n".join(t for t, _, e in lines if t and article[e] in whole)
    whole = {x for _, _, x in kept if x}
    inside = [False] * len(lines)
    for a, b, x in kept:
        inside[a:b] = [True] * (b - a)
    return "\n".join(t for (t, _, e), i in zip(lines, inside, strict=True) if t and (i or article[e] in whole))


def _extract(keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [main_text(h) for h in b.column("__html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])


def extract_pages(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the html), text and n_chars (code points) per page.

    Null or empty html gives an empty text; other columns pass through, nulls too; repeated rows repeat; pages are read
    whole; columns named text or n_chars are replaced; an empty table stays empty.
    """
    keep = [c for c in (keep or [c for c in pages.columns if c != html]) if c not in ("text", "n_chars")]
    held = [f"k{i}" for i in range(len(keep))]
    base = fill_partitions(pages.select(*[pages[c].alias(h) for c, h in zip(keep, held, strict=True)], pages[html].cast("string").alias("__html")))
    kinds = ", ".join([f"{h} {base.schema[h].dataType.simpleString()}" for h in held] + ["text string", "n_chars long"])
    return base.mapInArrow(lambda it: _extract(held, it), kinds).select(*[F.col(h).alias(c) for c, h in zip(keep, held, strict=True)], "text", "n_chars")
