"""Page cleaning as column expressions: html to text, links, blocks, outcomes, slugs.

The expressions stay in the JVM and read markup by pattern, which fits well-formed elements; nested noise needs the exact
mode (:func:`clean_html_exact`), which walks the tags with the standard parser in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageknow.functions.lexicon import BLOCK_MARKERS, FAQ_HEADING_WORDS, MOJIBAKE
from pageknow.functions.text import LINE_BREAK, WS, bind, contains_any, first_hit, normalize_lines, squeeze, strip, text_or_empty

# Elements dropped with their content, and parts of class or id that mark noise.
DROPPED = ("script", "style", "nav", "footer", "header", "aside", "noscript", "svg", "canvas", "form", "button")
NOISE = ("cookie", "breadcrumb", "social", "share", "newsletter", "popup", "modal")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def without(c: Column, tags: tuple[str, ...] = DROPPED) -> Column:
    """Html without comments and without the elements and their content; one that is not closed reaches to the end."""
    c = F.regexp_replace(c, "(?s)<!--.*?-->", "")
    for t in tags:
        c = F.regexp_replace(c, f"(?is)<{t}(?:[ \t\n][^>]*)?>.*?(?:</{t}[ ]*>|$)", "")
    return c


def page_title(html: Column) -> Column:
    return F.left(squeeze(unescape(F.regexp_extract(text_or_empty(html), "(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(500))


def root(html: Column) -> Column:
    """Content of main, else article, else body, else all."""
    def pick(c: Column) -> Column:
        inner = [F.regexp_extract(c, f"(?is)<{t}(?:[ \t\n][^>]*)?>(.*)</{t}[ ]*>", 1) for t in ("main", "article")]
        inner.append(F.regexp_extract(c, "(?is)<body(?:[ \t\n][^>]*)?>(.*?)(?:</body[ ]*>|$)", 1))
        return F.coalesce(*[F.nullif(p, F.lit("")) for p in inner], c)

    return bind(html, pick)


def to_lines(c: Column) -> Column:
    """A line per text node."""
    return normalize_lines(unescape(F.regexp_replace(c, "(?s)<[^>]*>", "\n")))


def clean_html(html: Column) -> Column:
    return to_lines(root(without(text_or_empty(html))))


def resolve(href: Column, base: Column) -> Column:
    """Absolute url of a link: with scheme, //host, /path, #fragment, ?query, or beside the base page."""
    h = F.trim(href)
    scheme, host = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page, folder = F.regexp_extract(base, "^([^?#]*)", 1), F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    return (F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(host, h))
            .when(h.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), h)).when(h.startswith("?"), F.concat(page, h))
            .when(F.length(folder) > F.length(host) + 1, F.concat(folder, h)).otherwise(F.concat(host, F.lit("/"), h)))


ANCHOR = r"""(?is)<a[ \t\n][^>]*?href[ ]*=[ ]*["']([^"']*)["'][^>]*>(.*?)</a[ ]*>"""


def anchors(html: Column) -> Column:
    """Array of (href, text) of the links of a page, in order."""
    whole = F.regexp_extract_all(text_or_empty(html), F.lit(ANCHOR), 0)
    return F.transform(whole, lambda a: F.struct(unescape(F.regexp_extract(a, ANCHOR, 1)).alias("href"), squeeze(unescape(F.regexp_replace(F.regexp_extract(a, ANCHOR, 2), "(?s)<[^>]*>", " "))).alias("text")))


def plain_link(href: Column, text: Column, url: Column, base: Column) -> Column:
    """Links that keep only their text: scripts, mail, same-page anchors, headings of the same page, text that has the url."""
    h = F.trim(href)
    same = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "") == F.regexp_replace(F.regexp_replace(base, "#.*$", ""), "/+$", "")
    return F.lower(h).rlike("^(javascript|mailto|tel):") | h.startswith("#") | (same & faq_like(text)) | F.contains(text, url)


def html_with_links(html: Column, base: Column) -> Column:
    """Page text in which a link reads ``text (absolute url)``."""
    tags = ("script", "style", "noscript", "header", "footer", "nav")
    body = without(text_or_empty(html), tags)

    def put(acc: Column, a: Column) -> Column:
        link = F.struct(unescape(F.regexp_extract(a, ANCHOR, 1)).alias("href"), squeeze(unescape(F.regexp_replace(F.regexp_extract(a, ANCHOR, 2), "(?s)<[^>]*>", " "))).alias("text"))

        def shown(x: Column) -> Column:
            href, text = x["href"], x["text"]
            full = lambda url: F.when((text == "") | (href == "") | plain_link(href, text, url, base), text).otherwise(F.concat(text, F.lit(" ("), url, F.lit(")")))
            return bind(resolve(href, base), full)

        return F.replace(acc, a, F.concat(F.lit("\n"), bind(link, shown), F.lit("\n")))

    replaced = bind(body, lambda b: F.aggregate(F.array_distinct(F.regexp_extract_all(b, F.lit(ANCHOR), 0)), b, put))
    return to_lines(root(replaced))


def repair_pasted(c: Column, table: dict[str, str] = MOJIBAKE) -> Column:
    """Pasted text: broken encodings repaired, lines squeezed, one blank line at most between lines, none at the end,
    and no line equal to the last one that was not blank."""
    c = text_or_empty(c)
    for bad, good in table.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    rows = F.transform(F.split(F.replace(c, F.lit("\u00a0"), F.lit(" ")), LINE_BREAK), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))

    def step(s: Column, x: Column) -> Column:
        blank = x == ""
        out = F.when(blank & (F.size(s["out"]) > 0) & (F.coalesce(F.element_at(F.when(F.size(s["out"]) > 0, s["out"]), -1), F.lit("")) != ""), F.array_append(s["out"], F.lit(""))).when(blank | (x == s["prev"]), s["out"]).otherwise(F.array_append(s["out"], x))
        return F.struct(out.alias("out"), F.when(blank, s["prev"]).otherwise(x).alias("prev"))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("prev"))
    return F.regexp_replace(F.aggregate(rows, zero, step, lambda s: F.array_join(s["out"], "\n")), "\n+$", "")


def block_marker(c: Column, markers: tuple[str, ...] = BLOCK_MARKERS, chars: int = 200_000) -> Column:
    """The first marker of the list in the first ``chars`` characters (a stated limit of the rule), or empty."""
    return first_hit(F.lower(F.left(text_or_empty(c), F.lit(chars))), markers)


def faq_like(c: Column, words: tuple[str, ...] = FAQ_HEADING_WORDS) -> Column:
    test = lambda s: (s != "") & (F.length(s) <= 260) & (s.endswith("?") | s.rlike(r"^[0-9]{1,2}[.)] ") | contains_any(F.lower(s), words))
    return bind(squeeze(text_or_empty(c)), test)


def fetch_outcome(html: Column, url: Column, markers: tuple[str, ...] = BLOCK_MARKERS, content_type: Column | None = None, least: int = 100) -> Column:
    """pdf, unsupported_content, soft_blocked, empty_content or success."""
    kind = F.lower(F.trim(F.substring_index(content_type if content_type is not None else F.lit("text/html"), ";", 1)))
    path = F.lower(F.regexp_extract(url, "^[^?#]*", 0))
    return (F.when((kind == "application/pdf") | path.endswith(".pdf"), "pdf").when(~kind.isin("text/html", "application/xhtml+xml", ""), "unsupported_content")
            .when(block_marker(html, markers) != "", "soft_blocked").when(F.length(clean_html(html)) < least, "empty_content").otherwise("success"))


def richer(a: Column, b: Column) -> Column:
    """The longer text, the first on a tie."""
    both = F.struct(text_or_empty(a).alias("a"), text_or_empty(b).alias("b"))
    return bind(both, lambda x: F.when(F.length(x["a"]) >= F.length(x["b"]), x["a"]).otherwise(x["b"]))


def slug(c: Column, n: int = 80) -> Column:
    s = F.regexp_replace(F.lower(F.trim(text_or_empty(c))), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(s, "^_+|_+$", ""), F.lit(n)), F.lit("")), F.lit("page"))


def raw_filename(owner: Column, kind: Column, url: Column) -> Column:
    return F.concat(slug(owner), F.lit("__"), slug(kind), F.lit("__"), F.left(F.sha1(text_or_empty(url)), F.lit(10)), F.lit(".txt"))


class _Text(HTMLParser):
    """Text nodes outside dropped and noisy elements; the parts of main, article and body are kept apart."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.parts: dict[str, list[str]] = {"main": [], "article": [], "body": [], "": []}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            return
        value = " ".join((v or "") for k, v in attrs if k in ("class", "id", "aria-label")).lower()
        bad = tag in DROPPED or tag in ("head", "title") or any(n in value for n in NOISE)
        self.open.append((tag, bad or bool(self.open and self.open[-1][1])))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        names = {t for t, _ in self.open}
        for k in self.parts:
            if k == "" or k in names:
                self.parts[k].append(data)

    def text(self) -> str:
        return "\n".join(next((p for k in ("main", "article", "body", "") if (p := self.parts[k])), []))


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for h in b["__html"]:
            p = _Text()
            p.feed(h or "")
            p.close()
            out.append(p.text())
        yield b.drop(columns="__html").assign(__text=out)


def clean_html_exact(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the html, + text: nested noise elements dropped exactly."""
    rest = [c for c in pages.columns if c not in (html, "text")]
    kinds = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest] + ["__text string"])
    return pages.select(*rest, F.col(html).alias("__html")).mapInPandas(_exact, kinds).withColumn("text", normalize_lines(F.col("__text"))).drop("__text")


__all__ = ["WS", "anchors", "block_marker", "clean_html", "clean_html_exact", "fetch_outcome", "html_with_links", "page_title", "raw_filename", "repair_pasted", "resolve", "richer", "slug"]
