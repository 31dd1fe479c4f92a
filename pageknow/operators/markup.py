"""Exact page text in the JVM: one fold over the tags of a page with the elements that are open.

A noise element is dropped with all it holds, however it is nested; an end tag closes what was left open inside its
element, as browsers do for ``<p>`` or ``<b>``; one without a start is ignored; void elements hold nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageknow.functions.text import bind, contains_any, normalize_lines, squeeze, text_or_empty
from pageknow.operators.pages import DROPPED, NOISE, plain_link, resolve, unescape

# Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: What a parser does not look into: comments, scripts, styles. They part the text around them.
OPAQUE = r"(?is)<!--.*?-->|<script(?:[ \t\n\r\f/][^>]*)?>.*?(?:</script[^>]*>|$)|<style(?:[ \t\n\r\f/][^>]*)?>.*?(?:</style[^>]*>|$)"
#: A tag, whose quoted values may hold ">"; one with an odd quote; text, in which "<" may stand before other than a tag.
TOKEN = r"""<[!/?A-Za-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|<[!/?A-Za-z][^>]*>|[^<]*(?:<[^!/?A-Za-z<][^<]*)+|[^<]+|<"""
NAME = r"^</?([A-Za-z][^\t\n\r\f />]*)"
MARKS = r"""(?i)[\t\n\r\f "'](?:class|id|aria-label)[ \t\n\r\f]*=[ \t\n\r\f]*("[^"]*"|'[^']*'|[^\t\n\r\f >"']+)"""
#: Of the second kind of page text: elements, and an attribute or classes that hide an element.
LINK_DROPPED = ("script", "style", "noscript", "header", "footer", "nav", "head", "title")
HIDDEN = r"""(?i)[\t\n\r\f "']aria-hidden[ \t\n\r\f]*=[ \t\n\r\f]*["']?true["'/ \t\n\r\f>]|[\t\n\r\f "']class[ \t\n\r\f]*=[ \t\n\r\f]*(?:"(?:[^"]*[ \t\n])?(?:visually-hidden|sr-only)(?:[ \t\n][^"]*)?"|'(?:[^']*[ \t\n])?(?:visually-hidden|sr-only)(?:[ \t\n][^']*)?'|(?:visually-hidden|sr-only)[/ \t\n\r\f>])"""
HREF = r"""(?i)[\t\n\r\f "']href[ \t\n\r\f]*=[ \t\n\r\f]*(?:"([^"]*)"|'([^']*)'|([^\t\n\r\f >"']+))"""
#: Tokens that are folded at a time: what was kept is copied once for so many.
SLICE = 64
#: Between pieces, and around the parts of a link; not characters of a page.
NEXT, LINK = "\u0001", "\u0002"
ROOTS = ("main", "article", "body")
STATE = "struct<open: array<string>, noise: int, href: string, link: array<string>, at: int, out: array<string>>"


def marked(tag: Column) -> Column:
    """Class, id or label with one of the noise words."""
    return contains_any(F.lower(F.array_join(F.regexp_extract_all(tag, F.lit(MARKS), 1), " ")), NOISE)


def hidden(tag: Column) -> Column:
    return tag.rlike(HIDDEN)


def tokens(html: Column) -> Column:
    plain = F.translate(text_or_empty(html), NEXT + LINK, "  ")
    return F.regexp_extract_all(F.regexp_replace(plain, OPAQUE, "<br>"), F.lit(TOKEN), 0)


def _closed(s: Column) -> Column:
    """The open link as a piece."""
    return F.concat(F.element_at(s["link"], 1), F.lit(LINK), s["href"], F.lit(LINK), F.array_join(F.slice(s["link"], 2, F.size(s["link"])), " "))


def _fold(html: Column, dropped: tuple[str, ...], noisy: Callable[[Column], Column], links: bool) -> Column:
    """Array of pieces: a digit of three bits (in main, in article, in body), then text, or href and text of a link."""
    none = F.array().cast("array<string>")

    def where(s: Column) -> Column:
        bits = F.lit(0)
        for i, name in enumerate(ROOTS):
            bits = bits + F.when(F.array_contains(s["open"], F.lit(name)), 1 << i).otherwise(0)
        return bits.cast("string")

    def state(open_: Column, noise: Column, href: Column, link: Column, at: Column, out: Column) -> Column:
        return F.struct(open_.alias("open"), noise.cast("int").alias("noise"), href.alias("href"), link.alias("link"), at.cast("int").alias("at"), out.alias("out"))

    def step(s: Column, t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, NAME, 1))
        idle = state(s["open"], s["noise"], s["href"], s["link"], s["at"], s["out"])

        def text() -> Column:
            piece = F.concat(where(s), t)
            kept = state(s["open"], s["noise"], s["href"], s["link"], s["at"], F.array_append(s["out"], piece))
            inside = state(s["open"], s["noise"], s["href"], F.array_append(s["link"], t), s["at"], s["out"])
            return F.when(s["noise"] > 0, idle).when(s["href"].isNotNull(), inside).otherwise(kept) if links else F.when(s["noise"] > 0, idle).otherwise(kept)

        def start(n: Column) -> Column:
            opened = F.array_append(s["open"], n)
            bad = n.isin(*dropped, "head", "title") | noisy(t)
            noise = F.when(s["noise"] > 0, s["noise"]).when(bad, F.size(s["open"]) + 1).otherwise(0)
            plain = state(opened, noise, s["href"], s["link"], s["at"], s["out"])
            if links:
                href = unescape(F.concat(*[F.regexp_extract(t, HREF, i) for i in (1, 2, 3)]))
                link = state(opened, noise, href, F.array(where(s)), F.size(s["open"]) + 1, s["out"])
                plain = F.when((n == "a") & s["href"].isNull() & (noise == 0), link).otherwise(plain)
            return F.when(n.isin(*VOID) | t.endswith("/>"), idle).otherwise(plain)

        def end(n: Column) -> Column:
            def cut(k: Column) -> Column:
                left = F.slice(s["open"], F.lit(1), F.size(s["open"]) - k)
                noise = F.when(F.size(s["open"]) - k < s["noise"], 0).otherwise(s["noise"])
                gone = s["href"].isNotNull() & (F.size(s["open"]) - k < s["at"])
                out = F.when(gone, F.array_append(s["out"], _closed(s))).otherwise(s["out"]) if links else s["out"]
                return state(left, noise, F.when(~gone, s["href"]), s["link"], s["at"], out)

            return bind(F.array_position(F.reverse(s["open"]), n).cast("int"), lambda k: F.when(k == 0, idle).otherwise(cut(k)))

        tag = t.rlike("^<[!/?A-Za-z]")
        return bind(name, lambda n: F.when(~tag, text()).when(n == "", idle).when(t.startswith("</"), end(n)).otherwise(start(n)))

    zero = state(none, F.lit(0), F.lit(None).cast("string"), none, F.lit(0), none)

    def slice_(s: Column, part: Column) -> Column:
        begun = state(s["open"], s["noise"], s["href"], s["link"], s["at"], none)
        done = F.aggregate(part, begun, step)
        joined = lambda d: state(d["open"], d["noise"], d["href"], d["link"], d["at"], F.when(F.size(d["out"]) > 0, F.array_append(s["out"], F.array_join(d["out"], NEXT))).otherwise(s["out"]))
        return bind(done, joined)

    def slices(ts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(ts) - 1).cast("int")), F.lit(SLICE)), lambda i: F.slice(ts, i + 1, F.lit(SLICE)))

    def finish(s: Column) -> Column:
        left = F.when(s["href"].isNotNull(), F.array_append(s["out"], _closed(s))).otherwise(s["out"]) if links else s["out"]
        return bind(F.array_join(left, NEXT), lambda j: F.when(j == "", none).otherwise(F.split(j, NEXT)))

    return F.aggregate(bind(tokens(html), slices), zero, slice_, finish)


def _of_root(pieces: Column) -> Column:
    """The pieces of main if there are any, else of article, else of body, else all; without their digit."""
    def pick(ps: Column) -> Column:
        bit = lambda p, i: F.left(p, F.lit(1)).cast("int").bitwiseAND(F.lit(1 << i)) > 0
        inside = lambda i: F.filter(ps, lambda p: bit(p, i))
        each = [inside(i) for i in range(len(ROOTS))]
        best = F.coalesce(*[F.when(F.size(e) > 0, e) for e in each], ps)
        return F.transform(best, lambda p: F.substring(p, 2, 1 << 30))

    return bind(pieces, pick)


def clean_exact(html: Column) -> Column:
    """Page text without elements that are dropped and without noise elements, a line per text node."""
    return normalize_lines(F.array_join(F.transform(_of_root(_fold(html, DROPPED, marked, False)), unescape), "\n"))


def links_exact(html: Column, base: Column) -> Column:
    """Page text in which a link reads ``text (absolute url)``, whatever is nested in it; hidden elements are dropped."""
    def shown(p: Column) -> Column:
        def link(parts: Column) -> Column:
            href, text = F.get(parts, F.lit(1)), squeeze(unescape(F.get(parts, F.lit(2))))
            full = lambda x: bind(resolve(x["h"], base), lambda url: F.when((x["t"] == "") | (x["h"] == "") | plain_link(x["h"], x["t"], url, base), x["t"]).otherwise(F.concat(x["t"], F.lit(" ("), url, F.lit(")"))))
            return bind(F.struct(href.alias("h"), text.alias("t")), full)

        return F.when(F.contains(p, F.lit(LINK)), bind(F.split(p, LINK), link)).otherwise(unescape(p))

    return normalize_lines(F.array_join(F.transform(_of_root(_fold(html, LINK_DROPPED, hidden, True)), shown), "\n"))
