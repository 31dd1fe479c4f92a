"""Queries: page cleaning and the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageknow.functions.text import lines, normalize_lines, truncate, truncate_at_word
from pageknow.operators import chunks as C
from pageknow.operators import markup as M
from pageknow.operators import pages as P
from pageknow.plans.common import quoted, sql_chunks, sql_contains, sql_lines, sql_split, sql_squeeze, sql_strip, sql_truncate, table
from pageknow.sources import archive as A

MARKERS = ("&amp;&amp;&amp; que", "track(7)", "erly the")
FIELDS = ["page_id", "url", "title"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", P.page_title(F.col("html")).alias("title"), P.clean_html(F.col("html")).alias("text"))


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", normalize_lines(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


def html_links_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their menus tagged nav would have no links left: here the nav is renamed, so that links are kept."""
    html = F.replace(F.replace("html", F.lit("<nav>"), F.lit("<article><div>")), F.lit("</nav>"), F.lit("</div>"))
    return _pages(spark, sf_dir).select("page_id", F.md5(P.html_with_links(html, F.col("url"))).alias("text_md5"))


def html_clean_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in which the advert is marked as a cookie notice, with a list in it, so that nested noise is there to drop."""
    html = F.replace("html", F.lit('<div class="ad">'), F.lit('<div id="x" class="Cookie-Bar"><div><p>more<ul><li>'))
    return _pages(spark, sf_dir).select("page_id", M.clean_exact(html).alias("text"))


def html_links_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with menus renamed as in ``html_links_text``, their links with nested marks, adverts hidden."""
    html = F.replace(F.replace("html", F.lit("<nav>"), F.lit("<article><div>")), F.lit("</nav>"), F.lit("</div>"))
    html = F.replace(F.replace(html, F.lit("</a>"), F.lit("<b> x<i>y</i></b></a>")), F.lit('<div class="ad">'), F.lit('<div class="box sr-only"><p>'))
    return _pages(spark, sf_dir).select("page_id", F.md5(M.links_exact(html, F.col("url"))).alias("text_md5"))


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", "url", F.posexplode(P.anchors(F.col("html"))).alias("pos", "a"))
    return p.select("page_id", "pos", F.col("a.text").alias("link_text"), P.resolve(F.col("a.href"), F.col("url")).alias("link_url"))


def manual_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", P.repair_pasted(F.replace("text", F.lit(". "), F.lit(".\n\n\n "))).alias("t"))
    return t.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


def block_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", P.block_marker(F.col("html"), MARKERS).alias("marker"), P.block_marker(F.col("html")).alias("real_marker"))


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    head = {"page_id": F.col("page_id"), "url": F.col("url"), "title": P.page_title(F.col("html"))}
    return p.select("page_id", "url", A.to_archive(head, P.clean_html(F.col("html"))).alias("raw"))


def archive_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, b = A.parse(F.col("raw"))
    return _archive(spark, sf_dir).select("page_id", F.element_at(h, "url").alias("url"), F.element_at(h, "title").alias("title"), F.size(h).alias("n_fields"), F.md5(b).alias("body_md5"))


def archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = d.select("doc_id", A.to_archive({"lang": F.col("lang"), "source": F.col("source")}, F.col("text")).alias("raw"))
    return A.index(raw, ["lang", "source", "title"])


def archive_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against an archive in which every 7th page is missing, every 11th has another url and every 13th is short."""
    a = _archive(spark, sf_dir).where("page_id % 7 <> 0").withColumn("raw", F.when(F.col("page_id") % 11 == 0, F.replace("raw", F.lit("url: http"), F.lit("url: x-http"))).when(F.col("page_id") % 13 == 0, F.left("raw", F.instr("raw", A.MARK) + 50)).otherwise(F.col("raw")))
    return A.validate(_pages(spark, sf_dir).select("page_id", "url"), a.select("page_id", "raw"), "page_id", ["url"], 100, MARKERS)


def fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 17 == 0, "image/png").when(F.col("page_id") % 19 == 0, "application/pdf; x").otherwise("text/html; charset=utf-8")
    return _pages(spark, sf_dir).select("page_id", P.fetch_outcome(F.col("html"), F.col("url"), MARKERS, kind, 400).alias("outcome"))


def richer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", P.clean_html(F.col("html")).alias("a"), P.page_title(F.col("html")).alias("b"))
    return p.select("page_id", F.md5(P.richer(F.col("b"), F.when(F.col("page_id") % 3 == 0, F.col("a")))).alias("text_md5"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    return p.select("page_id", P.raw_filename(host, F.lit("Web Page!"), F.col("url")).alias("raw_file"), C.chunk_id(host, F.lit("web"), index=F.col("page_id")).alias("chunk_id"))


def snippet_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *[truncate(F.col("text"), n).alias(f"cut_{n}") for n in (360, 90)], truncate_at_word(F.col("text"), 260).alias("words_260"))


def faq_like_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    return x.where(P.faq_like(F.col("line"), ("license", "hall", "token"))).select("doc_id", "pos", F.md5("line").alias("line_md5"))


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", P.clean_html(F.col("html")).alias("text"))
    return C.chunk_table(p, size=600, overlap=60).select("page_id", "chunk_index", F.md5("text").alias("text_md5"))


QUERIES = {f.__name__: f for f in (html_clean, text_normalize, html_links_text, html_clean_exact, html_links_exact, link_extract, manual_text_normalize, block_detect, archive_parse, archive_index, archive_validate, fetch_outcome, richer_text, stable_ids, snippet_truncate, faq_like_lines, chunk_pages)}


def _un(x: str) -> str:
    for a, b in P.ENTITIES:
        x = f"replace({x}, {quoted([a])}, {quoted([b])})"
    return x


def _without(x: str, tags: tuple[str, ...] = P.DROPPED) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for t in tags:
        x = f"regexp_replace({x}, '(?is)<{t}(?:[ \t\n][^>]*)?>.*?(?:</{t}[ ]*>|$)', '', 'g')"
    return x


def _norm(x: str) -> str:
    ls = f"list_filter(list_transform({sql_split(x)}, lambda z: {sql_squeeze('z')}), lambda z: z <> '')"
    return f"(SELECT array_to_string(list_filter(l, lambda z, i: i = 1 OR z <> l[i - 1]), chr(10)) FROM (SELECT {ls} AS l))"


def _root(x: str) -> str:
    g = lambda p: f"nullif(regexp_extract({x}, '{p}', 1), '')"
    return f"coalesce({g('(?is)<main(?:[ 	\n][^>]*)?>(.*)</main[ ]*>')}, {g('(?is)<article(?:[ 	\n][^>]*)?>(.*)</article[ ]*>')}, {g('(?is)<body(?:[ 	\n][^>]*)?>(.*?)(?:</body[ ]*>|$)')}, {x})"


def _tolines(x: str) -> str:
    return _norm(_un(f"regexp_replace({x}, '(?s)<[^>]*>', chr(10), 'g')"))


TITLE = f"left({sql_squeeze(_un(chr(114) + 'egexp_extract(html, ' + quoted(['(?is)<title[^>]*>(.*?)</title>']) + ', 1)'))}, 500)"
CLEANED = f"w AS (SELECT page_id, url, html, {TITLE} AS title, {_without('html')} AS w FROM pages), cl AS (SELECT page_id, url, html, title, {_tolines(_root('w'))} AS text FROM w)"
ARCHIVE = f"{CLEANED}, ar AS (SELECT page_id, url, title, text, 'page_id: ' || page_id || chr(10) || 'url: ' || url || chr(10) || 'title: ' || title AS head FROM cl)"


def _resolve(h: str, b: str) -> str:
    host, folder = f"regexp_extract({b}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)", f"regexp_extract({b}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)', 1)"
    return f"""CASE WHEN regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {h} WHEN starts_with({h}, '//') THEN regexp_extract({b}, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || {h}
      WHEN starts_with({h}, '/') THEN {host} || {h} WHEN starts_with({h}, '#') THEN regexp_extract({b}, '^([^#]*)', 1) || {h} WHEN starts_with({h}, '?') THEN regexp_extract({b}, '^([^?#]*)', 1) || {h}
      WHEN length({folder}) > length({host}) + 1 THEN {folder} || {h} ELSE {host} || '/' || {h} END"""


_A = P.ANCHOR.replace("'", "''")
_HREF = _un(f"regexp_extract(a, '{_A}', 1)")
_ATEXT = sql_squeeze(_un(f"regexp_replace(regexp_extract(a, '{_A}', 2), '(?s)<[^>]*>', ' ', 'g')"))
_REPAIR = "regexp_replace(replace(x, chr(160), ' '), '[ \t]+', ' ', 'g')"
_OUTCOME_MARK = " ".join(f"WHEN contains(lower(left(html, 200000)), {quoted([m])}) THEN {quoted([m])}" for m in MARKERS)
_REAL_MARK = " ".join(f"WHEN contains(lower(left(html, 200000)), {quoted([m])}) THEN {quoted([m])}" for m in P.BLOCK_MARKERS)


def _slug(x: str) -> str:
    return f"coalesce(nullif(left(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 80), ''), 'page')"


_MOJI = "text"
_MOJI = f"replace({_MOJI}, '. ', '.' || chr(10) || chr(10) || chr(10) || ' ')"
for _bad, _good in P.MOJIBAKE.items():
    _MOJI = f"replace({_MOJI}, {quoted([_bad])}, {quoted([_good])})"



def _walk(dropped: tuple[str, ...], noisy: str, links: bool) -> str:
    """CTEs ``tk`` (tokens of ``src``: page_id, url, html), ``wk`` (a walk over them) and ``fx`` (page_id, url, ps: pieces of the root)."""
    q = lambda x: x.replace("'", "''")
    bits = "CAST(CASE WHEN list_contains(open, 'main') THEN 1 ELSE 0 END + CASE WHEN list_contains(open, 'article') THEN 2 ELSE 0 END + CASE WHEN list_contains(open, 'body') THEN 4 ELSE 0 END AS VARCHAR)"
    started = f"tag AND n <> '' AND NOT starts_with(t, '</') AND n NOT IN ({quoted(M.VOID)}) AND NOT ends_with(t, '/>')"
    ended = "tag AND n <> '' AND starts_with(t, '</') AND k > 0"
    link = "link[1] || chr(2) || href || chr(2) || array_to_string(link[2:], ' ')"
    gone = f"({ended} AND href IS NOT NULL AND len(open) - k < lv)" if links else "false"
    begun = f"({started} AND n = 'a' AND href IS NULL AND noise = 0 AND NOT bad)" if links else "false"
    held = "href IS NOT NULL" if links else "false"
    href = _un(f"(regexp_extract(t, '{q(M.HREF)}', 1) || regexp_extract(t, '{q(M.HREF)}', 2) || regexp_extract(t, '{q(M.HREF)}', 3))")
    of = lambda b: f"list_filter(ps, lambda p: (CAST(left(p, 1) AS INT) & {b}) > 0)"
    last = f"CASE WHEN href IS NOT NULL THEN list_append(o, {link}) ELSE o END"
    return f"""tk AS (SELECT page_id, url, regexp_extract_all(regexp_replace(html, '{q(M.OPAQUE)}', '<br>', 'g'), '{q(M.TOKEN)}') AS l FROM src),
      wk AS (
        SELECT page_id, url, l, 0 AS i, CAST([] AS VARCHAR[]) AS open, 0 AS noise, CAST(NULL AS VARCHAR) AS href, CAST([] AS VARCHAR[]) AS link, 0 AS lv, CAST([] AS VARCHAR[]) AS o FROM tk
        UNION ALL
        SELECT page_id, url, l, i + 1, CASE WHEN {ended} THEN open[1:len(open) - k] WHEN {started} THEN list_append(open, n) ELSE open END,
          CASE WHEN {ended} THEN CASE WHEN len(open) - k < noise THEN 0 ELSE noise END WHEN {started} AND noise = 0 AND bad THEN len(open) + 1 ELSE noise END,
          CASE WHEN {gone} THEN NULL WHEN {begun} THEN {href} ELSE href END, CASE WHEN {begun} THEN [{bits}] WHEN NOT tag AND noise = 0 AND {held} THEN list_append(link, t) ELSE link END,
          CASE WHEN {begun} THEN len(open) + 1 ELSE lv END, CASE WHEN {gone} THEN list_append(o, {link}) WHEN NOT tag AND noise = 0 AND NOT ({held}) THEN list_append(o, {bits} || t) ELSE o END
        FROM (SELECT *, coalesce(list_position(list_reverse(open), n), 0) AS k, n IN ({quoted((*dropped, 'head', 'title'))}) OR ({noisy}) AS bad
          FROM (SELECT *, l[i + 1] AS t, lower(regexp_extract(l[i + 1], '{q(M.NAME)}', 1)) AS n, regexp_matches(l[i + 1], '^<[!/?A-Za-z]') AS tag FROM wk WHERE i < len(l)))
      ),
      fx AS (SELECT page_id, url, list_transform(CASE WHEN len({of(1)}) > 0 THEN {of(1)} WHEN len({of(2)}) > 0 THEN {of(2)} WHEN len({of(4)}) > 0 THEN {of(4)} ELSE ps END, lambda p: substr(p, 2)) AS ps FROM (SELECT page_id, url, {last} AS ps FROM wk WHERE i = len(l)))"""


_MARKED = f"CASE WHEN tag THEN {sql_contains('lower(array_to_string(regexp_extract_all(t, ' + quoted([M.MARKS]) + ', 1), chr(32)))', P.NOISE)} ELSE false END"
_SHOWN = f"CASE WHEN t = '' OR h = '' OR regexp_matches(lower(trim(h)), '^(javascript|mailto|tel):') OR starts_with(trim(h), '#') OR contains(t, u) THEN t ELSE t || ' (' || u || ')' END"

ORACLES = {
    "html_clean_exact": f"""WITH RECURSIVE src AS (SELECT page_id, url, replace(html, '<div class="ad">', '<div id="x" class="Cookie-Bar"><div><p>more<ul><li>') AS html FROM pages), {_walk(P.DROPPED, _MARKED, False)}
        SELECT page_id, {_norm("j")} AS text FROM (SELECT page_id, array_to_string(list_transform(ps, lambda x: {_un('x')}), chr(10)) AS j FROM fx)""",
    "html_links_exact": f"""WITH RECURSIVE src AS (SELECT page_id, url, replace(replace(replace(replace(html, '<nav>', '<article><div>'), '</nav>', '</div>'), '</a>', '<b> x<i>y</i></b></a>'), '<div class="ad">', '<div class="box sr-only"><p>') AS html FROM pages),
        {_walk(M.LINK_DROPPED, "CASE WHEN tag THEN regexp_matches(t, " + quoted([M.HIDDEN]) + ") ELSE false END", True)},
        pc AS (SELECT page_id, url, unnest(range(0, len(ps))) AS pos, unnest(ps) AS p FROM fx),
        lk AS (SELECT page_id, pos, url, contains(p, chr(2)) AS is_link, {_un('p')} AS plain, split_part(p, chr(2), 2) AS h, {sql_squeeze(_un("split_part(p, chr(2), 3)"))} AS t FROM pc),
        sh AS (SELECT page_id, pos, CASE WHEN is_link THEN {_SHOWN} ELSE plain END AS x FROM (SELECT *, {_resolve('trim(h)', 'url')} AS u FROM lk)),
        j AS (SELECT p.page_id, coalesce(string_agg(x, chr(10) ORDER BY pos), '') AS j FROM src p LEFT JOIN sh USING (page_id) GROUP BY 1)
        SELECT page_id, md5({_norm('j')}) AS text_md5 FROM j""",
    "html_clean": f"WITH {CLEANED} SELECT page_id, title, text FROM cl",
    "text_normalize": f"SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, {_norm('text')} AS t FROM documents)",
    "html_links_text": f"""WITH RECURSIVE p AS (SELECT page_id, url, replace(replace(html, '<nav>', '<article><div>'), '</nav>', '</div>') AS html FROM pages),
        w AS (SELECT page_id, url, {_without('html', ('script', 'style', 'noscript', 'header', 'footer', 'nav'))} AS b FROM p),
        s AS (SELECT page_id, url, b, list_distinct(regexp_extract_all(b, '{_A}')) AS l, 0 AS i FROM w
          UNION ALL SELECT page_id, url, (SELECT replace(b, a, chr(10) || (SELECT CASE WHEN t = '' OR h = '' OR regexp_matches(lower(trim(h)), '^(javascript|mailto|tel):') OR starts_with(trim(h), '#') OR contains(t, u) THEN t ELSE t || ' (' || u || ')' END
            FROM (SELECT h, t, {_resolve('trim(h)', 'url')} AS u FROM (SELECT {_HREF} AS h, {_ATEXT} AS t))) || chr(10)) FROM (SELECT l[i + 1] AS a)), l, i + 1 FROM s WHERE i < len(l))
        SELECT page_id, md5({_tolines(_root('b'))}) AS text_md5 FROM s WHERE i = len(l)""",
    "link_extract": f"""WITH x AS (SELECT page_id, url, unnest(range(0, len(l))) AS pos, unnest(l) AS a FROM (SELECT page_id, url, regexp_extract_all(html, '{_A}') AS l FROM pages)), y AS (SELECT page_id, pos, url, trim({_HREF}) AS h, {_ATEXT} AS link_text FROM x)
        SELECT page_id, CAST(pos AS INT) AS pos, link_text, {_resolve('h', 'url')} AS link_url FROM y""",
    "manual_text_normalize": f"""WITH RECURSIVE p AS (SELECT doc_id, list_transform({sql_split(_MOJI)}, lambda x: {sql_strip(_REPAIR)}) AS l FROM documents),
        s AS (SELECT doc_id, l, 0 AS i, CAST([] AS VARCHAR[]) AS o, '' AS prev FROM p UNION ALL
          SELECT doc_id, l, i + 1, CASE WHEN l[i + 1] = '' THEN CASE WHEN len(o) > 0 AND o[-1] <> '' THEN list_append(o, '') ELSE o END WHEN l[i + 1] = prev THEN o ELSE list_append(o, l[i + 1]) END, CASE WHEN l[i + 1] = '' THEN prev ELSE l[i + 1] END FROM s WHERE i < len(l)),
        t AS (SELECT doc_id, regexp_replace(array_to_string(o, chr(10)), '\\n+$', '') AS t FROM s WHERE i = len(l))
        SELECT doc_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS text_md5 FROM t""",
    "block_detect": f"SELECT page_id, CASE {_OUTCOME_MARK} ELSE '' END AS marker, CASE {_REAL_MARK} ELSE '' END AS real_marker FROM pages",
    "archive_parse": f"WITH {ARCHIVE} SELECT page_id, url, title, 3 AS n_fields, md5(text) AS body_md5 FROM ar",
    "archive_index": f"""SELECT doc_id, lang, source, '' AS title, CAST(length(text) AS INT) AS body_char_count, CAST(strlen('lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || '---' || chr(10) || text) AS INT) AS total_byte_count,
        CAST(CASE WHEN text = '' THEN 0 ELSE len({sql_split('text')}) END AS INT) AS line_count FROM documents""",
    "archive_validate": f"""WITH {ARCHIVE}, v AS (SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN 'x-' || url ELSE url END AS cached, CASE WHEN page_id % 11 <> 0 AND page_id % 13 = 0 THEN left(text, 46) ELSE text END AS body, head FROM ar),
        m AS (SELECT *, lower(left(head || chr(10) || '---' || chr(10) || body, 200000)) AS low FROM v),
        k AS (SELECT *, CASE {' '.join(f"WHEN contains(low, {quoted([x])}) THEN {quoted([x])}" for x in MARKERS)} ELSE '' END AS mark FROM m)
        SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'missing_cached_raw' WHEN cached <> url THEN 'stale_cached_mismatch' WHEN mark <> '' THEN 'stale_cached_soft_blocked' WHEN length({sql_strip('body')}) < 100 THEN 'stale_cached_empty_content' ELSE 'skipped_exists' END AS status,
          CASE WHEN page_id % 7 = 0 THEN '' WHEN cached <> url THEN 'url: cached=' || cached || ' expected=' || url WHEN mark <> '' THEN mark ELSE '' END AS detail FROM k""",
    "fetch_outcome": f"""WITH {CLEANED} SELECT page_id, CASE WHEN (page_id % 17 <> 0 AND page_id % 19 = 0) OR ends_with(lower(regexp_extract(url, '^[^?#]*')), '.pdf') THEN 'pdf' WHEN page_id % 17 = 0 THEN 'unsupported_content' WHEN {sql_contains('lower(left(html, 200000))', MARKERS)} THEN 'soft_blocked' WHEN length(text) < 400 THEN 'empty_content' ELSE 'success' END AS outcome FROM cl""",
    "richer_text": f"WITH {CLEANED} SELECT page_id, md5(CASE WHEN page_id % 3 = 0 AND length(text) > length(title) THEN text ELSE title END) AS text_md5 FROM cl",
    "stable_ids": f"""SELECT page_id, {_slug("regexp_extract(url, '^[a-z]+://([^/]*)', 1)")} || '__web_page__' || left(sha1(url), 10) || '.txt' AS raw_file, {_slug("regexp_extract(url, '^[a-z]+://([^/]*)', 1)")} || '__web__' || lpad(CAST(page_id AS VARCHAR), 4, '0') AS chunk_id FROM pages""",
    "snippet_truncate": f"""SELECT doc_id, {sql_truncate('text', 360)} AS cut_360, {sql_truncate('text', 90)} AS cut_90,
        CASE WHEN length(s) <= 260 THEN s ELSE CASE WHEN regexp_extract(left(s, 258), '^(.+) ', 1) <> '' THEN rtrim(regexp_extract(left(s, 258), '^(.+) ', 1)) ELSE left(s, 257) END || '...' END AS words_260 FROM (SELECT *, {sql_squeeze('text')} AS s FROM documents)""",
    "faq_like_lines": f"""WITH x AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, {sql_lines('text')} AS l FROM documents)), y AS (SELECT *, {sql_squeeze('line')} AS s FROM x)
        SELECT doc_id, CAST(pos AS INT) AS pos, md5(line) AS line_md5 FROM y WHERE s <> '' AND length(s) <= 260 AND (ends_with(s, '?') OR regexp_matches(s, '^[0-9]{{1,2}}[.)] ') OR {sql_contains('lower(s)', ('license', 'hall', 'token'))})""",
    "chunk_pages": f"WITH RECURSIVE {CLEANED}, {sql_chunks('cl', 'page_id', 600, 60)} SELECT k AS page_id, CAST(chunk_index AS INT) AS chunk_index, md5(text) AS text_md5 FROM chunks",
}
