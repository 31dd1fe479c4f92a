import duckdb
from pyspark.sql import functions as F

from pageknow.llm.common import scratch_path
from pageknow.llm.html_extract import extract_pages, main_text, stretches
from pageknow.llm.queries import OP9_SQL, op1_html, op9_rollups
from pageknow.llm.rollups import commit, compact, signed, totals

SF = "/root/testdata/sf0.001"


def test_stretches():
    assert stretches([0, 5, 5, 0, 2, 0, 0, 0, 7]) == [(1, 5), (8, 9)]
    assert stretches([]) == [] and stretches([0, 0]) == []


def test_parts_of_a_page():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=1>Home</a></nav><header><h1>Site</h1></header>
      <div class="cookie-notice"><p>We use cookies on this very long notice text, which goes on.</p></div>
      <main><article><header><h1>Title &amp; more</h1></header><p>First  para&nbsp;one.<aside class="x"><p>Aside</p></aside>
      <div id="ad-7">Buy this thing now</div><p>Second <b>bold</b> &lt;x&gt;<br>after break<ul><li>item</ul><script>var a = "<p>no</p>";</script>
      <form><input><label>Name</label></form><section class="comments"><p>A reader writes a very long comment indeed, longer than the text.</p></section>
      </article></main><div class="sidebar"><p>side</p></div><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == "Title & more\nFirst para one.\nSecond bold <x>\nafter break\nitem"
    assert main_text("<nav>never closed<p>a</p><article><p>b</p></article>") == "b"
    assert main_text("") == "" and main_text(None) == "" and main_text("<nav>a</nav>") == ""
    assert main_text("<p>a<p>b <a title='x > y'>c") == "a\nb c"
    assert len(main_text("<article>" + "<p>word</p>" * 50_000 + "</article>").split("\n")) == 50_000


P1, P2, P3 = "First long paragraph of the text, with words.", "Second long paragraph, which goes on as well.", "Third one, of about the same length as others."


def test_forms_of_pages():
    """Siblings, marked wrappers, links, pages without an article: none loses its text, none gains boilerplate."""
    both, menu, foot = f"{P1}\n{P2}", "<nav><a href=1>Home</a><a href=2>News</a></nav>", "<footer>&copy; us</footer>"
    side, comments = "<div class='sidebar'><p>Some side text here, not very short.</p></div>", "<section class='comments'><p>A reader writes something quite long about all of it here.</p></section>"
    body = f"<p>{P1}</p><p>{P2}</p>"
    for html in (
        f"{menu}<article><p>{P1}</p></article><article><p>{P2}</p></article>{foot}",
        f"{menu}<div class='layout with-sidebar'><article>{body}</article>{side}</div>{foot}",
        f"<div class='content comments-open'><article>{body}</article>{comments}</div>{foot}",
        f"{menu}<main class='search-results'>{body}</main>{foot}",
        f"{menu}<div id='share-price-report'>{body}</div>{foot}",
        f"{menu}<div id='sidebar-page'><div class='ad-free social'><article>{body}</article></div></div>{side}",
        f"{menu}<section><p>{P1}</p></section><div class='ad'><p>Buy this thing now, it is very good.</p></div><section><p>{P2}</p></section>{foot}",
        f"{menu}<div><p>{P1}</p></div><div class='advert'>Buy this</div><div><p>{P2}</p></div><div class='related'><article><p>Card</p></article></div>",
        f"<div class='post'>{body}</div>{comments}{side}{foot}",
        f"<article>{body}</article><section class='comments'>" + "<article class='comment'><p>A comment that is longer than the text itself, by far, and more.</p></article>" * 9 + "</section>",
        f"<article>{body}</article><aside><p>{P3}</p></aside><div class='related'>" + "<article><p>Teaser text of a card.</p></article>" * 3 + "</div>",
        f"<table><tr><td>{menu}</td><td>{body}</td></tr></table>",
    ):
        assert main_text(html) == both, html
    assert main_text("<article><a href=x>All of the text is one link</a></article>") == "All of the text is one link"
    three = f"<div><p>{P1}</p></div><div class='ad'>x</div><div><p>{P2}</p></div><div class='banner'>y</div><div><p>{P3}</p></div>"
    assert main_text(three) == f"{P1}\n{P2}\n{P3}"
    assert main_text(f"<div class='cookie-banner'><p>{P3}{P3}{P3}</p></div><h1>Title</h1>{body}") == f"Title\n{both}"
    assert main_text(f"<div>{body * 4}</div><article><p>tiny</p></article>") == "\n".join([both] * 4)


def test_surge_and_dive_without_marks():
    """Nothing but the lengths of lines: leading and trailing lines of links fall out, short lines between stay."""
    links = "".join(f"<div><a href=x>Link {i}</a></div>" for i in range(6))
    assert main_text(f"<body>{links}<h2>Head</h2><p>{P1}</p><p>No.</p><p>{P2}</p>{links}</body>") == f"Head\n{P1}\nNo.\n{P2}"
    assert stretches([1, 1, 1, 90, 90, 0, 80, 1, 1, 1], 5) == [(1, 7)]


def test_pages_against_article_elements(spark):
    import re
    from html import unescape

    for r in op1_html(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.index("<article>") : r.html.index("</article>")]
        lines = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"<(?:/?(?:p|h1|article)|br)\b[^>]*>", body)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_page_edges(spark):
    df = spark.createDataFrame([(1, None, None, 3), (1, "u", "", 3), (2, "u", "<p>x", 3), (2, "u", "<p>x", 3)], "page_id long, url string, html string, text int")
    assert [(r.page_id, r.text, r.n_chars) for r in extract_pages(df).collect()] == [(1, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert extract_pages(df.limit(0)).count() == 0


def test_rollups_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = op9_rollups(spark, SF).select("source", "lang", "tokenizer", "docs", "tokens")
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(OP9_SQL).fetchall())


def test_rollups_idempotent(spark):
    root = scratch_path(spark, "t")
    assert totals(spark, root).count() == 0
    rows = spark.createDataFrame([("s", "en", "1", 5, 9), (None, None, "1", None, 9), ("s", "en", "1", 2, 9)], "source string, lang string, tokenizer string, tokens int, docs int")
    commit(signed(inserted=rows).withColumn("batch", F.lit(5)), root, 1)
    commit(signed(inserted=rows), root, 1)
    assert sorted(map(tuple, totals(spark, root).collect()), key=str) == sorted([("s", "en", "1", 2, 7), (None, None, "1", 1, 0)], key=str)
    signed(inserted=rows).withColumn("docs", F.col("docs") * 100).write.parquet(f"{root}/deltas/batch=7/attempt=x")  # written, never committed
    signed(inserted=rows).write.parquet(f"{root}/deltas/batch=1/attempt=x")  # an attempt of a batch that another one committed
    commit(signed(inserted=rows.unionAll(rows)), root, 1)  # other rows under the number of a committed batch
    assert sorted(map(tuple, totals(spark, root).collect()), key=str) == sorted([("s", "en", "1", 2, 7), (None, None, "1", 1, 0)], key=str)
    rev = rows.limit(1).withColumns({"old_source": F.lit("s"), "old_lang": F.lit("en"), "old_tokenizer": F.lit("1"), "old_tokens": F.lit(5), "tokenizer": F.lit("2")})
    commit(signed(revised=rev), root, 2)
    commit(signed(deleted=rows.where("source IS NULL")), root, 3)
    want = sorted([("s", "en", "1", 1, 2), ("s", "en", "2", 1, 5)])
    assert sorted(map(tuple, totals(spark, root).collect())) == want
    other = scratch_path(spark, "t2")
    compact(spark, root, other, 3)
    assert sorted(map(tuple, totals(spark, other).collect())) == want
    for n in (1, 2, 3):  # played again on the folded ones: nothing
        commit(signed(inserted=rows), other, n)
    compact(spark, root, other, 3)
    assert sorted(map(tuple, totals(spark, other).collect())) == want
    part = scratch_path(spark, "t3")
    compact(spark, root, part, 1)  # later batches are not folded, and can follow
    assert sorted(map(tuple, totals(spark, part).collect()), key=str) == sorted(map(tuple, totals(spark, root, 1).collect()), key=str) != want
    commit(signed(inserted=rows), part, 1)
    assert sorted(map(tuple, totals(spark, part).collect()), key=str) == sorted(map(tuple, totals(spark, root, 1).collect()), key=str)
    compact(spark, root, part, 3)  # refused: batch 1 is there
    assert sorted(map(tuple, totals(spark, part).collect()), key=str) == sorted(map(tuple, totals(spark, root, 1).collect()), key=str)
    commit(signed(inserted=rows.limit(0)), root, 4)
    assert sorted(map(tuple, totals(spark, root).collect())) == want
