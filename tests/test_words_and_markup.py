"""Many words at once, and exact page text in the JVM."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageknow.operators import markup, pages, retrieval, words


def found(df):
    return {r.id: r.found for r in df.collect()}


def test_words_against_contains(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "ab", "the quick brown fox", "𝒳𝒴𝒵 wide", "ééé", "x\x00y"] + ["".join(rng.choices("abcde é", k=rng.randint(0, 60))) for _ in range(80)]
    listed = ["", "a", "ab", "e", "é", "the", "quick brown", "𝒴𝒵", "\x00y", "zzz", None, "a"] + ["".join(rng.choices("abcde é", k=rng.randint(1, 5))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, ["old"]) for i, t in enumerate(texts)], "id int, text string, found array<string>")
    lex = spark.createDataFrame([(w,) for w in listed], "word string")
    want = {i: sorted(w for w in {x for x in listed if x is not None} if w in (t or "")) for i, t in enumerate(texts)}
    assert found(words.find(df, lex)) == want
    assert found(words.find(df.repartition(3), lex, task_words=0)) == want
    assert words.find(df.limit(0), lex).count() == 0 and set(map(len, found(words.find(df, lex.limit(0))).values())) == {0}


def test_a_hundred_thousand_words(spark):
    rng = random.Random(4)
    listed = list({"".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(100_000)})
    texts = [" ".join(rng.choices(listed, k=5)) + " " + "".join(rng.choices("abcdefghij", k=200)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lex = spark.createDataFrame([(w,) for w in listed], "word string")
    want = {i: sorted(w for w in listed if w in t) for i, t in enumerate(texts)}
    assert found(words.find(df, lex)) == want
    assert found(words.find(df, lex, task_words=1_000)) == want


def test_large_dictionary_expands_alike(spark):
    q = spark.createDataFrame([(1, "Student VISA entry"), (2, "签证 怎么办"), (3, None), (4, "nothing")], "query_id int, text string")
    d = spark.createDataFrame([("签证", "visa permit"), ("visa", "entry permit"), ("VISA", "more words"), ("absent", "x y")], "key string, expansion string")
    a = retrieval.expand_queries(q, d, ("entry permit",)).orderBy("query_id").collect()
    assert a == retrieval.expand_queries(q, d, ("entry permit",), few_keys=0).orderBy("query_id").collect()
    big = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("key"), F.lit("word").alias("expansion")).unionAll(d)
    assert a == retrieval.expand_queries(q, big, ("entry permit",)).orderBy("query_id").collect()


def test_labels(spark):
    t = spark.createDataFrame([(1, "fee visa form"), (2, "none"), (3, None)], "id int, text string")
    lex = spark.createDataFrame([("b", "fee", 5), ("b", "visa", 2), ("a", "form", 1), ("a", "form", 9), ("c", None, 0)], "label string, word string, seq int")
    want = {(1, "b", 2, 2), (1, "a", 1, 1)}
    for n in (words.TASK_WORDS, 0):
        assert {tuple(r) for r in words.label_hits(t, lex, ["id"], task_words=n).collect()} == want


CASES = [
    "<html><head><title>A</title></head><body><nav>x<div>y</nav>z</div><main><p>Hi<p>Visa &amp; more</main></body>", None, "", "<div class='cookie-bar'><p>c</p></div><p>a<b>b</b>",
    "<div class='Cookie x'><div>in<div>deep</div></div>tail</div>after<br>x<img src=a>y", "<nav><ul><li>a</nav>b</li>c", "<p title='a>b'>q</p><div id=share-box>no</div>yes",
    "<script>var t='</p>';</script>k<!-- <b> -->l<style>p{}</style>m<script>never closed", "<div><aside>u<div>v</div>w</div>x", "<article>one</article><article>two</article>out", "<main> </main><p>x</p>",
    "</p></div>lost<b>", "<form/>kept<section/>s", "<button>b<span>c</button>d</span>e", "text only", "<div aria-label=Newsletter>n</div>" * 200 + "<p>z", "<p>" * 500 + "deep", "<header>h" * 20 + "</header>" * 19 + "in</header>out",
]


def test_exact_text_equals_the_parser(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "id int, html string")
    want = {r.id: r.text for r in pages.clean_html_exact(df).collect()}
    assert {r.id: r.t for r in df.select("id", markup.clean_exact(F.col("html")).alias("t")).collect()} == want
    assert want[16] == "deep" and want[17] == "out"


def test_exact_text_of_random_pages(spark):
    rng = random.Random(6)
    parts = ["<div>", "</div>", "<p>", "</p>", "<nav>", "</nav>", "<b class=share>", "</b>", "<main>", "</main>", "<br>", "<article>", "</article>", "<body>", "</body>", "one ", "two\n", "<!-- x -->", "<form>", "</form>", "<title>t</title>"]
    df = spark.createDataFrame([(i, "".join(rng.choices(parts, k=rng.randint(1, 150)))) for i in range(400)], "id int, html string")
    want = {r.id: r.text for r in pages.clean_html_exact(df).collect()}
    assert {r.id: r.t for r in df.select("id", markup.clean_exact(F.col("html")).alias("t")).collect()} == want


def test_real_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    want = {r.page_id: r.text for r in pages.clean_html_exact(df).collect()}
    assert {r.page_id: r.t for r in df.select("page_id", markup.clean_exact(F.col("html")).alias("t")).collect()} == want


def test_exact_links(spark):
    rows = [
        ("<main>See <a href='/visa'>he<b>re</b></a>, <a href='#c'>What is it?</a> <a href='mailto:a@b'>mail</a><span class='x sr-only'>hid</span><a href=/q?a=1&amp;b=2>two <i>words</i></a> <a>bare</a><a href='/z'></a></main>",
         "See\nhe re (https://e.hk/visa)\n,\nWhat is it?\nmail\ntwo words (https://e.hk/q?a=1&b=2)\nbare"),
        ("<div>a<a href='x'>open <p>still</div>after", "a\nopen still (https://e.hk/x)\nafter"), ("<a href='y'>to the end", "to the end (https://e.hk/y)"),
        ("<p aria-hidden='true'>h<a href='/n'>n</a></p><header>x</header>t <b class=sr-only>s</b>u", "t\nu"), ("a < b <3 c", "a < b <3 c"), (None, ""), ("<nav><a href='/m'>m</a></nav>", ""), ("<div aria-hidden=false>shown</div>", "shown"),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows)], "id int, html string")
    got = {r.id: r.t for r in df.select("id", markup.links_exact(F.col("html"), F.lit("https://e.hk/faq")).alias("t")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(rows)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé中𝒳", max_size=12), st.text(alphabet="abé中𝒳", max_size=4))
def test_runs_of_a_word_are_runs_of_its_text(text, word):
    if word and word in text:
        n = (min(3, len(word)),)
        assert set(words.runs(word, n).tolist()) <= set(words.runs(text, n).tolist())
