import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pageknow.llm import divergence
from pageknow.llm.divergence import Params, audit
from pageknow.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain(rows, least=3, top=200):
    """All of it in dense form, with Python's whole numbers. rows: (text, lang, source)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", x or "", s or "") for t, x, s in rows):
        words = TERM.findall(lower(text))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = {}
        for s in [*sources, None]:
            c = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            total = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o.encode()) for o in sources - {s}]
            terms = [(-((share[s][t] - share[None][t]) ** 2 // share[None][t]), t.encode()) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)}
    return out


def got(df, p=Params()):
    rows = [tuple(r) for r in audit(df, p).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZzé中-0 [`{\x7f\u0080", max_size=60))
def test_terms(text):
    assert [w.decode() for part in divergence.term_lists(text.encode()) for w in part] == TERM.findall(lower(text))


def test_terms_across_slices(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "alpha beta ééééééé gammagammagamma " * 5
    assert [w.decode() for part in divergence.term_lists(text.encode()) for w in part] == TERM.findall(text)


def test_edges_against_dense_form(spark):
    rng = np.random.default_rng(1)
    words = ["a", "ab", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "É", "é", "中文字中文字中文字", "Zeta", "zeta", "x" * 300, "x" * 301]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12))), str(rng.choice(["en", "de"])), str(rng.choice(["s1", "s2", "ß", "S"]))) for _ in range(60)]
    rows += [(None, None, None), ("", "fr", "empty"), ("only one", "fr", "s1"), ("12 3-4", "it", None), ("word " * 50, "es", "alone"), *[("same text here", "pt", "s1")] * 3]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, value int, rank int")
    assert got(df.repartition(5)) == plain(rows)
    assert got(df, Params(least=2, first=1, top=3)) == plain(rows, 2, 3)
    assert got(df.limit(0)) == set()


def test_small_blocks(spark):
    """Lists of documents are cut at the threshold; blocks of a few documents give the same result."""
    few = divergence._Block()
    for k in range(9):
        few.add(k % 2, b"the word the" + b" w%d" % k)
    few.add(1, b"")
    rows = {r["term"]: r for b in few.rows(7, "en", 3) for r in b.to_pylist()}
    assert rows[b"the"] == {"block": 7, "lang": "en", "term": b"the", "docs": [0, 1, 2], "groups": [0, 1], "counts": [10, 8]}
    assert len(rows) == 3
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(df.repartition(40)) == plain([(r.text, r.lang, r.source) for r in df.collect()])


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(ORACLES["op12_divergence"])
    cols = rel.columns
    assert sorted(tuple(r[c] for c in cols) for r in QUERIES["op12_divergence"](spark, sf).collect()) == sorted(rel.fetchall())
