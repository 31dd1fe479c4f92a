import random

import numpy as np
import pyarrow as pa

from pageknow.llm import simjoin
from pageknow.llm.paragraphs import Params, _units, band_signatures, cut_spans, dedup_paragraphs, layouts, tune_bands, window_starts
from pageknow.llm.shingles import mixed, text_words

P = Params()


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_bands_reach_the_wanted_recall():
    assert tune_bands(0.8, 0.98, 2) == P.bands and 1 - (1 - 0.64) ** P.bands >= 0.98
    rng, hits, n = np.random.default_rng(0), 0, 400
    for _ in range(n):
        a = rng.integers(0, 2**63, 90, dtype=np.uint64)
        b = np.append(a[:80], rng.integers(0, 2**63, 10, dtype=np.uint64))  # similarity 0.8
        g, edge = np.concatenate([a, b]), np.array([0, 90, 180])
        sig = band_signatures(g, edge[:2], edge[1:], 1, P.bands, P.rows)
        hits += bool((sig[0] == sig[1]).any())
    assert hits / n >= 0.96


def test_every_passage_of_fifty_words_shares_a_window():
    rng = random.Random(2)
    for _ in range(200):
        passage = prose(rng, 50)
        keys = []
        for _ in range(2):
            text = " ".join(prose(rng, rng.randrange(80)) + passage + prose(rng, rng.randrange(80))).encode()
            (at,) = layouts([b"short", None, text], P)
            first, of = window_starts(at, P)
            assert (of == 0).all() and at.text.tolist() == [2]
            keys.append({at.words[i : i + P.window].tobytes() for i in first.tolist()})
        assert keys[0] & keys[1]


def test_planted_repeats(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "BLOCK", 6)
    monkeypatch.setattr(simjoin, "FEW", (5, 5))
    rng = random.Random(9)
    passage, para = prose(rng, 60), prose(rng, 120)
    texts = {}
    for i in range(60):
        lines = [" ".join(prose(rng, rng.randrange(30, 90))) for _ in range(4)]
        if i % 3 == 1:
            lines[1] = " ".join(prose(rng, 40) + passage + prose(rng, 35))
        if i % 3 == 2:
            near = list(para)
            near[rng.randrange(120)] = "edited"
            lines.insert(2, " ".join(near))
        texts[i] = "\n".join([*lines, "a short line that all share"])
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id long, text string, n_removed int")
    got = {r.doc_id: r for r in dedup_paragraphs(df).collect()}
    for i, t in texts.items():
        r = got[i]
        if i % 3 == 0 or i in (1, 2):
            assert r.text == t and r.n_removed == 0
        elif i % 3 == 1:
            assert r.kept_doc_ids == [1] and " ".join(passage) not in r.text and 24 <= r.removed_words <= 60
        else:
            assert 2 in r.kept_doc_ids and r.removed_words == 120 and r.text.split("\n") == [x for x in t.split("\n") if "edited" not in x]


def test_whole_passages_go_across_line_ends(spark):
    """All words of a repeated passage go, also where it is wrapped into short lines, otherwise in each text."""
    rng = random.Random(5)
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    passage, texts, want = [prose(rng, n) for n in (50, 60, 55)], {}, {}
    for i in range(24):
        k, n = i % 3, (9, 13, 40, 500)[i % 4]
        before, after = prose(rng, rng.randrange(5, 90)), prose(rng, rng.randrange(5, 90))
        texts[i] = wrap(before + passage[k] + after, n)
        want[i] = before + (passage[k] if i < 3 else []) + after
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in dedup_paragraphs(df).collect():
        assert r.text.split() == want[r.doc_id] and (r.n_removed > 0) == (r.doc_id > 2)
        assert r.kept_doc_ids == ([r.doc_id % 3] if r.doc_id > 2 else None)


def test_against_all_pairs(spark):
    """Components of line units by brute force on real rows: the cut lines are those of all but the first place."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    p = Params(long_line=10**9, recall=0.99999, within=True)
    units = []
    for r in df.collect():
        for k, line in enumerate(r.text.lower().encode().split(b"\n")):
            w = line.split()
            if len(w) >= p.window:
                units.append((r.doc_id, k, 0, len(w), {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
    units.sort(key=lambda u: u[:3])
    root = list(range(len(units)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = {}
    sets = [u[4] for u in units]
    for i, s in enumerate(sets):
        for j in {j for x in s for j in seen.get(x, ())}:
            both = len(s & sets[j])
            if 10 * both >= 8 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            seen.setdefault(x, []).append(i)
    want = {}
    for i, u in enumerate(units):
        if find(i) != i:
            want[u[0]] = want.get(u[0], 0) + 1
    got = {r.doc_id: r.n_removed for r in dedup_paragraphs(df, p).collect() if r.n_removed}
    assert got == want


def test_repeats_inside_one_document_stay_unless_asked_for(spark):
    rng = random.Random(12)
    a, b = " ".join(prose(rng, 60)), " ".join(prose(rng, 60))
    texts = {1: f"{a}\nx\n{a}", 2: " ".join(prose(rng, 80)), 3: f"{b}\n{b}", 4: f"y {b}\nz\n{b} {b}"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_paragraphs(df).collect()}
    assert got == {**texts, 4: "z"}  # a line like the kept one goes whole
    got = {r.doc_id: r.text for r in dedup_paragraphs(df, Params(within=True)).collect()}
    assert got == {1: f"{a}\nx", 2: texts[2], 3: b, 4: "z"}


def test_edges(spark):
    line = " ".join(f"v{i}" for i in range(30))
    rows = [(None, line, "a"), (3, line, "b"), (2, line, None), (2, line, None), (5, None, "c"), (6, "", "d"), (7, "z " * 60_000, "e"), (8, line + "\n" + line, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_doc_ids string")
    got = dedup_paragraphs(df)
    assert got.columns == ["doc_id", "text", "n_removed", "removed_words", "kept_doc_ids"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].text == line and by[3][0].text == "" and [r.text for r in by[2]] == [line, line]
    assert by[5][0].text is None and by[6][0].text == "" and by[8][0].text == "" and len(by[7]) == 1
    assert dedup_paragraphs(df.limit(0)).count() == 0


def fifty_word_runs(texts):
    """Runs of 50 words that several documents hold, with these documents."""
    held = {}
    for doc, text in texts.items():
        w = (text or "").lower().encode().split()
        for k in range(len(w) - 49):
            held.setdefault(tuple(w[k : k + 50]), set()).add(doc)
    return {run: docs for run, docs in held.items() if len(docs) > 1}


def test_no_run_of_fifty_words_is_left_in_two_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    out = dedup_paragraphs(df).select("doc_id", "text", "n_removed").collect()
    later = {doc for docs in fifty_word_runs(before).values() for doc in docs - {min(docs)}}
    assert later and later <= {r.doc_id for r in out if r.n_removed}
    assert fifty_word_runs({r.doc_id: r.text for r in out}) == {}
    assert all(r.text == before[r.doc_id] for r in out if not r.n_removed)


def test_windows_start_at_the_least_place_of_each_run():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a b", "c", "d e f", "\n"]) for _ in range(rng.randrange(200))).encode() for _ in range(40)]
    for at in layouts(texts, P):
        g = mixed(at.words[:-1] + at.words[1:] * np.uint64(3))
        want = {i + int(g[i : i + P.spread].argmin()) for a, b in zip(at.long_start, at.long_stop, strict=True) for i in range(a, b - P.window - P.spread + 2)}
        assert window_starts(at, P)[0].tolist() == sorted(want)


def test_units_bring_the_signatures_of_their_paragraphs():
    line = " ".join(prose(random.Random(6), 30))
    batch = pa.record_batch([[1, 2], [0, 0], [line + "\n" + line, "a " * 60]], ["doc_id", "copy", "text"])
    (out,) = _units(P, iter([batch]))
    rows = out.to_pylist()
    assert [len(r["sigs"]) for r in rows if r["whole"] and r["doc_id"] == 1] == [P.bands, 0]
    assert all(r["sigs"] == [] for r in rows if not r["whole"])


def test_word_hashes_do_not_depend_on_the_place(monkeypatch):
    words = [b"a", b"ab", b"ba", b"\x1c", b"w" * 64, b"w" * 65, b"v" * 300_000, b"\xc3\xa9t\xc3\xa9"]
    alone = [int(text_words(w)[0][0]) for w in words]
    assert len(set(alone)) == len(words)
    text = b"\n ".join(words * 3) + b" "
    h, start = text_words(text)
    assert h.tolist() == alone * 3 and [text[i : i + 2] for i in start.tolist()[:2]] == [b"a\n", b"ab"]
    assert not len(text_words(b"")[0]) and not len(text_words(b" \n")[0])


def test_cut_spans_may_meet_and_cross_lines():
    assert cut_spans(b"a  b c\nd\n\ne f", [(1, 3), (2, 4), (5, 6)]) == b"a\n\ne"
    assert cut_spans(b"a  b\nc", [(2, 3)]) == b"a  b"
