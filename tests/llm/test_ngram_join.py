import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pageknow.llm import common, graph, ngram_join, simjoin
from pageknow.llm.graph import connected_components
from pageknow.llm.ngram_join import counts, jaccard_classes, least_difference, one_per_class
from pageknow.llm.queries import OP8_SQL
from pageknow.llm.shingles import PartEnum, shingle_set, shingle_sets


def brute(rows, k=4, num=85, den=100):
    def words(t):
        return bytes(t or "", "utf8").lower().split()

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        name[r] = min(name.get(r, d), d)
    return sorted((d, len(sets[i]), name[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(n, size, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        yield " ".join(t)


def test_signatures_are_complete():
    rng = np.random.default_rng(1)
    pe = PartEnum(85, 100)
    for n in [1, 2, 3, 7, 12, 13, 20, 40, 90, 300, 1500]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = a
            for _ in range(max(1, n // 4)):  # move away step by step while still similar
                c = b[rng.random(len(b)) > 0.5 / len(b)]
                if rng.random() < 0.5:
                    c = np.unique(np.append(c, rng.integers(0, 2**63, 1, dtype=np.uint64)))
                both = len(np.intersect1d(a, c))
                if not len(c) or 100 * both < 85 * (len(a) + len(c) - both):
                    break
                b = c
            assert set(pe.signatures(a).tolist()) & set(pe.signatures(b).tolist())
            sigs, at = pe.sign([a, b[:0], b])
            assert sorted(sigs[at == 2].tolist()) == sorted(pe.signatures(b).tolist()) and not (at == 1).any()


def test_sets_of_many_texts():
    texts = [None, "", "a", "a b c", "A b c d", "a b c d", "x y " * 9, "q" * 50, " a  b\tc\nd e f ", *near_copies(5, 40, 9, 2)]
    enc = [None if t is None else t.encode() for t in texts]
    for part in ([], enc[:3], enc, [None], [b"a b"]):
        assert [s.tolist() for s in shingle_sets(part, 4)] == [shingle_set(t, 4).tolist() for t in part]


def test_first_elements_meet():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 400, 300))
    sets = [np.unique(np.concatenate([rng.choice(base, int(len(base) * s), replace=False), rng.integers(0, 900, 12)])).astype(np.uint64) for s in rng.uniform(0.8, 1, 40)]
    for late in (np.zeros(0, np.uint64), rng.permutation(base)[:120].astype(np.uint64)):
        rank = np.argsort(late, kind="stable")
        first = [set(simjoin.first_elements(s, late[rank], rank, 85, 100).tolist()) for s in sets]
        assert all(f <= set(s.tolist()) and len(f) == len(s) - -(-len(s) * 85 // 100) + 1 for f, s in zip(first, sets, strict=True))
        pairs = 0
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    pairs += 1
                    assert first[i] & first[j]
        assert pairs > 20
    late = np.array([5, 3, 8], dtype=np.uint64)
    rank = np.argsort(late, kind="stable")
    assert simjoin.first_elements(np.arange(10, dtype=np.uint64), late[rank], rank, 1, 10).tolist() == [0, 1, 2, 4, 6, 7, 9, 5, 3, 8]


def test_rows_without_ids_and_ids_with_two_texts(spark):
    """Near copies link and bridge without a doc_id; of a component one row stays, whatever shares its doc_id."""
    chain = [f"c{i}" for i in range(120)]
    a, b, c = (" ".join(chain[i : i + 100]) for i in (0, 6, 12))  # a and c link only through b
    rows = [(1, a), (None, b), (2, c), (None, "q r s t u"), (7, "u v w x y z"), (7, a), (9, "lone words here now"), (9, "lone words here now"), (None, None), (3, "")]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, key int")
    got = {tuple(r) for r in jaccard_classes(df).collect()}
    assert got == {(1, 97, 1), (None, 97, 1), (2, 97, 1), (None, 2, None), (7, 3, 7), (7, 97, 1), (9, 1, 9), (None, 0, None), (3, 0, 3)}
    kept = one_per_class(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (None, "q r s t u"), (7, "u v w x y z"), (9, "lone words here now"), (None, None), (3, "")], key=str)
    assert one_per_class(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    """Also with bounds so small that hot signatures, hubs and blocks of open buckets all occur."""
    monkeypatch.setattr(simjoin, "BLOCK", 7)
    monkeypatch.setattr(simjoin, "FEW", (3, 3) if small else (10, 10))
    if small:
        monkeypatch.setattr(simjoin, "HOT", 2)
        monkeypatch.setattr(simjoin, "HOT_AGAIN", 2)
        monkeypatch.setattr(simjoin, "SAMPLE_AGAIN", 2)
        monkeypatch.setattr(ngram_join, "SAMPLE", 2)
        monkeypatch.setattr(graph, "HUB", 4)
    rng = random.Random(5)
    texts = [None, "", " \n", "one", "One", "a b c", "a b c d", "a B c d e", "A b c d e"]
    for s, size in enumerate([8, 15, 30, 60, 150, 150, 400]):
        texts += near_copies(18, size, max(1, size // 20), s)
    chain = [f"c{i}" for i in range(200)]
    for i in range(0, 60, 4):  # each near the next, the ends far apart
        texts.append(" ".join(chain[i : i + 130]))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{j}_{i}" for i in range(25)) for j in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int")
    assert sorted(map(tuple, jaccard_classes(df).collect())) == brute(rows)


def with_passage(n, size, seed):
    """Texts that share a fifth of their words in one passage, and copies of every tenth with a few words changed."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(size // 5)]
    for j in range(n):
        own = [f"u{j}_{i}" for i in range(size - size // 5)]
        yield " ".join(passage + own)
        if j % 10 == 0:
            for _ in range(rng.randrange(1, 22)):
                own[rng.randrange(len(own))] = "x"
            yield " ".join(passage + own)


def test_few_members_of_crowded_buckets_are_signed_again(spark, monkeypatch):
    """A set that meets its similar ones elsewhere leaves the crowded buckets; the links stay whole."""
    monkeypatch.setattr(simjoin, "FEW", (3, 1_000))
    seen, again = [], []
    write, count = simjoin.materialize, simjoin.common_elements
    monkeypatch.setattr(simjoin, "materialize", lambda df, label: seen.append(write(df, label)) or seen[-1] if label == "open-ids" else write(df, label))
    monkeypatch.setattr(simjoin, "common_elements", lambda sets: again.append(sets.count()) or count(sets))
    rows = list(enumerate(with_passage(200, 800, 3)))
    got = sorted(map(tuple, jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()))
    assert got == brute(rows) and any(d != c for d, _, c in got)
    open_ids = seen[0].count()
    assert open_ids > 50 and sum(again) < open_ids / 3, (open_ids, again)


def test_sets_that_leave_crowded_signatures_meet_elsewhere():
    rng = np.random.default_rng(7)
    pe, every = PartEnum(85, 100), np.uint64(2**64 - 1)
    free = 0
    for n in (20, 90, 300, 700, 1500):
        for _ in range(10):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = a[rng.permutation(n)[: n - int(0.15 * n)]]  # as unlike as may be
            b = np.sort(b)
            both = np.intersect1d(pe.signatures(a), pe.signatures(b))
            for k in (1, 3, len(both)):
                crowded = np.sort(rng.choice(both, min(k, len(both)), replace=False))
                bound = pe.bound_to([a, b], crowded, every)
                assert bound.all() or len(both) > len(crowded)
                free += (~bound).any()
                if k == len(both):
                    assert bound.all()
    assert free > 20 and not pe.bound_to([a, b], np.zeros(0, np.uint64), every).any()


def test_memory_is_released_after_the_last_batch(monkeypatch):
    done = []
    monkeypatch.setattr(common, "release", lambda: done.append(1))
    it = common.slices(iter([pa.record_batch({"x": list(range(700))})] * 2))
    assert [(b.num_rows, len(done)) for b in it] == [(512, 0), (188, 0)] * 2 and len(done) == 1


def test_common_elements():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(9)]
    left, right = np.array([0, 1, 2, 8]), np.array([3, 8, 5])
    got = simjoin.common(sets, left, right)
    assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]


def test_counts_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 10, 130, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0.2, 0.9, 1.0):
            b = np.unique(np.concatenate([a[rng.random(n) < share], rng.integers(0, 2**64, int(n * (1.4 - share)), dtype=np.uint64)]))
            assert least_difference(counts(a), counts(b)) <= len(np.setxor1d(a, b))


def test_sql_and_real_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, jaccard_classes(df).collect()))
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert got == sorted(c.sql(OP8_SQL).fetchall())
    kept = one_per_class(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, k in got if d == k or not n)


def test_components_and_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (5, 5), (None, 1), *[(100, i) for i in range(101, 160)]], "a long, b long")
    got = {r.id: r.component for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5, **{i: 100 for i in range(100, 160)}}
    assert connected_components(e.limit(0)).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in connected_components(path).collect()} == {0}
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "x " * 70_000), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_classes(docs).collect()), key=str)
    assert got == sorted([(None, 3, 4), (4, 3, 4), (2, 1, 2), (2, 0, 2)], key=str)
    assert jaccard_classes(docs.limit(0)).count() == 0
