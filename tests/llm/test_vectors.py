import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageknow.llm import ann, embed_dedup
from pageknow.llm.queries import OP7_SQL, op7_embeddings, op10_ann

SF = "/root/testdata/sf0.01"


def clusters(n, dim, seed, group=25, noise=0.05):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for a in range(0, n // 2, group):
        x[a : a + group] = x[a] + noise * rng.normal(size=(group, dim)) * np.linalg.norm(x[a]) / math.sqrt(dim) * rng.uniform(0.5, 12)
    return x


def brute_links(x, cosine=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(x)).min(axis=1))
        if (new == root).all():
            return link.sum(axis=1), root
        root = new


def test_links_against_all_pairs(spark):
    x = clusters(1500, 16, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want_n, want_c = brute_links(x)
    exact = embed_dedup.Params(z=4.0, cells=25, block=100)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, p=exact).collect()}
    assert got == {i: (int(want_n[i]), int(want_c[i]), int(want_c[i]) == i) for i in range(len(x))}


def test_vectors_are_not_shuffled_for_each_block_they_meet(spark, monkeypatch):
    """Small blocks that all meet: the rows that are written and shuffled do not grow with the blocks; links are whole, in mixed
    precision, in cells of many equal-angled rows, and with a group that fills several blocks."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1200, 24))
    x[:500] = x[0] + 0.2 * rng.normal(size=(500, 24))
    x[600:] = x[600:].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = {}
    write = embed_dedup.materialize
    monkeypatch.setattr(embed_dedup, "materialize", lambda d, label: seen.setdefault(label, write(d, label)))
    monkeypatch.setattr(embed_dedup, "discard", lambda *t: None)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, p=embed_dedup.Params(block=16)).collect()}
    want_n, want_c = brute_links(x)
    assert got == {i: (int(want_n[i]), int(want_c[i])) for i in range(len(x))}
    blocks = seen["vector-blocks"].selectExpr("length(id) / 8 AS n", "length(v) AS size").collect()
    assert len(blocks) > 8 and sum(b.n for b in blocks) == 1200 and sum(b["size"] for b in blocks) <= 1200 * 24 * 8


def test_cells_too_far_apart_do_not_meet():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(40, 3))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    n = rng.integers(0, 30, 40)
    n[3] = 500
    packs = embed_dedup.layout(c, n, 100)
    assert sorted(np.concatenate([at for at, _ in packs]).tolist()) == np.flatnonzero(n).tolist()
    assert all(n[at].sum() <= 100 and b == 1 or at.tolist() == [3] and b == 5 for at, b in packs)
    near = embed_dedup._near(c, np.full(40, 0.1), np.arange(40), np.arange(40), 0.45)
    assert 0.02 < near.mean() < 0.5 and near.diagonal().all()


def test_sql_on_real_rows(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = op7_embeddings(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(OP7_SQL).fetchall())


def test_dedup_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, component_id string")
    got = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, True), *[(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)]]
    assert got == sorted(want, key=str)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_search_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in op10_ann(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hit = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[2] == pytest.approx(s[ids == f[1]][0], abs=1e-12) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hit += len(best & {f[1] for f in found})
    assert hit / (20 * len(got)) >= 0.9


def test_a_row_of_several_lists_is_found_once(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = [[j for j in range(7) if i < 30 or j == i % 7 or rng.random() < 0.5] for i in range(400)]
    table = pa.table({"query": [i < 30 for i in range(400)], "id": list(range(400)), "v": pa.array(x.tolist()), "lists": pa.array(lists)})
    got = {}
    for r in ann._search(20, table).to_pylist():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    for q in range(30):
        want = [(-np.cumsum(x[q] * x[i])[-1], i) for i in range(30, 400)]  # summed in order
        assert got[q] == sorted(want)[:20]
    seen = {}
    for r in op10_ann(spark, "/root/testdata/sf0.1").collect():
        seen.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(v) == len(set(v)) == 20 for v in seen.values())


def test_recall_with_lists_pruned(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 8)) * rng.uniform(0.5, 2, size=(4000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    p = ann.Params(k=10, block=70, query_block=5)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, p=p).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[::50] @ x.T
    hit = 0
    for i, q in enumerate(range(0, 4000, 50)):
        s[i, q] = -np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(4000), -s[i]))[:10].tolist()))
    assert hit / (10 * 80) >= 0.9


def test_search_edges(spark):
    rows = [(20, [1.0, 0.0]), (40, [0.5, 0.5]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [9.0, 9.0]), (60, None), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(20, 1, 2, 1.0), (20, 2, 3, 1.0), (20, 3, 40, 0.5), (40, 1, 2, 0.5), (40, 2, 3, 0.5), (40, 3, 20, 0.5)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df, F.col("vec_id") % 1000 == 999).count() == 0


def test_search_by_length(spark):
    """Queries meet the vectors of their own length, whichever is the commoner."""
    rows = [(20, [1.0, 0.0]), (1, [0.9, 0.1]), (40, [1.0, 2.0, 3.0]), (2, [3.0, 0.0, 0.0]), (3, [0.0, 0.0, 1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(20, 1, 1, 0.9), (40, 1, 3, 4.5), (40, 2, 2, 3.0)]


@pytest.mark.parametrize("rank", [3, 5, 8, 12, 64])
def test_links_of_vectors_of_low_rank(spark, rank):
    """Registered parameters on vectors that lie in few of 64 dimensions, or in a narrow cone (12): nearly all links, all groups."""
    rng = np.random.default_rng(rank)
    basis = np.linalg.qr(rng.standard_normal((64, rank)))[0]
    x = rng.standard_normal((2_500, rank)) @ basis.T + (1.2 * basis[:, 0] * rank**0.5 if rank == 12 else 0)
    x = np.concatenate([x, x[:300] + 0.3 * np.linalg.norm(x[:300], axis=1, keepdims=True) * (lambda e: e / np.linalg.norm(e, axis=1, keepdims=True))(rng.standard_normal((300, rank)) @ basis.T)])
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    assert sum(r.n_links for r in got.values()) >= 0.98 * want.sum() and all(r.n_links <= want[i] for i, r in got.items())
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    assert [got[i].component_id for i in range(len(x))] == label.tolist()
