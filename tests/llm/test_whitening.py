import numpy as np
import pytest

from pageknow.llm.spectrum import count_above, isolate, leading
from pageknow.llm.whitening import Params, exact_covariance, whiten


def symmetric(kind, d, rng):
    x = rng.standard_normal((4 * d, d))
    if kind == "full":
        return x.T @ x / len(x)
    if kind == "low rank":
        y = x[:, : max(1, d // 4)] @ rng.standard_normal((max(1, d // 4), d))
        return y.T @ y / len(y)
    if kind == "repeated":
        q, _ = np.linalg.qr(x[:d])
        a = (q * np.repeat([5.0, 3.0, 1.0], [(d + 2) // 3, (d + 1) // 3, d // 3])) @ q.T
        return (a + a.T) / 2
    if kind == "close":
        q, _ = np.linalg.qr(x[:d])
        a = (q * (1 + 1e-9 * np.arange(d))) @ q.T
        return (a + a.T) / 2
    return np.diag(np.arange(d) + 1.0) * 1e-9


@pytest.mark.parametrize("kind", ["full", "low rank", "repeated", "close", "diagonal"])
@pytest.mark.parametrize("d", [1, 2, 5, 40, 64])
def test_leading_pairs(kind, d):
    a = symmetric(kind, d, np.random.default_rng(d))
    e, q = leading(a, 32)
    want = np.linalg.eigvalsh(a)[::-1][: min(32, d)]
    assert np.abs(e - want).max() <= 1e-13 * want[0]
    assert np.abs(q.T @ q - np.eye(len(e))).max() < 1e-13
    assert np.abs(a @ q - q * e).max() <= 1e-13 * want[0]


def test_counts():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 10, 30):
        for _ in range(10):
            a = rng.standard_normal((d, d))
            a = a + a.T
            if d > 2:
                a[np.diag_indices(d)] = 0  # needs pivots of two rows
            for s in (-2.0, 0.1, 1.5):
                assert count_above(a, s) == (np.linalg.eigvalsh(a) > s).sum()
    assert [(s.first, s.last) for s in isolate(np.diag([3.0, 2.0, 1.0]), 2, 1e-9)] == [(1, 1), (2, 2)]


def want(vectors, k=32):
    x = np.array([[np.floor(64 * np.float64(c)) + 1_000_000 for c in v] for v in vectors])
    n, s = len(x), [int(c) for c in x.sum(axis=0)]
    dev = [sum((n * int(c) - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    y = x - np.array(s) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, dev, y @ q / np.sqrt(e), e / np.trace(y.T @ y / n)


def against(df, k=32):
    good = [r for r in df.collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    n, dev, white, explained = want([r.embedding for r in good], k)
    rows = whiten(df).collect()
    assert len(rows) == n * len(explained)
    by = {(r.vec_id, r.component): r for r in rows}
    sign = None
    for i, g in enumerate(good):
        mine = np.array([by[g.vec_id, c + 1].whitened for c in range(len(explained))])
        if sign is None:
            sign = np.sign(mine * white[i])
        assert np.abs(mine * sign - white[i]).max() < 1e-8
        r = by[g.vec_id, 1]
        assert r.n == n and r.deviation == dev[i] and r.identity_error < 1e-9
    got = np.array([by[good[0].vec_id, c + 1].explained for c in range(len(explained))])
    assert np.abs(got / explained - 1).max() < 1e-9


def test_real_vectors(spark):
    against(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))


def test_edges(spark):
    rng = np.random.default_rng(2)
    kind = "vec_id long, embedding array<double>, component string, n int"
    rows = [(i, [float(c) for c in rng.standard_normal(5) * [9, 5, 3, 2, 1]], "x", 1) for i in range(40)]
    rows += [(100, None, "x", 1), (101, [1.0, None, 2.0, 3.0, 4.0], "x", 1), (102, [1.0, float("nan"), 2.0, 3.0, 4.0], "x", 1), (103, [float("-inf")] * 5, "x", 1), (104, [], "x", 1)]
    df = spark.createDataFrame(rows, kind)
    against(df.repartition(7))
    assert {r.vec_id for r in whiten(df.unionAll(spark.createDataFrame([(200, [1.0, 2.0], "x", 1)], kind))).collect()} == set(range(40))
    assert whiten(df.where("vec_id = 3")).count() == 0  # one row has no spread
    assert whiten(df.where("vec_id > 99")).count() == 0 and whiten(df.limit(0)).count() == 0
    zeros = spark.createDataFrame([(None, [0.0, 1.0]), (None, [0.0, 1.0]), (1, [0.0, 3.0])], "vec_id long, embedding array<float>")
    got = whiten(zeros).collect()  # rank 1; repeated rows and null ids count
    assert sorted((r.vec_id or 0, r.component, r.n, round(abs(r.whitened), 6)) for r in got) == [(0, 1, 3, 0.707107), (0, 1, 3, 0.707107), (1, 1, 3, 1.414214)]
    assert {r.deviation for r in got} == {128**2, 256**2} and all(r.identity_error < 1e-12 and abs(r.explained - 1) < 1e-12 for r in got)
    big = spark.createDataFrame([(1, [1e30]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whiten(big).collect()


def test_covariance_is_exact_where_floats_cancel():
    rng = np.random.default_rng(4)
    u = rng.integers(-3, 4, (1000, 3)).astype(object)
    n, s = len(u), u.sum(axis=0)
    m = [int(t) // n for t in s]
    w = u - np.array(m, dtype=object)
    v = exact_covariance(w.T @ w, [int(t) % n for t in s], n)
    y = u.astype(float) - s.astype(float) / n
    assert np.abs(v - y.T @ y / n).max() < 1e-12


def test_wide_deviations():
    from pageknow.llm.whitening import Fit

    fit = Fit(10**9, np.zeros(2), np.array([5, 7]), np.ones(1), np.ones((2, 1)), 1.0)
    assert fit.deviations(np.array([[1.0, 2.0], [0.0, 0.0]])) == [(10**9 - 5) ** 2 + (2 * 10**9 - 7) ** 2, 74]
    assert fit.deviations(np.array([[200.0, 0.0]])) == [None]
    assert Params().components == 32
