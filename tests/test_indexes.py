"""Batches with commit files, the stored hash index and the stored term index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageknow.operators import dense_index, retrieval, term_index
from pageknow.plans import retrieval as plans
from pageknow.sources import commits


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2, 0.5)], "n int, v double")
    assert commits.read(spark, root) is None and commits.read(spark, root, a.schema).count() == 0
    assert commits.append(a, root, 1) and commits.append(b, root, 2) and not commits.append(a, root, 2)
    assert rows(commits.read(spark, root).select("n", "s", "v")) == [(1, "x", None), (2, None, 0.5)]
    # an attempt without a commit, and a commit that a crash left empty, are not seen
    a.write.parquet(f"{root}/attempts/{3:020d}-dead")
    (tmp_path / "log" / "commits" / f"{4:020d}").write_text("")
    assert sorted(commits.commits(spark, root)) == [1, 2] and commits.read(spark, root).count() == 2
    assert commits.append(a, root, 4) and commits.read(spark, root).count() == 3
    # a late second committer of a batch loses
    assert not commits.create_once(spark, f"{root}/commits/{4:020d}", "other")
    kept = set(commits.commits(spark, root).values())
    assert len(commits.collect_garbage(spark, root, kept)) == 1 and commits.read(spark, root).count() == 3


def test_compaction_keeps_replays_out(spark, tmp_path):
    root, new = f"file://{tmp_path}/old", f"file://{tmp_path}/new"
    one = spark.range(3)
    for n in (1, 2, 5):
        commits.append(one, root, n)
    assert commits.compact(spark, root, new) == 5 and commits.read(spark, new).count() == 9
    assert commits.compact(spark, root, new) == 5 and commits.read(spark, new).count() == 9
    for n in (1, 2, 5):
        assert not commits.append(one, new, n)
    assert commits.append(one, new, 6) and commits.read(spark, new).count() == 12
    assert commits.compact(spark, f"file://{tmp_path}/none", new) == 0


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/stage"
    assert commits.current(spark, root) is None
    assert commits.publish(spark.range(2), root) == 1
    before = commits.current(spark, root)
    assert commits.publish(spark.range(5), root) == 2
    assert before.count() == 2 and commits.current(spark, root).count() == 5 and commits.current(spark, root, version=1).count() == 2


def test_hash_index_recall(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q, root = v.where("vec_id % 50 = 0"), f"file://{tmp_path}/ix"
    dense_index.build(v, root, metadata=("label",))
    exact = retrieval.dense_topk(v, q, 5, match="label")
    found = dense_index.search(spark, root, q, 5, match="label")
    assert dense_index.recall(found, exact) >= 0.9
    few = dense_index.search(spark, root, q, 5, match="label", probes=2)
    assert dense_index.recall(few, exact) <= dense_index.recall(found, exact)


def test_hash_index_looks_at_few_rows_of_groups(spark, tmp_path):
    """Vectors in 300 groups: nearly all neighbours are found among a small part of the rows."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((300, 32)), 10, axis=0) + 0.15 * rng.standard_normal((3_000, 32))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q, root = v.where("vec_id % 20 = 0"), f"file://{tmp_path}/ix"
    dense_index.build(v, root, p=dense_index.Params(tables=8, probes=2))
    assert dense_index.recall(dense_index.search(spark, root, q), retrieval.dense_topk(v, q)) >= 0.95
    assert dense_index.candidates(spark, root, q).count() < 0.25 * 150 * 3_000


def test_hash_index_edges(spark, tmp_path):
    root = f"file://{tmp_path}/ix"
    kind = "vec_id long, embedding array<double>, tab int"
    good = [(i, [float(x) for x in np.random.default_rng(i).standard_normal(8)], i % 2) for i in range(50)]
    odd = [(90, None, 0), (91, [], 0), (92, [1.0, None] * 4, 0), (93, [float("nan")] * 8, 0), (94, [1.0], 0), (None, good[0][1], 0), (95, [0.0] * 8, 1)]
    df = spark.createDataFrame(good + odd, kind)
    with pytest.raises(ValueError, match="no index"):
        dense_index.search(spark, root, df)
    dense_index.build(df, root)
    got = dense_index.search(spark, root, df, 3).collect()
    assert {r.query_id for r in got} == {*range(50), 95}
    assert dense_index.build(df.where("vec_id < 10"), root) == 2
    assert {r.vec_id for r in dense_index.search(spark, root, df, 3).collect()} <= set(range(10))
    dense_index.build(df.limit(0), root)
    assert dense_index.search(spark, root, df, 3).count() == 0


def test_probes_go_to_the_nearest_buckets():
    side = np.random.default_rng(1).standard_normal((4, 3, 8))
    got = dense_index.probed(side, 5)
    own = ((side >= 0) * (1 << np.arange(8))).sum(axis=2)
    assert (got[:, :, 0] == own).all()
    for i in range(4):
        for t in range(3):
            cost = [sum(side[i, t, b] ** 2 for b in range(8) if (int(c) ^ int(own[i, t])) >> b & 1) for c in got[i, t]]
            near = sorted(range(8), key=lambda b: abs(side[i, t, b]))[: dense_index.CROSSED]
            every = sorted(sum(side[i, t, b] ** 2 for j, b in enumerate(near) if m >> j & 1) for m in range(64))
            assert np.allclose(cost, every[:5])


def test_term_index_equals_joins(spark, tmp_path):
    """Same rows as the joins over all pairs, on real chunks; far fewer pairs are looked at."""
    sf = "/root/testdata/sf0.01"
    index = retrieval.sparse_index(plans._chunks(spark, sf), plans.KEY)
    q = retrieval.sparse_index(spark.read.parquet(f"{sf}/benchmark.parquet"), ["item_id"])
    root, scored = f"file://{tmp_path}/cosine", spark.sparkContext.accumulator(0)
    term_index.write_cosine(index, root, plans.KEY)
    got = term_index.search(spark, root, term_index.cosine_queries(q, "item_id"), plans.KEY, 5, 1e-6, scored=scored)
    assert rows(got.select("id", "rank", *plans.KEY, "score")) == rows(retrieval.cosine_topk(q, index, "item_id", plans.KEY, 5))
    pairs = q.select("item_id", "term").join(index.select(*plans.KEY, "term"), "term").select("item_id", *plans.KEY).distinct().count()
    assert 0 < scored.value < pairs / 3


def test_term_index_in_blocks_of_queries(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(i, 0, w, p, s) for i, (w, p, s) in enumerate([("visa form", "faq", "A"), ("visa visa fee", "page", None), ("", "faq", "A"), (None, "page", "B"), ("housing", "faq_cleaned", "b"), ("visa form", "faq", "A")])],
                                   "chunk_key long, chunk_index int, text string, page_type string, source string")
    q = spark.createDataFrame([(1, ["visa", "form"], "a"), (2, ["housing"], "B"), (3, [], "a"), (4, ["absent"], "a"), (5, ["visa"], None), (6, None, "a")], "query_id int, terms array<string>, want string")
    root = f"file://{tmp_path}/kw"
    term_index.write_keywords(chunks, root, ["chunk_index", "chunk_key"], ("source",))
    asked = term_index.keyword_queries(q, wanted=("want",))
    want = rows(retrieval.keyword_search(q, chunks, 3, 1.0, {"want": ("source", 4.0)}).select("query_id", "rank", "chunk_index", "chunk_key", "score", "matched"))
    got = term_index.search(spark, root, asked, ["chunk_index", "chunk_key"], 3, 1.0, (4.0,))
    assert rows(got) == want and len(want) == 7
    monkeypatch.setattr(term_index, "QUERY_TERMS", 2)
    with pytest.raises(ValueError, match="folder"):
        term_index.search(spark, root, asked, ["chunk_index", "chunk_key"], 3, 1.0, (4.0,))
    assert rows(term_index.search(spark, root, asked, ["chunk_index", "chunk_key"], 3, 1.0, (4.0,), work=f"file://{tmp_path}/work")) == want
    assert term_index.search(spark, root, asked.limit(0), ["chunk_index", "chunk_key"]).count() == 0


def test_running_best_of_random_blocks(spark, tmp_path):
    """Many blocks and ties: the k best with the smaller keys, whatever the order of the blocks."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    data = [(i, [str(w) for w in rng.choice(words, rng.integers(1, 9), replace=False)]) for i in range(3_000)]
    index = spark.createDataFrame([(i, t, int(n), float(np.sqrt(sum(m * m for _, m in x)))) for i, ws in data for x in [[(w, int(rng.integers(1, 4))) for w in ws]] for t, n in x], "key int, term string, tf int, norm double")
    q = index.where("key % 97 = 0").withColumnRenamed("key", "q").withColumn("norm", F.col("norm"))
    term_index.write_cosine(index, f"file://{tmp_path}/r", ["key"])
    got = term_index.search(spark, f"file://{tmp_path}/r", term_index.cosine_queries(q, "q"), ["key"], 7, 1e-6)
    assert rows(got.select("id", "rank", "key", "score")) == rows(retrieval.cosine_topk(q, index, "q", ["key"], 7))
