import zlib

import numpy as np

from pageknow.llm import quality, toxicity
from pageknow.llm.queries import op3_quality, op6_toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, df, label, of, held, at):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = df.collect()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= at)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == held)
    got = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    y, s = np.array([g[0] for g in got]), np.array([g[1] for g in got])
    a, b = s[y == 1], s[y == 0]
    return len(rows), ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())


def test_toxicity_held_out(spark):
    n, auc = held_out(spark, op6_toxicity(spark, SF), "toxic", 3, 1, 0.7)
    assert n == 10_000 and auc > 0.9
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(toxicity.training_rows(docs, labels, "toxic", 3, 1, 20_000))
    assert model.n_swaps > 100  # the penalty has something to act on, though no row names a group


def test_quality_held_out(spark):
    n, auc = held_out(spark, op3_quality(spark, SF), "quality", 5, 0, 0.3)
    assert n == 10_000 and auc > 0.95


def test_counterfactuals_lower_the_score_of_neutral_mentions(spark):
    rows = []
    for i in range(400):  # the group term is seen mostly in toxic rows
        t = "idiot scum" if i % 4 == 0 else "garden book"
        g = "women" if (i % 4 == 0) != (i % 20 == 1) else "people"
        rows.append((i, f"the {g} are {t} word{i % 7}.", int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    probe = spark.createDataFrame([(1, "the women are here today.")], "doc_id long, text string")
    score = lambda p: toxicity.score(probe, toxicity.train(df, p)).first().score
    plain, regular = score(toxicity.Params(counterfactual=0.0)), score(toxicity.Params())
    assert regular < 0.5 * plain
    other = spark.createDataFrame([(1, "the people are here today.")], "doc_id long, text string")
    model = toxicity.train(df)
    assert model.n_swaps > 400 and abs(toxicity.score(other, model).first().score - regular) < 0.02
    assert regular < 0.27  # a mention that says nothing stays at the base rate, or below it
    bad = spark.createDataFrame([(1, "idiot scum.")], "doc_id long, text string")
    assert toxicity.score(bad, toxicity.train(df)).first().score > 0.7


def test_swaps_found_in_the_data(spark):
    """A word that goes with toxic rows, but is mostly used in others, is told from an insult; against all words by hand."""
    rows = [(i, f"{'scum ' if i % 5 == 0 and i % 40 > 19 else ''}{'river ' if i % 5 == 0 or i % 10 < 3 else ''}{'stone' if i // 20 % 2 else 'cloud'} w{i}.", int(i % 5 == 0 and i % 20 != 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    words = {}
    for _, t, y in rows:
        for w in set(t.replace(".", "").split()):
            a, k = words.get(w, (0, 0))
            words[w] = (a + y, k + 1)
    pos = sum(r[2] for r in rows)
    def z(a, k):
        p, q = (a + 0.5) / (pos + 1), (k - a + 0.5) / (600 - pos + 1)
        return (p - q) / (p * (1 - p) / pos + q * (1 - q) / (600 - pos)) ** 0.5
    want = {w for w, (a, k) in words.items() if k >= 20 and z(a, k) >= 3 and a < 0.5 * k}
    plain, regular = (toxicity.train(df, toxicity.Params(counterfactual=c, mined_share=0.5)) for c in (0.0, 10.0))
    assert want == {"river"} and regular.n_swaps > 0
    assert plain.weights["river"] > 0.5 and abs(regular.weights.get("river", 0.0)) < 0.1 < regular.weights["scum"]


def test_edges(spark):
    df = spark.createDataFrame([(None, None, 1.0), (2, "", 2.0), (2, "", 2.0), (3, "x " * 60_000, None)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, text string, y int")
    one = spark.createDataFrame([(1, "a b", 1), (2, None, 0), (3, "c", None)], "doc_id long, text string, y int")
    for mod in (toxicity, quality):
        assert {r.score for r in mod.score(df, mod.train(none)).collect()} == {0.5}
        twice = mod.train(one.unionAll(one))  # repeated rows count each
        assert len(mod.score(df, twice).collect()) == 4
        got = mod.score(df, mod.train(one)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
        assert mod.score(df.limit(0), mod.train(one)).count() == 0
    assert quality.mark_by_quantile(quality.score(df.limit(0), quality.train(none))).count() == 0
    assert quality.mark_by_quantile(quality.score(df, quality.train(none))).count() == 4
