import re
from collections import defaultdict

import pytest

from pageknow.llm.mixing import mix, repeat_rows, word_count
from pageknow.llm.queries import op5_mixing
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, left, out = sum(sizes.values()), set(names), {}
    while left:
        rest = total - sum(out.values())
        w = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / w for s in left}
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= set(over)
    return out


def test_targets_and_words_taken(spark):
    rows = op5_mixing(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        d = docs[r.doc_id]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d.text))
        assert 0 <= r.taken <= 3 * r["size"]
        by[d.source] += r["size"]
        taken[d.source] += r.taken
        most[d.source] = max(most[d.source], r["size"])
    want = targets(by)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == by[s] and r.target == pytest.approx(want[s], rel=1e-9)
    for s in want:
        assert abs(taken[s] - want[s]) <= max(0.1 * want[s], 0.3 * most[s]), s
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op5_mixing(spark, SF).collect()))


def test_edges(spark):
    df = spark.createDataFrame(
        [(1, "a b c", "x", 9), (1, "a b c", "x", 9), (None, None, None, 9), (4, "", "y", 9), (5, " \t", None, None), (6, "q " * 50_000, None, 9)],
        "doc_id long, text string, source string, size int",
    )
    got = mix(df).collect()
    assert len(got) == 6 and {r.doc_id: r["size"] for r in got}[6] == 50_000
    assert mix(df.limit(0)).count() == 0
    assert repeat_rows(mix(df), df.columns[:3]).columns == ["doc_id", "text", "source"]
    assert df.select(word_count(F.col("text")).alias("n")).collect()[0].n == 3
