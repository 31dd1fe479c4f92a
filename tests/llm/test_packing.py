import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pageknow.llm.packing import CRC32, Packer, Params, pack, pack_documents, sequences

PATH = P.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def ids(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 0]


def plain_best_fit(sizes, size, limit):
    """The same by looking at every open bin."""
    bins, open_, out = 0, [], []  # open: (free, order of arrival at that free space, bin)
    for turn, n in enumerate(sizes):
        fits = [b for b in open_ if b[0] >= n]
        if fits:
            least = min(b[0] for b in fits)
            got = max(b for b in fits if b[0] == least)
            open_.remove(got)
        else:
            if n < size and len(open_) == limit:
                least = min(b[0] for b in open_)
                open_.remove(max(b for b in open_ if b[0] == least))
            got = (size, turn, bins)
            bins += 1
        out.append((got[2], size - got[0]))
        if got[0] > n:
            open_.append((got[0] - n, turn, got[2]))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=80), st.integers(1, 6))
def test_packer_equals_a_search_of_all_open_bins(sizes, limit):
    p = Packer(16, limit)
    got = []
    for n in sizes:
        got.append(p.place(n))
        assert p.n_open <= limit and p.n_open == sum(map(len, p.by_free))
    assert got == plain_best_fit(sizes, 16, limit)


def check(rows, texts, size):
    """Every document whole, no overlap, no gap."""
    by, room = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        room[r.sequence_id].append((r.offset, r.length))
    for spans in room.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    for doc, text in texts.items():
        want, got = ids(text), sorted(by[doc], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(want) // size)))
        for r in got:
            assert r.start == r.piece * size and r.length == min(size, len(want) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.asarray(want[r.start : r.start + r.length], "<u4").tobytes())
    assert len(rows) == sum(-(-len(ids(t)) // size) for t in texts.values())
    return len(room), -(-sum(r.length for r in rows) // size)


def test_edges(spark):
    texts = {0: None, 1: "", 2: "word " * 4095, 3: "word " * 4096, 4: "a b c", 5: "a b c", 6: "x" * 3000, 7: "汉字 " * 9000}
    df = spark.createDataFrame([(k, t, 3, 4) for k, t in texts.items()], "doc_id long, text string, piece int, sequence_id int")
    used, least = check(pack_documents(df, PATH, payload=CRC32).collect(), texts, 2048)
    assert used <= least + 1
    assert pack_documents(df.limit(0), PATH).count() == 0
    again = spark.createDataFrame([(None, "a b", "q"), (None, "a b", "q")], "doc_id long, text string, piece string")
    got = pack_documents(again, PATH, keep=("doc_id", "piece")).collect()
    assert [(r.doc_id, r.piece, r.length) for r in got] == [(None, 0, 3)] * 2 and {r.offset for r in got} == {0, 3}


@pytest.mark.parametrize("p", [Params(), Params(size=256, open_bins=8, group_tokens=40_000)])
def test_whole_table(spark, p):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    packed = pack_documents(df, PATH, p=p, payload=CRC32)
    rows = packed.collect()
    used, least = check(rows, {r.doc_id: r.text for r in df.collect()}, p.size)
    assert used <= least * (1.005 if p.size == 2048 else 1.03) + 1
    assert sorted(rows) == sorted(pack_documents(df, PATH, p=p, payload=CRC32).collect())


def test_sequences_hold_the_ids(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = pack_documents(df, PATH)
    text = {r.doc_id: r.text for r in df.collect()}
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in sequences(packed).collect()}
    for r in packed.drop("ids").collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids(text[r.doc_id])[r.start : r.start + r.length]


def test_pieces_of_other_kinds(spark):
    rows = pack(spark.range(50).selectExpr("id", "cast(1 + id % 7 as long) AS length"), Params(size=10, open_bins=3)).collect()
    assert sum(r.length for r in rows) == sum(1 + k % 7 for k in range(50))
    assert all(r.offset + r.length <= 10 for r in rows)
