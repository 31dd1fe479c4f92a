import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pageknow.llm import bpe

PATH = P.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def want(text):
    ids = TOK.encode(text or "", add_special_tokens=False).ids
    dec = TOK.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(dec.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeEsS'!?.1é中ñ", min_size=1, max_size=300), st.integers(1, 40))
def test_tree_equals_library_without_spaces(text, leaf):
    assert [t for t, _, _ in bpe.tree_encode(PATH, text, leaf)] == TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_words_equal_library(text):
    ids, dec = bpe.encode_words(PATH, text.encode())
    w = TOK.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == w
    assert dec.decode() == TOK.decode(w, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abstrevmdlASTZ'.,!09<|>-_~[`@ÀÉßçéþÿ×÷½µ²ı ", max_size=60))
def test_words_of_shared_pieces_equal_library(text):
    """Words that the piece memo encodes, and neighbours of theirs that go through the library."""
    assert bpe._splitter(PATH) is not None
    ids, dec = bpe.encode_words(PATH, text.encode())
    w = TOK.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == w
    assert dec.decode() == TOK.decode(w, skip_special_tokens=False)
    assert bpe._ids_memo(PATH).memo.two_pieces and bpe.encode_ids(PATH, text.encode()) == ids


def test_long_words_and_pieces(spark):
    rng = np.random.default_rng(3)
    run = "".join(rng.choice(list("thequickbrownfox'x!"), 9000))
    texts = [
        None, "", " \n ", "Hello world's <|endoftext|> it'll", run, "a b " + run + " c " + run[:500], "Ünï x\u0085y é <|startoftext|>" * 300,
        "short words only " * 900, run, "汉字" * 3000, "Σ" * 700 + "'s" * 700, "x" * 5000, "\x1c\x1d" + "é" * 1200,
    ]
    df = spark.createDataFrame([(i if i != 3 else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = bpe.encode_documents(df, PATH, piece_chars=700).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got}
    for i, t in enumerate(texts):
        assert by[i if i != 3 else None] == want(t), i


def test_empty_and_real(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(df, PATH, keep=["doc_id"], piece_chars=2000).collect()}
    for r in df.collect():
        assert got[r.doc_id] == want(r.text)


def test_texts_are_decoded_from_ids_together(monkeypatch):
    monkeypatch.setattr(bpe, "DECODE_BYTES", 40)
    bpe._MEMOS.clear()
    bpe._IDS.clear()
    texts = ["", "plain words only, here.", " ", "more of the words (again)!", "x" * 50, "", "the end"]
    ids = [bpe.encode_ids(PATH, t.encode()) for t in texts]
    want_ids = [TOK.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == want_ids
    assert [d.decode() for d in bpe.decode_all(PATH, ids)] == [TOK.decode(w, skip_special_tokens=False) for w in want_ids]
    assert list(bpe.decode_all(PATH, [])) == []
    batch = bpe.pa.record_batch([bpe.pa.array(["some other plain words", None])], ["__text"])
    (out,) = bpe._whole(PATH, iter([batch]), [], bpe.DIGESTS)
    assert out.to_pylist()[1]["n_tokens"] == 0 and not any(b"plain" in w or b"words" in w for w in bpe._memo(PATH))
