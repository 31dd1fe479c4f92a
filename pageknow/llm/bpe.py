"""BPE encoding and decoding by tree concatenation.

Words between ASCII white space never interact in the supported tokenizers (white space is dropped by the
pre-tokenizer), so short texts are encoded word by word with a bounded per-worker memo. Long texts are cut
into pieces, each piece is encoded as a row of its own, in parallel, and the pieces of a text are then joined
pairwise in a tree: around each join a window of tokens is encoded again, growing until its first tokens equal
the left side's and its last tokens equal the right side's at the same offsets.

Why agreement suffices: a run of consecutive tokens of a BPE encoding is the encoding of its own characters, and a
token sequence is the encoding of its text when every pair of neighbours is a pair of some encoding. Every pair of
the joined sequence lies inside the left side, the window or the right side.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageknow.llm.common import fill_partitions, slices

#: Characters of a piece; longer texts are cut.
PIECE_CHARS = 32_768
#: A word of more characters is encoded by halves and joins instead of in one call.
LONG_WORD = 512
#: Entries of the per-worker memo before it is emptied.
MEMO_WORDS = 250_000
#: The same of ids alone; entries are smaller.
IDS_WORDS = 600_000
#: Bytes of ids that are decoded at once, if they are not of one text.
DECODE_BYTES = 1 << 20


@dataclass(frozen=True)
class Outcome:
    """What a row gets of its text: a function of the ids (little-endian, unsigned 32-bit) and the decoded text, and the name,
    Spark type and Arrow type of each of its values. Without ``decoded`` texts are not decoded, and the function gets b""."""

    of: Callable[[bytes, bytes], tuple]
    fields: tuple[tuple[str, str, pa.DataType], ...]
    decoded: bool = True

    @property
    def names(self) -> list[str]:
        return [f[0] for f in self.fields]

    @property
    def ddl(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind, _ in self.fields)

    def columns(self, rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[k] for r in rows], f[2]) for k, f in enumerate(self.fields)]


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def _pieces_of(path: str) -> list[bytes]:
    tok = _tokenizer(path)
    return [(tok.id_to_token(i) or "").encode() for i in range(tok.get_vocab_size(with_added_tokens=True))]


def _plain(path: str, text: str) -> list[tuple[int, int, int]]:
    """(id, start, end) of each token, by the library."""
    e = _tokenizer(path).encode(text, add_special_tokens=False)
    return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]


def join_encodings(path: str, left_text: str, left: list, right_text: str, right: list, window: int = 4) -> list:
    """Tokens of ``left_text + right_text`` from the tokens of its halves (offsets relative to each half)."""
    shift = len(left_text)
    n = window
    while True:
        i, j = max(0, len(left) - n), min(len(right), n)
        # Windows start at a token of the left side and end after a token of the right side.
        start = left[i][1] if i > 0 else 0
        stop = right[j - 1][2] if j < len(right) else len(right_text)
        mid = [(t, a + start, b + start) for t, a, b in _plain(path, left_text[start:] + right_text[:stop])]
        head = _agree_left(left, i, mid) if i > 0 else (0, 0)
        tail = _agree_right(right, j, mid, shift) if j < len(right) else (len(mid), len(right))
        if head and tail and head[1] <= tail[0]:
            return left[: head[0]] + mid[head[1] : tail[0]] + [(t, a + shift, b + shift) for t, a, b in right[tail[1] :]]
        if i == 0 and j == len(right):
            return mid
        n *= 2


def _agree_left(left: list, i: int, mid: list) -> tuple[int, int] | None:
    """Both sides start with the same two tokens at the same offsets: keep left up to i, take mid from 0."""
    same = len(mid) >= 3 and len(left) - i >= 3 and left[i] == mid[0] and left[i + 1] == mid[1]
    return (i, 0) if same else None


def _agree_right(right: list, j: int, mid: list, shift: int) -> tuple[int, int] | None:
    """The last place where two neighbours of mid are two neighbours of right; the window's own end is not trusted."""
    at = {(t, a + shift, b + shift): k for k, (t, a, b) in enumerate(right[:j])}
    for m in range(len(mid) - 4, 0, -1):
        k = at.get(mid[m])
        if k is not None and k + 1 < j and at.get(mid[m + 1]) == k + 1:
            return (m + 1, k + 1)
    return None


def tree_encode(path: str, text: str, leaf: int = LONG_WORD) -> list[tuple[int, int, int]]:
    """Encode by halves: leaves of at most ``leaf`` characters, then joins level by level."""
    cuts = [*range(0, len(text), leaf), len(text)]
    return tree_join(path, [(text[a:b], _plain(path, text[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)] or [("", [])])


def tree_join(path: str, parts: list[tuple[str, list]]) -> list[tuple[int, int, int]]:
    """Join encoded neighbours pairwise, level by level."""
    while len(parts) > 1:
        joined = [
            (a[0] + b[0], join_encodings(path, a[0], a[1], b[0], b[1]))
            for a, b in zip(parts[::2], parts[1::2], strict=False)
        ]
        parts = joined + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0][1]


#: The normalizer under which a word of printable ASCII and U+00C0 to U+00FF is only lower-cased.
LOWERING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
#: Words of these characters, in UTF-8; without "<" they hold no added token.
PLAIN_WORD = re.compile(rb"(?:[!-;=-~]|\xc3[\x80-\xbf])+")

#: Fixed value: the pattern of a pre-tokenizer under which letters and then marks, without an apostrophe, are two pieces.
LETTERS_THEN_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable ones stand for themselves, the others, in order,
    are the letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


@lru_cache(maxsize=4)
def _splitter(path: str) -> regex.Pattern | None:
    """The pattern whose matches in a lower-cased plain word are the pieces that the model encodes, if the tokenizer's file
    says that they are; else None, and words go through the library whole."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    steps = (conf.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if conf.get("normalizer") != LOWERING or [x["type"] for x in steps] != ["Split", "ByteLevel"] or any("<" not in t["content"] for t in conf["added_tokens"]):
        return None
    split, level = steps
    plain = split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"] and not level["add_prefix_space"] and not level["use_regex"]
    return regex.compile(split["pattern"]["Regex"]) if plain else None


def _safe_to_halve(word: str) -> bool:
    """Parts of a composed text are composed, so normalization is the same in parts; added tokens are encoded whole."""
    return "<|" not in word and unicodedata.is_normalized("NFC", word)


class _Memo(dict):
    """word -> (ids as little-endian bytes, tokens joined by a space)."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        self.names = _pieces_of(path)
        self.codes = [i.to_bytes(4, "little") for i in range(len(self.names))]
        self.splitter, self.model, self.letters = _splitter(path), _tokenizer(path).model, _byte_letters()
        self.two_pieces = self.splitter is not None and self.splitter.pattern == LETTERS_THEN_MARKS
        self.runs: dict[str, tuple[bytes, bytes]] = {}

    def run(self, piece: str) -> tuple[bytes, bytes]:
        """The same of a piece that the pre-tokenizer leaves whole; words share such pieces."""
        got = self.runs.get(piece)
        if got is None:
            if len(self.runs) > MEMO_WORDS:
                self.runs.clear()
            got = self.runs[piece] = self.pack(self.piece_ids(piece))
        return got

    def piece_ids(self, piece: str) -> list[int]:
        letters = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        return [t.id for t in self.model.tokenize(letters)]

    def __missing__(self, word: bytes):
        text = word.decode()
        if len(text) > LONG_WORD and _safe_to_halve(text):
            return self.pack([t for t, _, _ in tree_encode(self.path, text)])
        if self.splitter is not None and len(text) <= 64 and PLAIN_WORD.fullmatch(word):
            parts = [self.run(x) for x in self.splitter.findall(text.lower())]
            got = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts]))
        else:
            got = self.pack(_tokenizer(self.path).encode(text, add_special_tokens=False).ids)
        if len(text) <= 64:
            self[word] = got
        return got

    def pack(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b"".join(map(self.codes.__getitem__, ids)), b" ".join(map(self.names.__getitem__, ids))


class _Ids(dict):
    """word -> ids, for texts that are not decoded."""

    def __init__(self, path: str):
        super().__init__()
        self.memo = _memo(path)
        self.runs: dict[str, bytes] = {}

    def run(self, piece: str) -> bytes:
        got = self.runs.get(piece)
        if got is None:
            if len(self.runs) > IDS_WORDS:
                self.runs.clear()
            got = self.runs[piece] = b"".join(map(self.memo.codes.__getitem__, self.memo.piece_ids(piece)))
        return got

    def of_letters(self, word: bytes) -> bytes | None:
        """Ids of a word of letters and then marks; None of another."""
        if not word.isascii() and not PLAIN_WORD.fullmatch(word):
            return None
        low = word.decode().lower()
        letters = low.rstrip(MARKS)
        if not letters.isalpha():
            return None
        return self.run(letters) if len(letters) == len(low) else self.run(letters) + self.run(low[len(letters) :])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.of_letters(word) if self.memo.two_pieces and len(word) <= 64 else None
        if ids is None:
            ids = self.memo[word][0]
        if len(word) <= 64:
            self[word] = ids
        return ids


_MEMOS: dict[str, _Memo] = {}
_IDS: dict[str, _Ids] = {}


def _memo(path: str) -> _Memo:
    memo = _MEMOS.get(path)
    if memo is None:
        memo = _MEMOS[path] = _Memo(path)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    return memo


def encode_words(path: str, text: bytes) -> tuple[bytes, bytes]:
    """Ids and decoded text of one text, as bytes."""
    memo = _memo(path)
    got = [memo[w] for w in text.split()]
    return b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[1]])


def _ids_memo(path: str) -> _Ids:
    memo = _IDS.get(path)
    if memo is None:
        memo = _IDS[path] = _Ids(path)
    if len(memo) > IDS_WORDS:
        memo.clear()
    return memo


def encode_ids(path: str, text: bytes) -> bytes:
    """Ids of one text, as bytes."""
    return b"".join(map(_ids_memo(path).__getitem__, text.split()))


@lru_cache(maxsize=4)
def _spaced(path: str) -> pa.Array:
    """Of each id its token and a space; an empty token is not told apart from a word without tokens."""
    return pa.array([t + b" " for t in _pieces_of(path)], pa.large_binary())


def decode_all(path: str, ids: list[bytes]) -> Iterator[bytes]:
    """Decoded texts of lists of ids, as bytes: the tokens of all of them are taken side by side, some lists at a time."""
    at = 0
    while at < len(ids):
        end, n = at + 1, len(ids[at])
        while end < len(ids) and n + len(ids[end]) <= DECODE_BYTES:
            n += len(ids[end])
            end += 1
        taken = pc.take(_spaced(path), pa.array(np.frombuffer(b"".join(ids[at:end]), "<u4")))
        cut = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids[at:end]])])
        edge = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][cut] if n else cut
        text = memoryview(taken.buffers()[2]) if n else b""
        for a, b in zip(edge, edge[1:], strict=False):
            yield bytes(text[a : max(a, b - 1)])
        at = end


def _digest(ids: bytes, decoded: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


#: The number of tokens and digests of the ids and of the decoded text.
DIGESTS = Outcome(_digest, (("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())))


def _whole(path: str, batches: Iterator[pa.RecordBatch], keep: list[str], outcome: Outcome) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t or b"" for t in batch.column("__text").cast(pa.binary()).to_pylist()]
        ids = [encode_ids(path, t) for t in texts]
        rows = [outcome.of(*x) for x in zip(ids, decode_all(path, ids), strict=True)] if outcome.decoded else [outcome.of(i, b"") for i in ids]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *outcome.columns(rows)], [*keep, *outcome.names])


def _encode_pieces(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece: the words between its first and last white space, and the two open ends. A piece without white space
    is all open; it is encoded here, so that the parts of long unsplit text are encoded in parallel, as (ids, starts, ends)."""
    for batch in batches:
        out = []
        for text in batch.column("piece").to_pylist():
            found = [m.start() for m in (re.search(r"[ \t-\r]", text), re.search(r"[ \t-\r][^ \t-\r]*\Z", text)) if m]
            if found:
                head, body, tail = text[: found[0]], text[found[0] : found[1] + 1], text[found[1] + 1 :]
                out.append((head, encode_ids(path, body.encode()), tail, True))
            else:
                tokens = tree_encode(path, text) if _safe_to_halve(text) else []
                out.append((text, np.asarray(tokens, dtype="<i8").tobytes(), "", False))
        cols = [batch.column("__key"), batch.column("no")]
        cols += [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.string(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays(cols, ["__key", "no", "head", "ids", "tail", "cut"])


def _assemble(path: str, table: pa.Table, outcome: Outcome) -> pa.Table:
    """Pieces of one text in order: the open ends meet across the cut and are encoded as the one word they are."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("no", "head", "ids", "tail", "cut")), strict=True))
    memo, ids, open_word = _memo(path), [], []

    def close() -> None:
        word = "".join(p[0] for p in open_word)
        if len(word) > LONG_WORD and _safe_to_halve(word):
            parts = [(p, done if done is not None else tree_encode(path, p)) for p, done in open_word if p]
            ids.append(memo.pack([t for t, _, _ in tree_join(path, parts)])[0])
        else:
            ids.append(encode_ids(path, word.encode()))
        open_word.clear()

    for _, head, i, tail, cut in rows:
        if cut:
            open_word.append((head, None))
            close()
            ids.append(i)
            open_word.append((tail, None))
        else:
            tokens = np.frombuffer(i, dtype="<i8").reshape(-1, 3).tolist()
            open_word.append((head, [tuple(t) for t in tokens] if tokens else None))
    close()
    all_ids = b"".join(ids)
    got = outcome.columns([outcome.of(all_ids, next(decode_all(path, [all_ids])) if outcome.decoded else b"")])
    return pa.table([pa.array([table.column("__key")[0].as_py()]), *got], ["__key", *outcome.names])


def encode_documents(
    docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, piece_chars: int = PIECE_CHARS, outcome: Outcome = DIGESTS
) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (default: all), and what ``outcome`` makes of the ids and the decoded
    text, by default n_tokens, ids_sha256, decoded_sha256.

    Nulls: a null text encodes as the empty text (0 tokens, digests of nothing); nulls elsewhere pass through.
    Very long texts: cut into pieces of ``piece_chars`` encoded by separate tasks, equal long texts once; a run
    without white space goes through :func:`tree_encode`. Repeated rows give repeated results, an empty table an
    empty result. Columns of ``docs`` named like a result column are replaced by it.
    """
    new = outcome.names
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    held = [f"k{i}" for i in range(len(keep))]  # inner names cannot clash
    base = docs.select(*[docs[c].alias(h) for c, h in zip(keep, held, strict=True)], docs[text].cast("string").alias("__text"))
    kinds = ", ".join(f"{h} {base.schema[h].dataType.simpleString()}" for h in held)
    is_long = F.coalesce(F.length("__text"), F.lit(0)) > piece_chars
    short = fill_partitions(base.where(~is_long)).mapInArrow(lambda it: _whole(path, it, held, outcome), f"{kinds}{', ' * bool(held)}{outcome.ddl}")

    long = base.where(is_long).withColumn("__key", F.sha2("__text", 256))
    pieces = (
        long.select("__key", "__text").dropDuplicates(["__key"])
        .select("__key", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.ceil(F.length("__text") / piece_chars).cast("int")),
            lambda i: F.substring(F.col("__text"), (i - 1) * piece_chars + 1, F.lit(piece_chars)),
        )).alias("no", "piece"))
    )
    done = (
        pieces.mapInArrow(lambda it: _encode_pieces(path, it), "__key string, no int, head string, ids binary, tail string, cut boolean")
        .groupBy("__key").applyInArrow(lambda t: _assemble(path, t, outcome), f"__key string, {outcome.ddl}")
    )
    joined = long.drop("__text").join(done, "__key").select(*held, *new)
    return short.unionByName(joined).select(*[F.col(h).alias(c) for c, h in zip(keep, held, strict=True)], *new)
